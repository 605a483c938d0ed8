"""Embedding near-dedup by Euclidean p-stable hashing.

Equal vectors are folded into one node first, on the map side. Table t hashes a normalised vector by
floor((a.x + b) / WIDTH) for several Gaussian a, so that near vectors share a bucket
of some table. The number of projections follows ln(rows / BUCKET) / ln(1/p2), p2 the
chance that unrelated unit vectors agree in one of them, so that about ``BUCKET``
unrelated vectors share a bucket at any size; the number of tables then follows from
``RECALL`` at the threshold itself.

A bucket's row is a key, a node and 128 sign bits of further projections. Within a
bucket those whose bits differ in at most ``bits_apart`` places are linked (a pair at
the threshold differs in more with a chance of about 1e-6); only members with such a
link go on, and only to them vectors are joined. Each pair is then checked by its exact
cosine in the first table that puts it into one bucket, which the vectors themselves
tell, so that a link counts once and no pair is written anywhere. Groups beyond
``groups.LIMIT`` members are cut into chunks whose pairs go to tasks of their own.

Result of ``near_links``: one row for each row of the table, (vec_id, class_id, links):
the number of other rows at or over the threshold, equal vectors included, and the
least id of the component that such links join. ``near_pairs`` gives the pairs
themselves, between nodes, for tables where they are wanted.

Defined cases: a null, empty or zero vector, and one with a null or non-finite
component, has no direction: its class is its own id and it has no link; only vectors
of one length are compared; rows with one id are rows like any others; a null id takes
part, and is the class only where every member's is null; ids may be of any ordered
type; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import groups, kernel
from tessera.llm.kernel import written
from tessera.operators.graph import connected_components

THRESHOLD = 0.95
WIDTH = 2.0
RECALL = 0.998
BUCKET = 256
SIGNS = 128
#: buckets up to this size are thinned by their sign bits; all members of larger ones go on
THINNED = 1 << 15
TABLE_BITS = 12


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors this far apart in one cell."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def parameters(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for this many rows."""
    far, near = agreement(math.sqrt(2)), agreement(math.sqrt(2 - 2 * threshold))
    k = max(4, math.ceil(math.log(max(rows, 2) / BUCKET) / math.log(1 / far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def bits_apart(threshold: float = THRESHOLD) -> int:
    """Sign bits that a pair at the threshold differs in, and five standard deviations more."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + 5 * math.sqrt(SIGNS * p * (1 - p))))


def _element(table: DataFrame) -> type:
    return np.float32 if table.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def directed_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of every row: the vector's bytes, as doubles or, of a column of floats, as floats; null where it has no direction."""
    kind, element = table.schema["vec_id"].dataType.simpleString(), _element(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n, out = batch.num_rows, [None] * batch.num_rows
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            whole = lists.flatten()
            x = np.asarray(pc.fill_null(whole, math.nan)).astype(element)
            at = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                y = x[at[rows][:, None] + np.arange(size)]
                with np.errstate(all="ignore"):
                    norm = (y.astype(np.float64) ** 2).sum(axis=1)
                    ok = np.isfinite(norm) & (norm > 0)
                for i, r in enumerate(rows.tolist()):
                    if ok[i]:
                        out[r] = y[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()) if n else pa.array([], pa.binary())], ["vec_id", "v"])

    return table.select("vec_id", F.col("embedding").cast("array<float>" if element == np.float32 else "array<double>").alias("e")).mapInArrow(kernel.releasing(run), f"vec_id {kind}, v binary")


class Tables:
    """The projections of all tables for vectors of one length; the same in every task."""

    def __init__(self, size: int, k: int, tables: int):
        rng = np.random.default_rng([20040608, size])
        self.k, self.tables, self.size = k, tables, size
        self.planes = rng.standard_normal((size, k * tables))
        self.shift = rng.random(k * tables) * WIDTH
        self.signs = np.random.default_rng([1995, size]).standard_normal((size, SIGNS))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) 64-bit bucket keys; the low ``TABLE_BITS`` are the table's number."""
        cell = np.floor((x @ self.planes + self.shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.k)
        h = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64) + np.uint64(self.size << 20), (len(x), self.tables)).copy()
        for j in range(self.k):
            h = kernel.mixed(h * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
        return h >> np.uint64(TABLE_BITS) << np.uint64(TABLE_BITS) | np.arange(self.tables, dtype=np.uint64)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """(vectors, 2) words of sign bits."""
        return np.packbits(x @ self.signs > 0, axis=1).view(np.uint64)

    @classmethod
    def cached(cls, size: int, k: int, tables: int) -> Tables:
        cache = kernel.worker_cache()
        if cache.get("tables", (None,))[0] != (size, k, tables):
            cache["tables"] = (size, k, tables), cls(size, k, tables)
        return cache["tables"][1]


def _by_length(column, element: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    raw = column.to_pylist()
    sizes = np.array([len(r) for r in raw], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(raw[i] for i in at), element).reshape(len(at), -1).astype(np.float64)
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(k: int, tables: int, element: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            for at, x in _by_length(batch.column(1), element):
                for i in range(0, len(at), 4096):
                    some = x[i : i + 4096]
                    t = Tables.cached(x.shape[1], k, tables)
                    bits = np.repeat(t.bits(some), tables, axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t.keys(some).view(np.int64).ravel()), pa.array(np.repeat(nodes[at[i : i + 4096]], tables)), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], ["key", "node", "bits_1", "bits_2"]
                    )

    return run


def _thinned(most: int):
    """Rows (key, node, bits) sorted by key -> (key, node, n) of members that another's bits are near, n of them in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.grouped_batches(batches, 1):
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            bits = np.stack([np.asarray(batch.column(c)) for c in (2, 3)], axis=1).view(np.uint64)
            first = groups.starts_of(batch, 1)
            size = np.diff(np.append(first, len(key)))
            keep, count = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
            two = first[size == 2]
            close = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64) <= most
            for s in (two[close], two[close] + 1):
                keep[s], count[s] = True, 2
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = slice(s, s + n)
                if n > THINNED:
                    keep[own], count[own] = True, n
                    continue
                b, hit = bits[own], np.zeros(n, bool)
                for i in range(0, n, 256):
                    d = np.bitwise_count(b[i : i + 256, None, 0] ^ b[None, :, 0]) + np.bitwise_count(b[i : i + 256, None, 1] ^ b[None, :, 1])
                    hit[i : i + 256] = (d <= most).sum(axis=1) > 1
                keep[own], count[own] = hit, hit.sum()
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(count[keep])], ["key", "node", "n"])

    return run


def _check(k: int, tables: int, element: type, threshold: float, pairs: bool):
    """Rows (key, i, j, side, node, copies, v) sorted by (key, i, j) -> links of nodes and joining edges, or the pairs."""

    def group(x, keys, table, i, j, side, ids, many):
        n, cross = len(x), i[0] != j[0]
        links, labels = np.zeros(n, np.int64), np.arange(n)
        left, right = [], []
        for a in range(0, n, 512):
            c = x[a : a + 512] @ x.T
            near = c >= threshold
            near[np.arange(len(near)), a + np.arange(len(near))] = False
            if cross:
                near &= side[a : a + 512, None] != side[None, :]
            p, q = np.nonzero(near)
            if len(p) and table:  # a pair counts in the first table that holds both
                new = np.ones(len(p), bool)
                for u in range(table):
                    new &= keys[a + p, u] != keys[q, u]
                p, q = p[new], q[new]
            if pairs:
                up = ids[a + p] < ids[q]
                yield ids[a + p][up], ids[q][up], c[p[up], q[up]]
            left.append(a + p)
            right.append(q)
        p, q = np.concatenate(left), np.concatenate(right)
        if pairs or not len(p):
            return
        np.add.at(links, p, many[q])
        while True:  # least labels along the links; then one edge from each member to its label's
            low = labels.copy()
            np.minimum.at(low, p, labels[q])
            np.minimum.at(low, q, labels[p])
            low = low[low]
            if (low == labels).all():
                break
            labels = low
        hit = np.flatnonzero(links)
        yield ids[hit], ids[labels[hit]], links[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.grouped_batches(batches, 3, 1 << 13):
            kept: list = []
            whole = [np.asarray(batch.column(c)) for c in range(6)]
            for at, x in _by_length(batch.column(6), element):
                columns = [c[at] for c in whole]
                t = Tables.cached(x.shape[1], k, tables)
                keys = t.keys(x)
                new = np.ones(len(at), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
                first = np.flatnonzero(new)
                tables_of = columns[0][first] & ((1 << TABLE_BITS) - 1)
                for s, z, table in zip(first.tolist(), [*first[1:].tolist(), len(at)], tables_of.tolist(), strict=True):
                    if z - s > 1:
                        kept += group(x[s:z], keys[s:z], table, *(c[s:z] for c in columns[1:]))
            columns = [np.concatenate([x[c] for x in kept]) if kept else np.zeros(0, np.int64) for c in range(3)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(float))], ["a", "b", "cosine"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "to", "links"])

    return run


def _nodes(table: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows: row, vec_id, v; nodes: node, copies, v; number of nodes). A node is a distinct vector, named by its least row."""
    rows = written(directed_vectors(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    nodes = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "nodes")
    return rows, nodes, nodes.count()


def _checked(nodes: DataFrame, count: int, element: type, threshold: float, recall: float, pairs: bool = False) -> DataFrame:
    k, tables = parameters(count, threshold, recall)
    buckets = nodes.select("node", "v").mapInArrow(kernel.releasing(_keys(k, tables, element)), "key long, node long, bits_1 long, bits_2 long")
    members = buckets.repartition("key").sortWithinPartitions("key").mapInArrow(kernel.releasing(_thinned(bits_apart(threshold))), "key long, node long, n long")
    members = groups.blocked(members, F.col("n"), "node").join(nodes, "node").select("key", "block_i", "block_j", "block_side", "node", "copies", "v")
    members = members.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")
    return members.mapInArrow(kernel.releasing(_check(k, tables, element, threshold, pairs)), "a long, b long, cosine double" if pairs else "node long, to long, links long")


def near_links(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, class_id, links) of every row: see the module's text."""
    rows, nodes, count = _nodes(table)
    found = written(_checked(nodes, count, _element(table), threshold, recall), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    parts = written(parts, "parts")
    linked = nodes.where("copies = 1").join(links.join(parts, "node", "left"), "node").select(F.col("node").alias("row"), F.col("node"), "links", "component")
    own = rows.join(linked, "row").select("row", "vec_id", F.coalesce("component", "node").alias("component"), "links")
    # rows whose vector others hold too are told by the vector; the others are their own node
    several = nodes.where("copies > 1").select(F.col("v").alias("same"), F.col("node").alias("first"), "copies")
    if not several.isEmpty():
        placed = rows.where("v IS NOT NULL").join(several, F.col("v") == F.col("same")).select("row", "vec_id", "first", "copies")
        placed = placed.join(links, placed["first"] == links["node"], "left").drop("node").join(parts, F.col("first") == parts["node"], "left")
        own = own.unionByName(placed.select("row", "vec_id", F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    own = written(own, "linked")
    least = own.groupBy("component").agg(F.min("vec_id").alias("class_id"))
    told = own.join(least, "component").select("vec_id", "class_id", "links")
    alone = rows.join(own.select("row"), "row", "left_anti").select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return told.unionByName(alone)


def near_pairs(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_a, vec_b, cosine) between distinct vectors, each by its least row's id, vec_a < vec_b where they differ."""
    rows, nodes, count = _nodes(table)
    found = _checked(nodes, count, _element(table), threshold, recall, pairs=True)
    name = nodes.join(rows.select(F.col("row").alias("node"), "vec_id"), "node").select("node", "vec_id")
    out = found.join(name.select(F.col("node").alias("a"), F.col("vec_id").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("vec_id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), F.round("cosine", 6).alias("cosine"))


def planted(table: DataFrame) -> DataFrame:
    """``table`` and two more rows for every seventh id: a slightly turned copy, and a stretched one turned a little more."""
    turned = table.where("vec_id % 7 = 0")

    def copy(times: float, turn: float, offset: int) -> DataFrame:
        e = F.transform(F.col("embedding"), lambda x, i: (x.cast("double") * times + F.lit(turn) * ((F.col("vec_id") * 31 + i * 17) % 13 - 6)).cast("double"))
        return turned.select((F.col("vec_id") + offset).alias("vec_id"), e.alias("embedding"))

    base = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return base.unionByName(copy(1.0, 0.002, 1_000_000_000)).unionByName(copy(2.0, 0.008, 2_000_000_000))


_LINKS = """
e AS (SELECT a.r, a.vec_id AS x, b.r AS s, b.vec_id AS y FROM t a JOIN t b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= {threshold}),
c AS (SELECT r AS root, r AS s FROM t UNION SELECT c.root, e.s FROM c JOIN e ON e.r = c.s)
SELECT t.vec_id, (SELECT min(u.vec_id) FROM c JOIN t u ON u.r = c.s WHERE c.root = t.r) AS class_id, (SELECT count(*) FROM e WHERE e.r = t.r) AS links FROM t"""
_ROWS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_COPY = "SELECT vec_id + {offset}, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * {times} + {turn}::DOUBLE * ((vec_id * 31 + (i - 1) * 17) % 13 - 6)) FROM embeddings WHERE vec_id % 7 = 0"

ORACLE = f"WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, * FROM ({_ROWS}))," + _LINKS.format(threshold=THRESHOLD)
PLANTED_ORACLE = (
    f"WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, * FROM ({_ROWS} UNION ALL {_COPY.format(offset=1_000_000_000, times='1.0::DOUBLE', turn='0.002')} UNION ALL {_COPY.format(offset=2_000_000_000, times='2.0::DOUBLE', turn='0.008')})),"
    + _LINKS.format(threshold=THRESHOLD)
)
