"""Near dedup: MinHash bands find candidates, odd sketches verify them.

A document is the set of its word pairs (lower case; runs of letters and digits).
``SAMPLES`` minima of multiply-shift hashes sample that set. The odd sketch
(Mitzenmacher, Pagh and Pham, 2014) keeps, for each of ``BITS`` cells, the parity
of the samples that fall there; the XOR of two sketches has about
BITS/2 * (1 - exp(-4*SAMPLES*(1-J)/BITS)) ones, so its population count
estimates the Jaccard similarity J. Bands of ``ROWS`` samples propose candidates.

Cost follows the input, not the square of a group: documents with one and the
same sketch are folded first; buckets with the same members in several bands are
verified once; within a bucket each round of a breadth-first search looks only at
members not reached yet, so a tight group costs one row, and buckets beyond
``groups.LIMIT`` members are cut into chunks whose pairs go to tasks of their own.
What is found joins exactly the components that comparing all pairs of the bucket
would, with edges linear in its size. No bucket or group is capped, and none is
collected into a row.

Defined cases: a document without words, or with a null text, has no near copy and
stays; a one-word document is its word; rows are told apart by row, not by id, so rows
of one id are copies only if their texts are; of a group the row of the least doc_id
stays (null ids last, then the least hash of the text, then any one of equal rows); ids
may be of any ordered type; an empty table gives an empty result; extra columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import groups, kernel
from tessera.llm.kernel import fresh, written
from tessera.operators.graph import connected_components

SAMPLES = 256
BITS = 1024
ROWS = 4
BANDS = 40
THRESHOLD = 0.5

_RNG = np.random.default_rng(20140407)
_A = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_CELL = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def most_ones(threshold: float = THRESHOLD) -> int:
    """Greatest XOR population count whose estimate of J reaches the threshold."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - threshold) / BITS)))


def estimate(ones) -> np.ndarray:
    """Jaccard estimate from XOR population counts."""
    share = np.minimum(np.asarray(ones, float) * 2 / BITS, 1 - 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - share)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of word pairs, and their offsets by document."""
    low = kernel.lowered(data)
    s, e, words = kernel.spans(low, off, kernel.ALNUM)
    h = kernel.span_hashes(kernel.prefix_sums(low), s, e)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    pair = h.copy()
    pair[:-1] += h[1:] * np.uint64(0x9FB21C651E98DF25)
    counts = np.diff(words)
    drop = words[1:][counts >= 2] - 1  # a document's last word begins no pair, unless it is alone
    keep = np.ones(len(h), bool)
    keep[drop] = False
    alone = words[:-1][counts == 1]
    pair[alone] = h[alone]
    return (kernel.mixed(pair[keep]) >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(counts - (counts >= 2))])


def minima(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their SAMPLES minima)."""
    has = np.flatnonzero(np.diff(off) > 0)
    out = np.empty((SAMPLES, len(has)), np.uint32)
    if len(has):
        starts = off[has]
        buffer = np.empty_like(x)
        for k in range(SAMPLES):
            np.multiply(x, _A[k], out=buffer)
            buffer += _B[k]
            np.minimum.reduceat(buffer, starts, out=out[k])
    return has, out


def sketches(minimum: np.ndarray) -> np.ndarray:
    """Odd sketch of each column of minima, as BITS/8 bytes."""
    n = minimum.shape[1]
    cell = (kernel.mixed(minimum.astype(np.uint64) + _CELL[:, None]) >> np.uint64(40)).astype(np.int64) % BITS
    parity = np.bincount((cell + np.arange(n) * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(parity.reshape(n, BITS).astype(bool), axis=1)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    """(documents, BANDS) signed 64-bit keys; a key also holds its band's number."""
    keys = np.empty((minimum.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(minimum.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            h = kernel.mixed(h * np.uint64(0x9E3779B97F4A7C15) + minimum[b * ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, sketch, bands) of every row; sketch and bands are null without words."""
    for batch in batches:
        data, off = kernel.text_buffers(batch.column(2))
        for i, j in kernel.blocks(off):
            x, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            has, m = minima(x, at)
            none = np.ones(j - i, bool)
            none[has] = False
            ends = np.concatenate([[0], np.cumsum(~none)]).astype(np.int32)
            sketch, keys = sketches(m), band_keys(m)
            valid = pa.array(~none).buffers()[1]
            flat = pa.Array.from_buffers(pa.binary(), j - i, [valid, pa.py_buffer(ends * np.int32(BITS // 8)), pa.py_buffer(sketch.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(ends * np.int32(BANDS)), pa.array(keys.ravel(), pa.int64()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), flat, lists], ["doc_id", "text_hash", "sketch", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """(node, doc_id, text_hash, sketch, bands) of every document, written; ``node`` numbers its row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    signed = rows.mapInArrow(kernel.releasing(_sign), f"doc_id {kind}, text_hash long, sketch binary, bands array<long>")
    return written(signed.select(F.monotonically_increasing_id().alias("node"), "*"), "signatures")


def _ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def cluster_edges(ids: np.ndarray, sketch: np.ndarray, most: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the same components as all pairs within ``most`` ones (of different sides) do."""
    words = np.ascontiguousarray(sketch).view(np.uint64) if sketch.shape[1] % 8 == 0 else sketch

    def near(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        strip = max(1, (1 << 18) // len(rows))
        return np.concatenate([_ones(words[rows][:, None], words[columns[i : i + strip]][None]) <= most for i in range(0, len(columns), strip)], axis=1)

    a, b = groups.spanning(len(ids), near, side)
    return list(zip(ids[a].tolist(), ids[b].tolist(), strict=True))


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, i, j, side, id, sketch) sorted by (bucket, i, j)."""
        for batch in groups.grouped_batches(batches, 3):
            i_, j_, side, ids = (np.asarray(batch.column(c)) for c in (1, 2, 3, 4))
            sketch = np.frombuffer(batch.column(5).buffers()[2], np.uint8)
            o = np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :]
            sketch = sketch[o[0] : o[batch.num_rows]].reshape(-1, BITS // 8)
            first = groups.starts_of(batch, 3)
            size = np.diff(np.append(first, batch.num_rows))
            two = first[size == 2]
            two = two[(i_[two] == j_[two]) | (side[two] != side[two + 1])]
            words = sketch.view(np.uint64)
            ok = two[_ones(words[two], words[two + 1]) <= most]
            a, b = [ids[ok]], [ids[ok + 1]]
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                e = np.array(cluster_edges(ids[s : s + n], sketch[s : s + n], most, side[s : s + n] if i_[s] != j_[s] else None), np.int64).reshape(-1, 2)
                a.append(e[:, 0])
                b.append(e[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def near_edges(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of (node, sketch, bands), one row a sketch: edges whose components are the near-duplicate groups."""
    bands = reps.select("node", F.explode("bands").alias("key")).repartition("key")
    # a bucket is told by its size and two sums of its members' hashes: those with the same members in several bands are verified once
    told = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").bitwiseAND((1 << 40) - 1)).alias("s"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND((1 << 40) - 1)).alias("t")).where("n > 1")
    buckets = told.groupBy("n", "s", "t").agg(F.min("key").alias("key")).select("key", "n")
    members = groups.blocked(bands.join(buckets, "key"), F.col("n"), "node").join(reps.select("node", "sketch"), "node")
    members = members.select("key", "block_i", "block_j", "block_side", "node", "sketch").repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")
    return members.mapInArrow(kernel.releasing(_verify(most_ones(threshold))), "a long, b long").distinct()


def near_groups(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, doc_id, text_hash, best) of the documents that have a near copy; best: (absent, doc_id, text_hash, node) of the one that stays.

    No row holds a group's members, and the joins' other sides hold one row a group."""
    has = signed.where("sketch IS NOT NULL")
    # equal sketches have equal words, and fold on the map side: a row a task for a text that fills the corpus
    fold = written(has.groupBy("sketch").agg(F.min(F.struct("node", "bands")).alias("least"), F.count("*").alias("copies")), "folded")
    reps = fold.select(F.col("least.node").alias("node"), "sketch", F.col("least.bands").alias("bands"))
    parts = written(connected_components(near_edges(reps, threshold)).select("node", "component"), "components")
    copied = fold.where("copies > 1").select("sketch", F.col("least.node").alias("first"))
    copies = has.select("node", "doc_id", "text_hash", "sketch").join(copied, "sketch").select("node", "doc_id", "text_hash", "first")
    copies = copies.join(parts.withColumnRenamed("node", "rep"), F.col("first") == F.col("rep"), "left").select("node", "doc_id", "text_hash", F.coalesce("component", "first").alias("component"))
    lone = fold.where("copies = 1").select(F.col("least.node").alias("node")).join(parts, "node")
    linked = copies.unionByName(has.select("node", "doc_id", "text_hash").join(lone, "node").select("node", "doc_id", "text_hash", "component"))
    linked = written(linked, "linked")
    best = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash", "node")).alias("best"))
    return linked.join(best, "component").select("node", "doc_id", "text_hash", "best")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id, duplicate) of every document."""
    signed = signatures(docs)
    found = near_groups(signed, threshold).select("node", F.col("best.doc_id").alias("kept_id"), F.col("best.node").alias("best"))
    out = signed.select("node", "doc_id").join(found, "node", "left")
    return out.select("doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("kept_id")).alias("kept_id"), F.coalesce(F.col("best") != F.col("node"), F.lit(False)).alias("duplicate"))


def drop_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; columns as they were.

    Texts move once, by id and text, to meet what goes and so that equal rows meet."""
    taken = list(docs.columns)
    text, row = fresh("near_text", taken), fresh("near_row", taken)
    found = near_groups(signatures(docs), threshold)
    # a row's key: the hash of its text, and that of its id with it
    key = [F.col("text_hash").alias(text), F.xxhash64("doc_id", "text_hash").alias(row)]
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash"))
    gone = written(found.where(~stays).select(*key).distinct(), "gone")
    hashed = docs.withColumn(text, F.xxhash64("text")).withColumn(row, F.xxhash64("doc_id", text))
    left = hashed.join(gone, [text, row], "left_anti")
    again = written(found.where(stays).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(text, row, F.lit(True).alias(many := fresh("near_many", taken))), "again")
    if not again.isEmpty():  # rows that repeat an id and a text: one stays
        nth = F.row_number().over(Window.partitionBy(text, row).orderBy(F.lit(0)))
        left = left.join(again, [text, row], "left").withColumn(many, F.col(many) & (nth > 1)).where(F.coalesce(~F.col(many), F.lit(True)))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
