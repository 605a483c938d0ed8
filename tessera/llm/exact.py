"""Exact dedup over a cuckoo-filter index of live digests.

Copies within one Arrow batch are folded before anything moves, so a text that
fills the corpus crosses the shuffle once a batch. What is left is shuffled once,
by its text's 64-bit digest, so equal texts meet in one bucket of the index (a shuffle
partition), in the digest's order. A cuckoo filter over the live digests alone says
what is there: an absent digest is new without further work, a hit is checked against
the bucket's content of that digest, byte for byte, so neither a fingerprint's nor a
digest's collision drops a document. Content is kept only while its digest is under
way, since the bucket is sorted: what stays in memory is two bytes a fingerprint and
eight a digest, from which an overflowing filter is made anew at twice the size.
Digests whose last copy is deleted leave the filter (``replay``).

Defined cases: the least doc_id of equal texts is kept (a null id sorts first);
rows with equal ids and texts are copies, of which one stays; a null text is
never a duplicate; empty texts equal one another; an empty table gives an empty
result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import fresh, releasing


class CuckooFilter:
    """Partial-key cuckoo filter: 4 fingerprints of 16 bits a bucket, the live digests stored for resizing.

    Digests are 64-bit numbers in arrays; one that is inserted twice stands in it twice."""

    WAYS, KICKS, FULL = 4, 200, 0.9

    def __init__(self, buckets: int = 256):
        self.resizes, self._turn = 0, 0
        self.keys, self.size = np.zeros(256, np.uint64), 0
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, self.WAYS), np.uint16)

    def _hop(self, mark):
        return mark * np.uint64(0x5BD1E995) & self.mask

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(digests >> np.uint64(48), np.uint64(1))
        one = digests & self.mask
        return mark.astype(np.uint16), one.astype(np.int64), (one ^ self._hop(mark)).astype(np.int64)

    def contains(self, digests) -> np.ndarray:
        mark, one, two = self._places(np.asarray(digests, np.uint64))
        return (self.slots[one] == mark[:, None]).any(axis=1) | (self.slots[two] == mark[:, None]).any(axis=1)

    def insert(self, digests) -> None:
        """Add digests. On overflow the table doubles and is filled again from the stored ones."""
        digests = np.asarray(digests, np.uint64)
        if self.size + len(digests) > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.size], np.zeros(max(self.size, len(digests)), np.uint64)])
        self.keys[self.size : self.size + len(digests)] = digests
        self.size += len(digests)
        new = digests
        while self.size > self.FULL * self.slots.size or not self._put(new):
            self.resizes += 1
            self._make(2 * len(self.slots))
            new = self.keys[: self.size]

    def _put(self, digests: np.ndarray) -> bool:
        mark, one, two = self._places(digests)
        left = np.arange(len(digests))
        for place in (one, two):
            for way in range(self.WAYS):
                free = np.flatnonzero(self.slots[place[left], way] == 0)
                bucket, first = np.unique(place[left[free]], return_index=True)  # one for each bucket
                self.slots[bucket, way] = mark[left[free[first]]]
                left = np.delete(left, free[first])
        return all(self._kick(int(mark[i]), int(two[i])) for i in left.tolist())

    def _kick(self, mark: int, place: int) -> bool:
        for _ in range(self.KICKS):
            self._turn = (self._turn + 1) % self.WAYS
            mark, self.slots[place, self._turn] = int(self.slots[place, self._turn]), mark
            place ^= mark * 0x5BD1E995 & int(self.mask)
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def delete(self, digest: int) -> bool:
        """Take out one fingerprint of a live digest, and the digest from those stored."""
        mark, one, two = self._places(np.array([digest], np.uint64))
        for place in (int(one[0]), int(two[0])):
            at = np.flatnonzero(self.slots[place] == mark[0])
            if len(at):
                self.slots[place, at[0]] = 0
                last = self.size - 1  # mostly the latest one, as a bucket is worked through in order
                held = np.array([last]) if last >= 0 and self.keys[last] == np.uint64(digest) else np.flatnonzero(self.keys[: self.size] == np.uint64(digest))
                if len(held):
                    self.size -= 1
                    self.keys[held[0]] = self.keys[self.size]
                return True
        return False


class Bucket:
    """One bucket of the index, which meets its rows in their digests' order.

    ``held``: the live contents of the digest under way, as [holder, text, copies]."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.digest: int | None = None
        self.held: list[list] = []
        self.false_hits = 0

    def judge(self, digests: np.ndarray, ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(whether each row's content was there before, the id that holds it). A null text is new and not kept."""
        n, texts = len(digests), texts.cast(pa.large_binary())
        rows = np.flatnonzero(np.asarray(texts.is_valid()))
        copy, holder, values = np.zeros(n, bool), np.arange(n), []
        if not len(rows):
            return copy, ids
        d = digests[rows]
        begins = np.ones(len(rows), bool)
        begins[1:] = d[1:] != d[:-1]
        begins[0] = self.digest is None or int(d[0]) != self.digest
        # a digest that begins has no content here yet: a hit is another one's fingerprint
        self.false_hits += int(self.filter.contains(d[begins]).sum())
        self.filter.insert(d[begins])
        more = np.flatnonzero(~begins)
        there = self.filter.contains(d[more])
        run, starts = np.cumsum(begins), np.flatnonzero(begins)

        def first_of(r: int) -> list[list]:
            at = int(rows[starts[r - 1]])
            return [[ids[at].as_py(), texts[at].as_py(), 1]]

        now, held = 0, self.held
        for k, hit in zip(more.tolist(), there.tolist(), strict=True):
            if run[k] != now:
                now, held = int(run[k]), first_of(int(run[k]))
            row = int(rows[k])
            text = texts[row].as_py()
            same = next((h for h in held if h[1] == text), None) if hit else None
            if same is None:
                held.append([ids[row].as_py(), text, 1])
            else:
                same[2] += 1
                copy[row], holder[row] = True, n + len(values)
                values.append(same[0])
        self.digest = int(d[-1])
        self.held = held if run[-1] == now else first_of(int(run[-1]))
        return copy, pa.concat_arrays([ids, pa.array(values, ids.type)]).take(pa.array(holder))

    def _turn_to(self, digest: int) -> bool:
        """Whether the filter holds the digest, whose contents are now under way."""
        if digest != self.digest:
            self.digest, self.held = digest, []
        hit = bool(self.filter.contains([digest])[0])
        self.false_hits += hit and not self.held
        return hit

    def insert(self, digest: int, doc_id, text: bytes):
        """The id that holds this content already, else ``doc_id`` itself, which then holds it; and whether it was new."""
        same = next((h for h in self.held if h[1] == text), None) if self._turn_to(digest) else None
        if same is not None:
            same[2] += 1
            return same[0], False
        if not self.held:  # a digest stands in the filter once, whatever contents share it
            self.filter.insert([digest])
        self.held.append([doc_id, text, 1])
        return doc_id, True

    def delete(self, digest: int, text: bytes) -> bool:
        """Forget one copy of a content; with its last copy the digest leaves the filter."""
        same = next((h for h in self.held if h[1] == text), None) if self._turn_to(digest) else None
        if same is None:
            return False
        same[2] -= 1
        if not same[2]:
            self.held.remove(same)
            if not self.held:
                self.filter.delete(digest)
        return True


def _digests(batch: pa.RecordBatch) -> np.ndarray:
    """The digests, which are the last column."""
    return np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64)


def _bucketed(df: DataFrame, text: str, order: list) -> tuple[DataFrame, str]:
    """Rows by their text's digest, in its order, as the last column."""
    key = fresh("bucket_key", df.columns)
    keyed = df.withColumn(key, F.xxhash64(F.col(f"`{text}`"), F.when(F.col(f"`{text}`").isNull(), F.col(order[0]))))
    return keyed.repartition(key).sortWithinPartitions(key, *order), key


def _sorted(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows by text and id, null ids first; where a new text begins). A null text begins anew each time.

    Within one batch copies are told by the bytes themselves."""
    number = pc.dictionary_encode(texts.cast(pa.large_binary())).indices
    n = len(ids)
    order = np.asarray(pc.sort_indices(ids, null_placement="at_start")).astype(np.int64)
    which = np.asarray(pc.fill_null(number, -1)).astype(np.int64)
    order = order[np.argsort(which[order], kind="stable")]
    new = np.ones(n, bool)
    held = which[order]
    new[1:] = (held[1:] != held[:-1]) | (held[1:] < 0)
    return order, new


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, first, ids): the ids of each text of a batch, in order, so that a copied text is sent once a batch."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        order, new = _sorted(ids, texts)
        first = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(ids)]]), pa.int32()), ids.take(pa.array(order)))
        leads = pa.array(order[first])
        yield pa.RecordBatch.from_arrays([texts.take(leads), ids.take(leads), lists], ["text", "first", "ids"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id, duplicate) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_gather, f"text string, first {kind}, ids array<{kind}>")
    rows, _ = _bucketed(sent, "text", ["first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket()
        for batch in batches:
            first, ids = batch.column(1), batch.column(2)
            again, kept = bucket.judge(_digests(batch), first, batch.column(0))
            sizes = np.asarray(pc.list_value_length(ids)).astype(np.int64)
            copy = np.ones(int(sizes.sum()), bool)
            copy[np.cumsum(sizes) - sizes] = again
            yield pa.RecordBatch.from_arrays([ids.flatten(), kept.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(copy)], ["doc_id", "kept_id", "duplicate"])

    return rows.mapInArrow(releasing(run), f"doc_id {kind}, kept_id {kind}, duplicate boolean")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the later copies of any text; columns as they were."""
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies within a batch go before anything is sent."""
        for batch in batches:
            order, new = _sorted(batch.column(id_at), batch.column(text_at))
            yield batch.take(pa.array(np.sort(order[new])))

    rows, key = _bucketed(docs.mapInArrow(first_of_batch, docs.schema), "text", ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket()
        for batch in batches:
            again, _ = bucket.judge(_digests(batch), batch.column(id_at), batch.column(text_at))
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(~again))

    return rows.mapInArrow(releasing(run), docs.schema)


def replay(log: DataFrame) -> DataFrame:
    """Apply a log of (seq, op, doc_id, text), op 'insert' or 'delete', to an empty index.

    Gives (seq, op, doc_id, holder_id, applied): of an insertion whether the
    content was new and who holds it, of a deletion whether the content was live.
    A null text or another op is not applied."""
    rows, _ = _bucketed(log.select("seq", "op", "doc_id", "text"), "text", ["seq"])
    schema = rows.select("seq", "op", "doc_id", F.col("doc_id").alias("holder_id"), F.lit(True).alias("applied")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket()
        for batch in batches:
            ops, ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()
            holder, applied = [], []
            for op, i, t, d in zip(ops, ids, texts, _digests(batch).tolist(), strict=True):
                h, a = (None, False) if t is None or op not in ("insert", "delete") else bucket.insert(d, i, t) if op == "insert" else (None, bucket.delete(d, t))
                holder.append(h)
                applied.append(a)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(holder, batch.column(2).type), pa.array(applied, pa.bool_())], ["seq", "op", "doc_id", "holder_id", "applied"])

    return rows.mapInArrow(releasing(run), schema)


ORACLE = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE first_value(doc_id) OVER w END AS kept_id,
       text IS NOT NULL AND row_number() OVER w > 1 AS duplicate
FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS FIRST)
"""


def log_of(docs: DataFrame) -> DataFrame:
    """Every document inserted by its id's order, and every third one's text deleted right after."""
    rows = docs.select((F.col("doc_id") * 2).alias("seq"), F.lit("insert").alias("op"), "doc_id", "text")
    gone = docs.where("doc_id % 3 = 0").select((F.col("doc_id") * 2 + 1).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("long").alias("doc_id"), "text")
    return rows.unionByName(gone)


REPLAY_ORACLE = """
WITH l AS (SELECT doc_id * 2 AS seq, 'insert' AS op, doc_id, text, 1 AS d FROM documents
  UNION ALL SELECT doc_id * 2 + 1, 'delete', NULL, text, -1 FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY text ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
h AS (SELECT *, max(CASE WHEN op = 'insert' AND before = 0 THEN seq END) OVER (PARTITION BY text ORDER BY seq) AS since FROM c)
SELECT seq, op, doc_id, CASE WHEN op = 'insert' AND text IS NOT NULL THEN since // 2 END AS holder_id,
       text IS NOT NULL AND CASE op WHEN 'insert' THEN before = 0 ELSE before > 0 END AS applied FROM h
"""
