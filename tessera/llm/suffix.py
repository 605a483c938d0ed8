"""Repeated passages by suffix arrays over words.

The corpus is spread over shards of about ``SHARD_BYTES``. Each shard's texts
become one sequence of words (a word is what stands between white space; its
symbol is its 64-bit hash's rank) with a border symbol of its own after every
text. Larsson-Sadakane refinement sorts its suffixes: groups of suffixes equal in
their first h words are split by the rank of what follows, h doubles, and only
unsorted groups are touched. Kasai's longest common prefixes follow from the
identity PLCP[i] >= PLCP[i-1] - 1: only where the preceding words differ is a
prefix compared (all those places at once, by doubling and binary search over
prefix hashes), elsewhere it is one less than before.

Suffixes that agree in ``PASSAGE`` words or more form a class of the shard.
Shards are merged by binary search: every shard lists its classes by a 64-bit
hash of those words, sorted and cut at fixed splitters; the lists of one range
are searched in each other, and a class that two shards hold is repeated. Back in
its shard a repeated class marks all its places, and adjoining places merge into
spans. What is sent is one number for each distinct class, packed; no list of
places, and no cap on a class's members.

Result: (doc_id, start_word, end_word, n_words, passage_hash) of each maximal
stretch of a document every ``PASSAGE``-word window of which also stands in
another document. Defined cases: null and empty texts, and texts of fewer words,
have no passage; repetition within one document alone does not count; rows that
share an id and a text are one document; rows with a null id are documents of
their own; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel

PASSAGE = 50
SHARD_BYTES = 6 << 20
SHARDS_A_RANGE = 4


# -------------------------------------------------------------- one sequence
def suffix_array(x: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence of non-negative integers (Larsson-Sadakane)."""
    n = len(x)
    if n < 2:
        return np.arange(n)
    values, x = np.unique(x, return_inverse=True)
    bits = max(1, int(len(values)).bit_length())
    h = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)  # the first h symbols, 0 beyond the end
    for k in range(h):
        key <<= bits
        key[: n - k] |= x[k:] + 1
    sa = np.argsort(key, kind="stable")
    start = np.ones(n, bool)
    start[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)  # a group's number is the place of its first member
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    open_ = np.flatnonzero(~(start & np.concatenate([start[1:], [True]])))
    while len(open_) and h < n:
        at = sa[open_]
        follow = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        group = rank[at]
        key = group * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
        h *= 2
    return sa


def common_prefixes(x: np.ndarray, sa: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Kasai's array: lcp[k] of the suffixes at places k - 1 and k of ``sa``; lcp[0] = 0."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)  # the suffix sorted just before each suffix
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)  # places whose value must be compared
    i = np.arange(1, n)
    b = before[1:]
    own[1:] = (b <= 0) | (x[i - 1] != x[np.maximum(b, 1) - 1])
    at = np.flatnonzero(own & (before >= 0))
    other = before[at]
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for step in range(4):  # most pairs part at once
        a, b = at[live] + step, other[live] + step
        ok = (a < n) & (b < n)
        ok &= x[np.minimum(a, n - 1)] == x[np.minimum(b, n - 1)]
        live = live[ok]
        length[live] = step + 1
    if len(live):
        sums = prefix_hashes(x) if sums is None else sums
        a, b = at[live], other[live]
        low, room = length[live], n - np.maximum(a, b)
        step = np.full(len(live), 4)
        high = room.copy()
        grow = np.arange(len(live))
        while len(grow):  # double while the prefixes agree
            to = np.minimum(low[grow] + step[grow], room[grow])
            same = equal(sums, a[grow], b[grow], to)
            high[grow[~same]] = to[~same] - 1
            low[grow[same]] = to[same]
            step[grow] *= 2
            grow = grow[same & (to < room[grow])]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = equal(sums, a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        length[live] = low
    whole = np.zeros(n, np.int64)  # value + place, carried on where it falls by one a step
    whole[at] = length + at
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    plcp = np.where(before >= 0, whole[last] - np.arange(n), 0)
    return np.concatenate([[0], plcp[sa[1:]]])


def prefix_hashes(x: np.ndarray) -> np.ndarray:
    up, _ = kernel._powers(len(x) + 1)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(kernel.mixed(x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=out[1:])
    return out


def window_hashes(sums: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    _, down = kernel._powers(len(sums))
    return kernel.mixed((sums[at + size] - sums[at]) * down[at])


def equal(sums: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    _, down = kernel._powers(len(sums))
    return (sums[a + size] - sums[a]) * down[a] == (sums[b + size] - sums[b]) * down[b]


# ------------------------------------------------------------------ one shard
class Shard:
    """Words of a shard's texts. Hashes of words are the same in all shards, so are window hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, passage: int):
        hashes, counts = [], []
        for i, j in kernel.blocks(off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, at = kernel.spans(part, o, kernel.NOT_SPACE)
            hashes.append(kernel.span_hashes(kernel.prefix_sums(part), s, e))
            counts.append(np.diff(at))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        left = self.starts[self.doc + 1] - np.arange(len(self.words)) if len(self.words) else np.zeros(0, np.int64)
        self.full = np.flatnonzero(left >= passage)  # places where a whole passage begins
        self.sums = prefix_hashes(self.words)
        self.passage = passage

    def windows(self) -> np.ndarray:
        return window_hashes(self.sums, self.full, self.passage)

    def classes(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each class of suffixes that agree in a passage, whether two documents hold it)."""
        n, docs = len(self.words), len(self.counts)
        if not len(self.full):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        _, symbol = np.unique(self.words, return_inverse=True)
        x = np.empty(n + docs, np.int64)  # every text ends in a border of its own
        x[np.arange(n) + self.doc] = symbol + docs
        x[self.starts[1:] + np.arange(docs)] = np.arange(docs)
        del symbol
        sa = suffix_array(x)
        group = np.cumsum(common_prefixes(x, sa) < self.passage, dtype=np.int32)
        del x
        word = np.full(n + docs, -1)
        word[np.arange(n) + self.doc] = np.arange(n)
        place = word[sa]
        whole = np.zeros(n, bool)
        whole[self.full] = True
        ok = (place >= 0) & whole[place]
        place, group = place[ok], group[ok]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        who = owner[self.doc[place]]
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        return window_hashes(self.sums, place[first], self.passage), several

    def spans(self, repeated: np.ndarray):
        """(document, first word, end, hash) of the stretches whose passages are all in ``repeated`` (sorted)."""
        hit = self.full[kernel.lookup(repeated, self.windows()) >= 0]
        if not len(hit):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        doc = self.doc[hit]
        new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(doc) != 0)])
        first, last = hit[new], hit[np.concatenate([new[1:], [True]])]
        d, end = self.doc[first], last + self.passage
        return d, first - self.starts[d], end - self.starts[d], window_hashes(self.sums, first, end - first)


def _pack(sorted_: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as byte planes of their differences: the high bytes of close numbers vanish."""
    gaps = np.diff(sorted_, prepend=np.uint64(0)).astype("<u8")
    width = 8 if not len(gaps) else max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(planes), 8), np.uint8)
    wide[:, :width] = planes
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


# ------------------------------------------------------------------ on tables
def repeated_passages(docs: DataFrame, passage: int = PASSAGE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, passage_hash): see the module's text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    ranges = -(-shards // SHARDS_A_RANGE)
    shift = 64 - max(0, (ranges - 1).bit_length())
    # copies of one row are one document, so they share a shard and an owner number
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", key.alias("owner")).withColumn("shard", F.pmod("owner", F.lit(shards)).cast("int"))

    def table_of(tables) -> tuple:
        table = pa.Table.from_batches(tables) if isinstance(tables, list) else tables
        data, off = kernel.text_buffers(table.column("text"))
        owner = np.asarray(table.column("owner").combine_chunks())
        return table, data, off, owner

    def lists(table: pa.Table) -> pa.Table:
        _, data, off, owner = table_of(table)
        h, several = Shard(data, off, passage).classes(owner)
        order = np.argsort(h)
        h, several = h[order], several[order]
        number = int(table.column("shard")[0].as_py())
        part, packed, here = [], [], []
        at = (h >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(h), np.int64)
        cut = np.searchsorted(at, np.arange((1 << (64 - shift)) + 1))
        for r in range(len(cut) - 1):
            a, z = cut[r], cut[r + 1]
            if z > a:
                part.append(r)
                packed.append(_pack(h[a:z]))
                here.append(np.packbits(several[a:z]).tobytes())
        return pa.table({"range": pa.array(part, pa.int32()), "shard": pa.array([number] * len(part), pa.int32()), "classes": pa.array(packed, pa.binary()), "several": pa.array(here, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        numbers = table.column("shard").to_pylist()
        runs = [_unpack(c) for c in table.column("classes").to_pylist()]
        seen = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(r)).astype(bool) for s, r in zip(table.column("several").to_pylist(), runs, strict=True)]
        whole = np.sort(np.concatenate(runs))
        twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
        shard, out = [], []
        for number, run, own in zip(numbers, runs, seen, strict=True):
            found = run[own | (kernel.lookup(twice, run) >= 0)]
            if len(found):
                shard.append(number)
                out.append(_pack(found))
        return pa.table({"shard": pa.array(shard, pa.int32()), "repeated": pa.array(out, pa.binary())})

    def mark(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind = texts.schema.field("doc_id").type
        if not texts.num_rows or not answers.num_rows:
            return pa.table({"doc_id": pa.array([], kind), "start_word": pa.array([], pa.int64()), "end_word": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "passage_hash": pa.array([], pa.int64())})
        table, data, off, _ = table_of(texts)
        repeated = np.sort(np.concatenate([_unpack(c) for c in answers.column("repeated").to_pylist()]))
        d, first, end, h = Shard(data, off, passage).spans(repeated)
        return pa.table({"doc_id": table.column("doc_id").take(pa.array(d)), "start_word": pa.array(first), "end_word": pa.array(end), "n_words": pa.array(end - first), "passage_hash": pa.array(h.view(np.int64))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.groupBy("shard").applyInArrow(lists, "range int, shard int, classes binary, several binary")
    answers = found.groupBy("range").applyInArrow(merge, "shard int, repeated binary")
    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(mark, f"doc_id {kind}, start_word long, end_word long, n_words long, passage_hash long")
