"""BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash over the bytes cuts texts into chunks whose borders depend on
nearby content alone, so a passage shared by documents yields the same chunks in
each of them. A chunk that occurs more than once in the corpus is encoded once,
in one document that holds it, and its tokens are joined back to every place it
occurs; the rest of a text is encoded in place. Chunk joins are then repaired:
the text around a join is encoded again between two places where a token must
begin (a white space after another character), and the window widens until it
meets token borders of the chunks on both sides, so that the tokens are exactly
those of encoding the whole text. Every result is decoded again and compared with
the text; where that should fail (a hash collision), the text is encoded whole.

The vocabulary file (``tiktoken`` ranks) is a parameter and is read by the driver;
its size is fixed. Defined cases: a null text gives null tokens, an empty one no
tokens; equal rows are encoded alike; texts of special tokens are ordinary text;
an empty table gives an empty result; extra columns are carried by
``encode_documents`` and dropped by ``encode``; a text that holds one chunk twice
reuses it as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from tessera.llm import kernel
from tessera.llm.kernel import fresh, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 32
MASK_BITS = 10
LEAST, MOST = 256, 8192

_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


class Vocabulary:
    """Encoder built once in each worker from the rank file's bytes."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    @classmethod
    def cached(cls, raw: bytes) -> Vocabulary:
        cache, key = kernel.worker_cache(), hashlib.sha256(raw).digest()
        if cache.get("vocabulary", (None,))[0] != key:
            cache["vocabulary"] = (key, cls(raw))
        return cache["vocabulary"][1]

    def encode(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(self.encoding._core_bpe.encode_to_tiktoken_buffer(raw.decode(), set()), np.uint32)

    def text(self, tokens: list | None) -> str | None:
        """The text of tokens, null where one is unknown."""
        if tokens is None or any(t is None or not 0 <= t < len(self.lengths) or not self.lengths[t] for t in tokens):
            return None
        return self.decode(tokens).decode(errors="replace")

    def decode(self, tokens) -> bytes:
        return self.encoding.decode_bytes(tokens.tolist() if isinstance(tokens, np.ndarray) else tokens)


def cuts(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Chunk borders of each document, relative to its start, 0 and its length included."""
    n = len(data)
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # h[i] covers the last ``step`` bytes; doubled each time
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h, step = g, step * 2
    at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    at = at[at < n]
    for _ in range(3):  # on to the start of a character
        inner = (data[np.minimum(at, n - 1)] & 0xC0) == 0x80
        at = np.where(inner, at + 1, at)
    where = np.searchsorted(at, off)
    out = []
    for d in range(len(off) - 1):
        a, z = int(off[d]), int(off[d + 1])
        borders, last = [0], 0
        for p in at[where[d] : where[d + 1]].tolist():
            p -= a
            if p - last < LEAST or p < WINDOW or p >= z - a:
                continue
            while p - last > MOST:
                last = _character(data, a + last + MOST, z) - a
                borders.append(last)
            if p - last >= LEAST:
                borders.append(p)
                last = p
        while z - a - last > MOST:
            last = _character(data, a + last + MOST, z) - a
            borders.append(last)
        if z - a > last:
            borders.append(z - a)
        out.append(borders)
    return out


def _character(data: np.ndarray, p: int, end: int) -> int:
    while p < end and (int(data[p]) & 0xC0) == 0x80:
        p += 1
    return p


def token_starts(data: np.ndarray) -> np.ndarray:
    """Places where a token begins whatever stands around: a white space after a character that is none.

    No alternative of the pattern has a white space after another character. The
    byte before must be ASCII, or end a two-byte letter, since wider characters
    and U+0085 and U+00A0 may be white space themselves."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(kernel.SPACE[data[1:]] & ~kernel.SPACE[data[:-1]]) + 1
    before = data[at - 1]
    two = data[np.maximum(at - 2, 0)]
    return at[(before < 0x80) | ((two >= 0xC3) & (two <= 0xDF))]


def assemble(raw: bytes, data: np.ndarray, shared: list[tuple[int, int, np.ndarray]], words: Vocabulary) -> np.ndarray:
    """Tokens of a whole text, given those of some of its chunks as (start, end, tokens)."""
    if not shared:
        return words.encode(raw)
    n = len(raw)
    pieces = []  # (start, end, tokens or None), in order, covering the text
    last = 0
    for a, z, tokens in sorted(shared, key=lambda c: c[0]):
        if a < last:
            continue
        if a > last:
            pieces.append((last, a, None))
        pieces.append((a, z, tokens))
        last = z
    if last < n:
        pieces.append((last, n, None))
    tokens = np.concatenate([words.encode(raw[a:z]) if t is None else t for a, z, t in pieces])
    ends = np.cumsum(words.lengths[tokens])  # where each token ends in the text
    hard = token_starts(data)

    def agrees(p: int) -> bool:
        """Whether a token of the chunks begins at byte p."""
        i = int(np.searchsorted(ends, p))
        return p == 0 or i < len(ends) and int(ends[i]) == p

    out, at = [], 0  # tokens for the text before ``at`` are settled
    i = 0
    joins = [z for _, z, _ in pieces[:-1]]
    while i < len(joins):
        join = joins[i]
        i += 1
        if join < at:
            continue
        right = int(np.searchsorted(hard, join, "right"))
        left = right - 1
        if left >= 0 and hard[left] == join:
            continue  # a token begins at the join whatever stands around
        while (lo := int(hard[left]) if left >= 0 else 0) > at and not agrees(lo):
            left -= 1
        lo = max(lo, at)
        while (hi := int(hard[right]) if right < len(hard) else n) < n and not agrees(hi):
            right += 1
        out.append(tokens[np.searchsorted(ends, at, "right") : np.searchsorted(ends, lo, "right")])
        out.append(words.encode(raw[lo:hi]))
        at = hi
    out.append(tokens[np.searchsorted(ends, at, "right") :])
    return np.concatenate(out)


# ------------------------------------------------------------------ on tables
def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        data, off = kernel.text_buffers(batch.column(1))
        keys = np.asarray(batch.column(0))
        for i, j in kernel.blocks(off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            raw = part.tobytes()
            key, start, size, digest, count = [], [], [], [], []
            _, first, copies = np.unique(keys[i:j], return_index=True, return_counts=True)
            times = dict(zip(first.tolist(), copies.tolist(), strict=True))  # copies of one text are cut once
            for d, borders in enumerate(cuts(part, o)):
                if d not in times:
                    continue
                a = int(o[d])
                for x, y in zip(borders[:-1], borders[1:], strict=True):
                    key.append(keys[i + d])
                    start.append(x)
                    size.append(y - x)
                    digest.append(xxhash.xxh3_128_digest(raw[a + x : a + y]))
                    count.append(times[d])
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(count, pa.int64())], ["digest", "k", "start", "size", "n"])


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype(np.uint16 if not len(tokens) or tokens.max() < 1 << 16 else np.uint32).tobytes()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, arranged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with tokens (array<int>), n_tokens and exact added (names lengthened on a clash).

    ``exact``: the tokens decode to the text byte for byte. ``arranged`` orders the rows
    (all columns of ``docs`` and more, which it keeps) right before they get their tokens,
    so that these need no shuffle; the result keeps that order."""
    spark, taken = docs.sparkSession, list(docs.columns)
    with open(vocabulary, "rb") as f:
        shared_words = spark.sparkContext.broadcast(f.read())  # a fixed file of under 2 MB
    k, owner, own, part_key, parts_name = (fresh(n, taken) for n in ("chunk_key", "chunk_owner", "chunk_own", "chunk_part_key", "chunk_parts"))
    keyed = docs.withColumn(k, F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")))
    cut = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("k"), "text").mapInArrow(kernel.releasing(_chunk_rows), "digest binary, k long, start int, size int, n long")
    # places are joined to their chunk, never collected by it: a chunk may stand in any number of documents
    chunks = written(cut.groupBy("digest", "k", "start", "size").agg(F.sum("n").alias("n")), "chunks")
    again = chunks.groupBy("digest").agg(F.min("k").alias("owner"), F.sum("n").alias("n")).where("n > 1").select("digest", "owner")
    places = written(chunks.drop("n").join(again, "digest"), "shared-chunks")
    owned = places.where("k = owner").groupBy("k", "digest").agg(F.min("start").alias("start"), F.min("size").alias("size"))
    owned = owned.groupBy(F.col("k").alias(owner)).agg(F.collect_list(F.struct("digest", "start", "size")).alias(own))
    width = len(keyed.columns)

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = Vocabulary.cached(shared_words.value), None
        for batch in batches:
            keys, texts, wanted = batch.column(width - 1).to_pylist(), batch.column(text_at).cast(pa.large_binary()), batch.column(width + 1).to_pylist()
            digests, tokens = [], []
            for i, key in enumerate(keys):
                if key == last:  # another copy of the same text
                    continue
                last = key
                raw = texts[i].as_py()
                for c in wanted[i]:
                    digests.append(c["digest"])
                    piece = raw[c["start"] : c["start"] + c["size"]]
                    try:
                        tokens.append(_pack(words.encode(piece)))
                    except UnicodeDecodeError:  # not this text's chunk: its key collides
                        digests.pop()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], ["digest", "tokens"])

    text_at = docs.columns.index("text")
    # both joins read one and the same shuffle of the documents
    once = keyed.join(owned, keyed[k] == owned[owner]).mapInArrow(kernel.releasing(encode_owned), "digest binary, tokens binary").dropDuplicates(["digest"])
    parts = places.select("digest", F.col("k").alias(part_key), "start", "size").join(once, "digest").select(part_key, F.struct("start", "size", "tokens").alias("part"))
    plan = parts.groupBy(part_key).agg(F.collect_list("part").alias(parts_name))
    names = [fresh(n, taken) for n in ("tokens", "n_tokens", "exact")]
    columns = [*docs.columns, *names]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.cached(shared_words.value)
        for batch in batches:
            data, off = kernel.text_buffers(batch.column(text_at))
            texts, parts = batch.column(text_at), batch.column(width + 1)
            lists, sizes, good = [], [0], []
            for i in range(batch.num_rows):
                if not texts[i].is_valid:
                    lists.append(np.zeros(0, np.uint32))
                    good.append(None)
                    sizes.append(sizes[-1])
                    continue
                part = data[off[i] : off[i + 1]]
                raw = part.tobytes()
                given = parts[i].as_py() or ()
                try:
                    known = [(c["start"], c["start"] + c["size"], t) for c in given if int(words.lengths[t := _unpack(c["tokens"], c["size"], words)].sum()) == c["size"]]
                    tokens = assemble(raw, part, known, words)
                    if given and words.decode(tokens) != raw:
                        tokens = words.encode(raw)
                except (UnicodeDecodeError, IndexError):
                    tokens = words.encode(raw)
                lists.append(tokens)
                good.append(words.decode(tokens) == raw)
                sizes.append(sizes[-1] + len(tokens))
            flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat), mask=pa.array([g is None for g in good], pa.bool_()))
            count = pa.array([None if g is None else len(x) for g, x in zip(good, lists, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: width - 1], column, count, pa.array(good, pa.bool_())], columns)

    schema = StructType([*docs.schema.fields, StructField(names[0], ArrayType(IntegerType())), StructField(names[1], LongType()), StructField(names[2], BooleanType())])
    rows = keyed.join(plan, keyed[k] == plan[part_key], "left")
    return (arranged(rows) if arranged else rows).mapInArrow(kernel.releasing(finish), schema)


def _unpack(packed: bytes, size: int, words: Vocabulary) -> np.ndarray:
    """Tokens of a chunk of ``size`` bytes; the width is told by which of the two adds up to it."""
    two = np.frombuffer(packed, np.uint16) if len(packed) % 2 == 0 else np.zeros(0, np.uint16)
    if len(two) and two.max() < len(words.lengths) and int(words.lengths[two].sum()) == size:
        return two.astype(np.uint32)
    return np.frombuffer(packed, np.uint32)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) of every document."""
    return encode_documents(docs.select("doc_id", "text"), vocabulary).select("doc_id", "tokens", "n_tokens", "exact")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give a null text.

    Tokens that are in no vocabulary, or null ones, make the text null; bytes that are no
    UTF-8 (tokens that cut a character) become U+FFFD."""
    with open(vocabulary, "rb") as f:
        shared_words = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.cached(shared_words.value)
        for batch in batches:
            text = [words.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "tokens").mapInArrow(kernel.releasing(run), f"doc_id {kind}, text string")
