"""Language identification by words first, backing off to shorter character n-grams.

Training: of the rows with a language label a bounded sample (``SAMPLE`` documents
a language, chosen by a hash of the id) gives, for each language, counts of words
(runs of Unicode letters and marks, in lower case) and of character n-grams, with ^
and $ as word marks. A word that occurs ``MIN_WORD`` times or more in some language is
known; each language scores it by its log frequency there. An unseen word is scored at
each of its positions by the longest n-gram (from ``LONGEST`` down to 1) that the model
knows, one that some language has ``MIN_GRAM`` times or more, and the mean over
positions, scaled by ``BACKOFF``, is its score. A document's score is the mean over its
words; all words of the whole text count, of any length.

A document is rejected (language ``und``) when it has no word, or when no n-gram
of two or more characters or known word speaks for any language, or the best two
languages are within ``MARGIN``. Defined cases: null and empty texts are rejected;
rows with null labels are never trained on; with no labelled row at all nothing
can be told and every document is rejected; repeated rows are judged alike; ties
fall to the language that sorts first, and are rejected by the margin; an empty
table gives an empty result; a table without ``lang`` has no labels; extra columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel

SAMPLE = 1000
MIN_WORD = 3
MIN_GRAM = 2
LONGEST = 5
BACKOFF = 1.0
MARGIN = 0.001


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word, n) counted over each block of a batch."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, which = langs.dictionary.to_pylist(), np.asarray(langs.indices)
        data, off = kernel.text_buffers(batch.column(1))
        for i, j in kernel.blocks(off):
            cp, o = kernel.characters(data[off[i] : off[j]], off[i : j + 1] - off[i])
            low, letter = kernel.lower_letters(cp)
            s, e, at = kernel.runs(letter, o)
            if not len(s):
                continue
            lang = np.repeat(which[i:j], np.diff(at)).astype(np.uint64)
            own = kernel.mixed(kernel.span_hashes(kernel.prefix_sums(low), s, e) + lang * np.uint64(kernel.BASE))
            _, first, n = np.unique(own, return_index=True, return_counts=True)
            words = [low[s[k] : e[k]].astype("<u4").tobytes().decode("utf-32-le", "replace") for k in first.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([names[int(k)] for k in lang[first].tolist()], pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: sorted hash tables with one row of log frequencies by language; bounded as the sample is."""
    if "lang" not in docs.columns:
        return {"langs": []}
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": []}
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    cut = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 40, -(-sample * (1 << 40) // n)))])[F.col("lang")]
    picked = labelled.where(at < cut).select("lang", "text")
    counted = picked.mapInArrow(kernel.releasing(_word_lists), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return build(list(zip(counted["lang"].to_pylist(), counted["word"].to_pylist(), counted["n"].to_pylist(), strict=True)))


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ^word$ after ^word$, and where each ends."""
    cp = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32)
    return cp, np.cumsum([len(w) + 2 for w in words], dtype=np.int64)


def build(counts: list[tuple[str, str, int]]) -> dict:
    """Model from (language, word, count)."""
    counts = [c for c in counts if c[1]]
    langs = sorted({c[0] for c in counts})
    place = {k: i for i, k in enumerate(langs)}
    lang = np.array([place[c[0]] for c in counts], np.int64)
    n = np.array([c[2] for c in counts], np.float64)

    def table(hashes: np.ndarray, lang: np.ndarray, n: np.ndarray, least: int, floor: float):
        keys, which = np.unique(hashes, return_inverse=True)
        seen = np.bincount(which * len(langs) + lang, n, len(keys) * len(langs)).reshape(-1, len(langs))
        total = seen.sum(axis=0)
        known = seen.max(axis=1, initial=0) >= least
        scores = np.log((seen[known] + floor) / (total + floor * max(1, known.sum())))
        return keys[known], scores.astype(np.float32)

    words = [c[1] for c in counts]
    plain = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    marked, stop = _marked(words)
    sizes = np.diff(stop, prepend=0)
    word, last = np.repeat(np.arange(len(words)), sizes), np.repeat(stop, sizes)
    sums, grams = kernel.prefix_sums(marked), [None]
    for size in range(1, LONGEST + 1):
        at = np.flatnonzero(np.arange(len(marked)) + size <= last)
        grams.append(table(kernel.span_hashes(sums, at, at + size), lang[word[at]], n[word[at]], MIN_GRAM, 0.5))
    return {"langs": langs, "words": table(kernel.span_hashes(kernel.prefix_sums(plain), starts, ends), lang, n, MIN_WORD, 0.1), "grams": grams}


def _backoff(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores of unseen words by language, and whether an n-gram of two or more characters was known."""
    marked, ends = _marked(words)
    return _backoff_of(marked, ends, model)


def _backoff_of(marked: np.ndarray, ends: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(ends, prepend=0)
    last = np.repeat(ends, sizes)
    sums, n = kernel.prefix_sums(marked), len(marked)
    out = np.zeros((n, len(model["langs"])), np.float32)
    told = np.zeros(n, bool)
    open_ = np.arange(n)
    for size in range(LONGEST, 0, -1):
        keys, scores = model["grams"][size]
        fits = open_[open_ + size <= last[open_]]
        hit = kernel.lookup(keys, kernel.span_hashes(sums, fits, fits + size))
        found = fits[hit >= 0]
        # shorter n-grams are commoner whatever the language: compare within languages only
        row = scores[hit[hit >= 0]]
        out[found] = row - row.mean(axis=1, keepdims=True)
        told[found] = size >= 2
        left = np.ones(n, bool)
        left[found] = False
        open_ = open_[left[open_]]
    starts = ends - sizes
    return np.add.reduceat(out, starts, axis=0) / sizes[:, None] * BACKOFF, np.logical_or.reduceat(told, starts)


def score_block(data: np.ndarray, off: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean scores by language, words, words with evidence) of each document."""
    low, letter = kernel.lower_letters((cp := kernel.characters(data, off))[0])
    s, e, at = kernel.runs(letter, cp[1])
    counts, n = np.diff(at), len(model["langs"])
    if not len(s):
        return np.zeros((len(counts), n)), counts, np.zeros(len(counts), np.int64)
    h = kernel.span_hashes(kernel.prefix_sums(low), s, e)
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    keys, table = model["words"]
    hit = kernel.lookup(keys, distinct)
    scores = np.zeros((len(distinct), n), np.float32)
    told = hit >= 0
    known = table[hit[told]]
    scores[told] = known - known.mean(axis=1, keepdims=True)
    unseen = np.flatnonzero(~told)
    if len(unseen):
        a, size = s[first[unseen]], (e - s)[first[unseen]]
        ends = np.cumsum(size + 2)
        marked = np.empty(ends[-1], np.uint32)
        marked[ends - size - 2], marked[ends - 1] = ord("^"), ord("$")
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(ends - size - 1, size) + inner] = low[np.repeat(a, size) + inner]
        scores[unseen], told[unseen] = _backoff_of(marked, ends, model)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.stack([np.bincount(doc, scores[which, k], len(counts)) for k in range(n)], axis=1)
    return total / np.maximum(counts, 1)[:, None], counts, np.bincount(doc, told[which], len(counts)).astype(np.int64)


def _judge(model: dict, data: np.ndarray, off: np.ndarray):
    """(language or 'und', lead over the next language) of each document of a batch."""
    names = np.array([*model["langs"], "und"], object)
    n = len(off) - 1
    best, lead = np.full(n, len(names) - 1), np.zeros(n)
    if len(names) > 1:
        for i, j in kernel.blocks(off):
            scores, _, told = score_block(data[off[i] : off[j]], off[i : j + 1] - off[i], model)
            top = scores.argmax(axis=1)
            ranked = np.sort(scores, axis=1)
            ahead = ranked[:, -1] - ranked[:, -2] if scores.shape[1] > 1 else np.full(j - i, np.inf)
            sure = (told > 0) & (ahead >= MARGIN)
            best[i:j] = np.where(sure, top, len(names) - 1)
            lead[i:j] = np.where(told > 0, ahead, 0.0)
    return names[best], lead


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, detected, lead, accepted) of every document."""
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as SAMPLE documents a language are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lead = _judge(shared.value, *kernel.text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.string()), pa.array(np.round(lead, 6)), pa.array((found != "und").tolist(), pa.bool_())], ["doc_id", "detected", "lead", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel.releasing(run), f"doc_id {kind}, detected string, lead double, accepted boolean")


def keep_identified(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` without those of no identifiable language; columns as they were."""
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = _judge(shared.value, *kernel.text_buffers(batch.column(at)))
            yield batch.filter(pa.array((found != "und").tolist(), pa.bool_()))

    return docs.mapInArrow(kernel.releasing(run), docs.schema)
