"""Toxicity with noisy-channel deobfuscation.

Training, on a bounded sample of labelled documents (``SAMPLE``, chosen by a hash
of the id): words and five-byte n-grams (a word's borders count as a byte) that
toxic documents hold significantly more often (G-squared of ``SIGNIFICANCE`` or
more) and far more often (log likelihood ratio of ``LEAST_WEIGHT`` or more), and
that ``LEAST_TOXIC`` of them hold, become evidence, weighted by that ratio; copies
of one text count once. A character trigram model is counted over all documents,
labelled or not: each word, whatever its length, counts once for every row it stands in.
Words are runs of Unicode letters; the n-grams and trigrams are of their UTF-8 bytes.

Scoring runs over whole texts. Tokens that may be disguised (digits or symbols
within letters, letters with separators between them, letters three or more times
in a row, runs of single letters) become a lattice of readings: a leet sign may be
any letter it stands for, a separator may vanish, a run of one letter may be one
or two. Viterbi decoding under the trigram model and the readings' costs picks the
likeliest restored word, which is scored like plain ones. A word's weight is that
of the word if it is evidence, else of its heaviest n-gram. Stems are told by their
rate: n of a document's N different words give n*log(r1/r0) - N*(r1-r0), the Poisson
log likelihood ratio, and its strongest stem counts if positive. A document's score
is the prior log odds plus its words' weights and its stem's, and it is toxic above
zero. Only evidence for toxicity counts, so a long clean text cannot hide an insult.

Defined cases: null and empty texts get the prior and are not toxic; labels that
are null or of unknown documents are not used, and of several labels of one
document the greatest counts; without both classes in the sample nothing is
toxic; repeated rows score alike; an empty table gives an empty result; extra
columns play no part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.kernel import written

SAMPLE = 20_000
SIGNIFICANCE = 24.0
LEAST_TOXIC = 3
LEAST_WEIGHT = 4.0
GRAM = 5
STEM = 4
STEM_RATIO = 8.0
STEM_SHARE = 0.75

LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SIGNS = np.zeros(256, bool)
SIGNS[list(b"0123456789@$!|+(")] = True
#: bytes of letters in lower case as 1, 2, ..., all others as 0: trigrams fit in a table of CODES**3
CODE = np.zeros(256, np.int64)
CODE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = np.arange(1, 155)
CODES = 155
SEPARATORS = np.zeros(256, bool)
SEPARATORS[list(b"._-*~^'`,/\\")] = True
_SIGN_BYTES = [k.encode() for k in LEET]
LEET_COST, KEEP_COST, DROP_COST, RUN_COST = 1.0, 6.0, 0.3, 0.7


# ------------------------------------------------------------------- features
def _padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case with a space before, between and after them, which bytes are letters', and the new offsets."""
    n = len(off) - 1
    text, mask = kernel.lower_bytes(data)
    low, letter = np.full(len(data) + n + 1, 32, np.uint8), np.zeros(len(data) + n + 1, bool)
    at = np.arange(len(data)) + np.repeat(np.arange(n) + 1, np.diff(off))
    low[at], letter[at] = text, mask
    return low, letter, off + np.arange(n + 1) + 1


def _grams(letters: np.ndarray) -> np.ndarray:
    """Packed n-gram of GRAM bytes at each place; other bytes than letters are spaces already."""
    n = len(letters) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = letters[:n].astype(np.uint64)
    for i in range(1, GRAM):
        out |= letters[i : n + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, toxic, clean, docs): in how many documents of each class a word or n-gram stands.

    Of stems (``s``) the different words are counted, by language, and in docs the toxic
    documents; ``n`` has a language's different words and toxic documents."""
    for batch in batches:
        labels = np.asarray(batch.column(0)).astype(bool)
        data, off = kernel.text_buffers(batch.column(1))
        langs = [x.encode() + b"\0" for x in batch.column(2).to_pylist()]
        for i, j in kernel.blocks(off):
            yield _counted(data[off[i] : off[j]], off[i : j + 1] - off[i], labels[i:j], langs[i:j])


def _distinct(own: np.ndarray, key: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each key, its toxic and clean documents), of the places that are the first of their key in a document (``own``)."""
    first = np.unique(own, return_index=True)[1]
    _, at, which = np.unique(key[first], return_index=True, return_inverse=True)
    bad = np.bincount(which, toxic[first], len(at)).astype(np.int64)
    return first[at], bad, np.bincount(which, minlength=len(at)) - bad


def _counted(data: np.ndarray, off: np.ndarray, toxic: np.ndarray, langs: list[bytes]) -> pa.RecordBatch:
    low, letter, o = _padded(data, off)
    s, e, at = kernel.runs(letter, o)
    doc = np.repeat(np.arange(len(toxic)), np.diff(at))
    spread = np.uint64(kernel.BASE)
    h = kernel.span_hashes(kernel.prefix_sums(low), s, e)
    own = kernel.mixed(h + doc.astype(np.uint64) * spread)
    raw = low.tobytes()
    place, bad, good = _distinct(own, h, toxic[doc].astype(float))
    keys = [raw[s[k] : e[k]] for k in place.tolist()]
    out = [(["w"] * len(keys), keys, bad, good, np.zeros(len(keys), np.int64))]
    grams = _grams(np.where(letter, low, np.uint8(32)))
    held = np.clip(np.searchsorted(o, np.arange(len(grams)) + 1, "right") - 1, 0, len(toxic) - 1)
    inside = np.arange(len(grams)) + GRAM <= o[held + 1]  # none spans two texts
    grams, held = grams[inside], held[inside]
    place, bad, good = _distinct(kernel.mixed(grams + held.astype(np.uint64) * spread), grams, toxic[held].astype(float))
    keys = [int(g).to_bytes(8, "little")[:GRAM] for g in grams[place].tolist()]
    out.append((["g"] * len(keys), keys, bad, good, np.zeros(len(keys), np.int64)))
    # stems: a document's different words, summed by language
    first = np.unique(own, return_index=True)[1]
    counts: dict = {}
    for k in range(len(toxic)):
        counts.setdefault(("n", langs[k]), [0, 0, 0])[2] += int(toxic[k])
    for k, n in zip(*(x.tolist() for x in np.unique(doc[first], return_counts=True)), strict=True):
        counts["n", langs[k]][1 - int(toxic[k])] += n
    long = first[e[first] - s[first] > STEM]
    stem = np.zeros(len(long), np.uint64)
    for i in range(STEM):
        stem |= low[s[long] + i].astype(np.uint64) << np.uint64(8 * i)
    pair = np.stack([doc[long].astype(np.uint64), stem], axis=1)
    for (k, g), n in zip(*(x.tolist() for x in np.unique(pair, axis=0, return_counts=True)), strict=True):
        c = counts.setdefault(("s", langs[k] + int(g).to_bytes(8, "little")[:STEM]), [0, 0, 0])
        c[1 - int(toxic[k])] += n
        c[2] += int(toxic[k])
    kinds = list(counts)
    out.append(([k[0] for k in kinds], [k[1] for k in kinds], *(np.array([counts[k][i] for k in kinds], np.int64) for i in range(3))))
    return pa.RecordBatch.from_arrays([pa.array(sum((x[0] for x in out), []), pa.string()), pa.array(sum((x[1] for x in out), []), pa.binary()), *(pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in (2, 3, 4))], ["kind", "key", "toxic", "clean", "docs"])


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of each character trigram, ^ and $ at a word's borders, over each text's different words."""
    table = np.zeros(CODES**3, np.int64)
    for batch in batches:
        data, off = kernel.text_buffers(batch.column(0))
        for i, j in kernel.blocks(off):
            low, letter, o = _padded(data[off[i] : off[j]], off[i : j + 1] - off[i])
            s, e, at = kernel.runs(letter, o)
            if not len(s):
                continue
            doc = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(at))
            own = kernel.mixed(kernel.span_hashes(kernel.prefix_sums(low), s, e) + doc * np.uint64(kernel.BASE))
            first = np.unique(own, return_index=True)[1]
            s, n = s[first], (e - s)[first]
            place = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
            code = np.where(letter, CODE[low], 0)
            np.add.at(table, (code[place - 1] * CODES + code[place]) * CODES + code[place + 1], 1)
    found = np.flatnonzero(table)
    byte = np.zeros(CODES, np.uint8)
    byte[CODE[CODE > 0]] = np.flatnonzero(CODE)
    a, b, c = found // CODES**2, found // CODES % CODES, found % CODES
    raw = np.stack([np.where(a > 0, byte[a], ord("^")), byte[b], np.where(c > 0, byte[c], ord("$"))], axis=1).astype(np.uint8).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 3] for i in range(0, len(raw), 3)], pa.binary()), pa.array(table[found])], ["key", "n"])


def evidence(a: float, b: float, toxic: int, clean: int) -> tuple[float, float]:
    """(G-squared, log likelihood ratio) of a feature that stands in a toxic and b clean documents."""
    n, k = toxic + clean, a + b
    g = 0.0
    for seen, size in ((a, toxic), (b, clean)):
        for x, share in ((seen, k / n), (size - seen, 1 - k / n)):
            if x > 0 and share > 0:
                g += 2 * x * math.log(x / (size * share))
    return g, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: evidence words and n-grams, the prior, and the trigram model."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    if not total:
        return {"classes": (0, 0)}
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < min(1 << 40, -(-sample * (1 << 40) // total)))
    # about ``sample`` ids whatever the input: a bounded broadcast
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", lang.alias("lang"), "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.min("lang").alias("lang"), F.first("text").alias("text")).select("toxic", "text", "lang")
    rows = written(rows, "labelled")
    counted = rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    classes = {r["toxic"] > 0: r["n"] for r in counted}
    toxic, clean = classes.get(True, 0), classes.get(False, 0)
    if not toxic or not clean:
        return {"classes": (toxic, clean)}
    summed = rows.mapInArrow(kernel.releasing(_features), "kind string, key binary, toxic long, clean long, docs long").groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")])
    # at least twice as common in toxic documents, whatever the classes' sizes
    more = (F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * clean > 2 * F.col("clean") * toxic)
    # words and n-grams below the least weight (with room for rounding) need not come here: ``build`` drops them
    heavy = (F.col("kind") == "s") | ((F.col("toxic") + 0.5) * (clean + 1) >= 0.99 * math.exp(LEAST_WEIGHT) * (toxic + 1) * (F.col("clean") + 0.5))
    wanted = (F.col("kind") == "n") | (more & heavy)
    features = [(r["kind"], bytes(r["key"]), r["toxic"], r["clean"], r["docs"]) for r in summed.where(wanted).collect()]
    # a table a task, so at most CODES**3 rows whatever the input
    letters = docs.select("text").where("text IS NOT NULL").mapInArrow(kernel.releasing(_trigrams), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return build(features, toxic, clean, {bytes(r["key"]): r["n"] for r in letters})


def stems_of(features: list[tuple]) -> dict[bytes, tuple[float, float]]:
    """Evidence stems and their rates (in toxic, in clean texts) among the different words of their language."""
    sizes = {key: (a, b, docs) for kind, key, a, b, docs in features if kind == "n"}
    out: dict = {}
    for kind, key, a, b, docs in sorted(f for f in features if f[0] == "s"):
        lang, stem = key[: key.index(0) + 1], key[key.index(0) + 1 :]
        words, others, texts = sizes[lang]
        r1, r0 = (a + 0.5) / (words + 1), (b + 2) / (others + 2)
        if docs < max(LEAST_TOXIC, STEM_SHARE * texts) or r1 < STEM_RATIO * r0 or evidence(min(a, words), min(b, others), max(words, 1), max(others, 1))[0] < SIGNIFICANCE:
            continue
        if stem not in out or r1 / r0 > out[stem][0] / out[stem][1]:
            out[stem] = r1, r0
    return out


def build(features: list[tuple[str, bytes, int, int, int]], toxic: int, clean: int, trigrams: dict[bytes, int]) -> dict:
    weighed: dict = {"w": [], "g": []}
    stems = stems_of(features)
    explained: dict = defaultdict(lambda: [0, 0])  # n-gram -> documents in which a listed word holds it
    for kind, key, a, b, _ in sorted(features, key=lambda x: x[0] != "w"):
        if kind not in weighed or kind == "w" and len(key) > STEM and key[:STEM] in stems:
            continue
        g, weight = evidence(a, b, toxic, clean)
        if g < SIGNIFICANCE or weight < LEAST_WEIGHT:
            continue
        if kind == "w":
            marked = b" " + key + b" "
            for gram in {marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)}:
                explained[gram][0] += a
                explained[gram][1] += b
        else:
            if b" " in key[1:-1]:
                continue  # it spans two words
            # an n-gram speaks for words that aren't listed: it must hold among those too
            more, less = max(0, a - explained[key][0]), max(0, b - explained[key][1])
            if less:
                g, weight = evidence(more, less, toxic, clean)
                if g < SIGNIFICANCE or weight < LEAST_WEIGHT:
                    continue
        weighed[kind].append((g, key, weight))
    best = {k: sorted(v, key=lambda x: x[1]) for k, v in weighed.items()}
    keys = kernel.hash_words([x[1] for x in best["w"]])
    order = np.argsort(keys)
    packed = np.array([int.from_bytes(x[1], "little") for x in best["g"]], np.uint64)
    by_gram = np.argsort(packed)
    return {
        "classes": (toxic, clean),
        "prior": math.log(toxic / clean),
        "words": (keys[order], np.array([x[2] for x in best["w"]], np.float64)[order]),
        "grams": (packed[by_gram], np.array([x[2] for x in best["g"]], np.float64)[by_gram]),
        "trigrams": trigrams,
        "stems": (np.array([int.from_bytes(k, "little") for k in stems], np.uint64), np.array(list(stems.values()), np.float64).reshape(-1, 2)),
    }


# ------------------------------------------------------------- noisy channel
class Channel:
    """Viterbi decoder of disguised words under a character trigram model."""

    def __init__(self, trigrams: dict[bytes, int]):
        self.three, self.two, self.one = defaultdict(int), defaultdict(int), defaultdict(int)
        for key, n in trigrams.items():
            self.three[key] += n
            self.two[key[:2]] += n
            self.one[key[1:2]] += n
        self.total = sum(self.one.values()) or 1
        self.after = defaultdict(int)
        for key, n in self.two.items():
            self.after[key[:1]] += n
        self.known: dict = {}
        self.words: dict = {}

    def cost(self, context: bytes, c: bytes) -> float:
        """Negative log probability of a byte after the two before it, interpolated down to one."""
        key = context + c
        found = self.known.get(key)
        if found is None:
            p3 = self.three[key] / self.two[context] if self.two[context] else 0.0
            p2 = self.two[key[1:]] / self.after[context[-1:]] if self.after[context[-1:]] else 0.0
            p1 = (self.one[c] + 0.1) / (self.total + 25.6)
            found = self.known[key] = -math.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1)
        return found

    @staticmethod
    def lattice(token: str) -> list[list[tuple[bytes, float]]]:
        out: list = []
        i, n = 0, len(token)
        while i < n:
            c = token[i]
            j = i
            while j < n and token[j] == c:
                j += 1
            run, raw = j - i, c.encode()
            if c.isalpha() and ord(c) < 0x2000:
                if run >= 3:
                    out.append([(raw, RUN_COST), (raw * 2, RUN_COST), (raw * min(run, 3), 2 * RUN_COST)])
                else:
                    out.append([(raw * run, 0.0)])
            elif c in LEET:
                for _ in range(run if run < 3 else 1):
                    out.append([*((x.encode(), LEET_COST) for x in LEET[c]), *(((b"", KEEP_COST / 2),) if c in "!|+(" else ()), (raw, KEEP_COST)])
            elif len(raw) == 1 and SEPARATORS[raw[0]] or c == " ":
                out.append([(b"", DROP_COST * run)])
            else:
                out.append([(raw * run, 0.0)])
            i = j
        return out

    def restore(self, token: str) -> bytes:
        """The likeliest reading of a lower-case token."""
        found = self.words.get(token)
        if found is not None:
            return found
        paths: dict = {b"^": (0.0, None)}  # last two bytes -> (cost, reading as a linked list)
        for choices in self.lattice(token):
            new: dict = {}
            for state, (cost, reading) in paths.items():
                for text, price in choices:
                    c, context = cost + price, state
                    for x in text:
                        b = bytes((x,))
                        if len(context) == 2:
                            c += self.cost(context, b)
                        context = (context + b)[-2:]
                    old = new.get(context)
                    if old is None or c < old[0]:
                        new[context] = (c, (reading, text))
            paths = new
        best = min(paths.items(), key=lambda p: (p[1][0] + (self.cost(p[0], b"$") if len(p[0]) == 2 else 0.0), p[0]))[1][1]
        parts = []
        while best is not None:
            parts.append(best[1])
            best = best[0]
        found = b"".join(reversed(parts))
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[token] = found
        return found


def suspects(low: np.ndarray, letter: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents) of stretches that may be disguised words."""
    s, e, at = kernel.spans(low, off, kernel.NOT_SPACE)
    if not len(s):
        return s, e, s
    sign = SIGNS[low]
    nxt = np.zeros(len(low), bool)
    nxt[:-1] = letter[1:]
    prev = np.zeros(len(low), bool)
    prev[1:] = letter[:-1]
    odd = sign & nxt  # a sign right before a letter
    odd |= SEPARATORS[low] & nxt & prev
    same = np.zeros(len(low), bool)
    if len(low) > 2:
        same[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] < 128)
        # wide letters repeat as pairs of bytes
        if len(low) > 5:
            pair = low[1:].astype(np.uint16) << 8 | low[:-1]
            same[5:] |= (low[5:] >= 128) & (pair[4:] == pair[2:-2]) & (pair[2:-2] == pair[:-4])
    # a sign right after a letter, with more letters or signs behind it
    odd[1:] |= sign[1:] & letter[:-1] & np.concatenate([(letter | sign)[2:], [False]])
    total = np.concatenate([[0], np.cumsum(odd | same)])
    count = np.concatenate([[0], np.cumsum(letter)])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    odd_word = (total[e] > total[s]) & (count[e] > count[s])
    # runs of three or more tokens of one letter or sign each
    wide = (e - s == 2) & (low[s] >= 0xC3) & (low[s] < 0xE0)
    single = ((e - s == 1) & (letter[s] | sign[s])) | wide
    first = single & ~np.concatenate([[False], single[:-1] & (doc[:-1] == doc[1:])])
    last = single & ~np.concatenate([single[1:] & (doc[:-1] == doc[1:]), [False]])
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    long = z - a >= 2
    return np.concatenate([s[odd_word], s[a[long]]]), np.concatenate([e[odd_word], e[z[long]]]), np.concatenate([doc[odd_word], doc[a[long]]])


# --------------------------------------------------------------------- scores
def _weights(low: np.ndarray, letter: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Summed word weights of each of the ``_padded`` texts."""
    n = len(off) - 1
    s, e, at = kernel.runs(letter, np.array([0, len(low)]))
    if not len(s):
        return np.zeros(n)
    words, grams = model["words"], model["grams"]
    weight = np.zeros(len(s))
    if len(grams[0]):
        packed = _grams(np.where(letter, low, np.uint8(32)))
        spread = np.uint64(0x9E3779B97F4A7C15)
        maybe = np.zeros(1 << 16, bool)
        maybe[(grams[0] * spread) >> np.uint64(48)] = True
        place = np.flatnonzero(maybe[(packed * spread) >> np.uint64(48)])
        hit = kernel.lookup(grams[0], packed[place])
        place, hit = place[hit >= 0], hit[hit >= 0]
        word = np.searchsorted(s, place + 1, "right") - 1
        inside = (word >= 0) & (place >= s[word] - 1) & (place + GRAM <= e[word] + 1)
        np.maximum.at(weight, word[inside], grams[1][hit[inside]])
    if len(words[0]):
        hit = kernel.lookup(words[0], kernel.span_hashes(kernel.prefix_sums(low), s, e))
        weight = np.where(hit >= 0, words[1][hit], weight)
    doc = np.searchsorted(off, s, "right") - 1
    return np.bincount(np.clip(doc, 0, n - 1), weight, n)


def _stem_scores(low: np.ndarray, letter: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Likelihood ratio of each text's strongest stem, 0 at least."""
    out = np.zeros(len(off) - 1)
    keys, rates = model["stems"]
    s, e, at = kernel.runs(letter, off)
    long = np.flatnonzero(e - s > STEM)
    if not len(keys) or not len(long):
        return out
    packed = np.zeros(len(long), np.uint64)
    for i in range(STEM):
        packed |= low[s[long] + i].astype(np.uint64) << np.uint64(8 * i)
    doc = np.repeat(np.arange(len(out)), np.diff(at))
    hits = [long[packed == k] for k in keys]
    sums = kernel.prefix_sums(low) if any(map(len, hits)) else None
    for hit, (r1, r0) in zip(hits, rates, strict=True):
        for d in np.unique(doc[hit]).tolist():
            own = hit[doc[hit] == d]
            n = len(np.unique(kernel.span_hashes(sums, s[own], e[own])))
            words = len(np.unique(kernel.span_hashes(sums, s[at[d] : at[d + 1]], e[at[d] : at[d + 1]])))
            out[d] = max(out[d], n * math.log(r1 / r0) - words * (r1 - r0))
    return out


def signed(token: bytes, reading: bytes) -> bool:
    """Whether a sign of the token became a letter."""
    return sum(reading.count(c) for c in _SIGN_BYTES) < sum(token.count(c) for c in _SIGN_BYTES) and len(reading) > sum(chr(c).isalpha() for c in token if c < 128)


def score_texts(data: np.ndarray, off: np.ndarray, model: dict, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """(score, words restored) of each text of a block."""
    n = len(off) - 1
    low, letter = kernel.lower_bytes(data)
    score = model["prior"] + _weights(*_padded(data, off), model) + _stem_scores(low, letter, off, model)
    s, e, doc = suspects(low, letter, off)
    restored = np.zeros(n, np.int64)
    if len(s):
        raw = low.tobytes()
        texts, owner = [], []
        for a, z, d in zip(s.tolist(), e.tolist(), doc.tolist(), strict=True):
            token = raw[a:z].decode(errors="replace").rstrip(".,;:!?\"'()")
            found = channel.restore(token)
            if found != token.encode():
                texts.append((token.encode(), found))
                owner.append(d)
        if texts:
            d = np.array(owner)
            new, old = ([t[i] for t in texts] for i in (1, 0))
            gain = _listed(new, model) - _listed(old, model)  # what its plain reading has added is not added twice
            score += np.bincount(d, np.maximum(gain, 0), n)
            # a separator or a long run alone is no disguise: a sign read as a letter is, and so is a reading that tells
            restored = np.bincount(d, (gain > 0) | np.array([signed(o, r) for o, r in zip(old, new, strict=True)]), n).astype(np.int64)
    return score, restored


def _listed(words: list[bytes], model: dict) -> np.ndarray:
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return _weights(*_padded(np.frombuffer(b"".join(words), np.uint8), off), model)


def score(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """(doc_id, score, restored, toxic) of every document; ``restored`` counts its deobfuscated words."""
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as the sample and the table of trigrams are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        usable = min(known["classes"]) > 0
        cache = kernel.worker_cache()
        if usable and cache.get("channel", (None,))[0] is not known:  # one decoder a worker and model
            cache["channel"] = known, Channel(known["trigrams"])
        channel = cache["channel"][1] if usable else None
        for batch in batches:
            n = batch.num_rows
            points, restored = np.zeros(n), np.zeros(n, np.int64)
            data, off = kernel.text_buffers(batch.column(1))
            if usable:
                for i, j in kernel.blocks(off):
                    points[i:j], restored[i:j] = score_texts(data[off[i] : off[j]], off[i : j + 1] - off[i], known, channel)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(points, 6)), pa.array(restored), pa.array(usable & (points > 0))], ["doc_id", "score", "restored", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel.releasing(run), f"doc_id {kind}, score double, restored long, toxic boolean")
