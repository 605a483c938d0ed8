import math
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import documents, table
from tessera.llm import lang


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = lang.train(docs.where(half))
    rows = lang.identify(docs.where(~half).drop("lang"), model).join(docs.select("doc_id", "lang"), "doc_id").where("accepted").collect()
    assert len(rows) > 400
    assert sum(r.detected == r.lang for r in rows) >= 0.97 * len(rows)


def test_clean_documents_are_kept_and_noise_goes(spark):
    docs = documents(spark)
    noise = table(spark, [(-1, "12345 67890 !!! ---"), (-2, ""), (-3, None), (-4, "   "), (-5, "日本語 0 1")])
    both = docs.unionByName(noise.withColumn("lang", F.lit(None).cast("string")))
    kept = {r.doc_id for r in lang.keep_identified(both).collect()}
    assert not {-1, -2, -3, -4} & kept
    assert len(kept) >= 0.97 * docs.where("text rlike '[a-z]{3,}.*[a-z]{3,}'").count()


def bytes_of(words):
    data = " ".join(words).encode()
    return np.frombuffer(data, np.uint8), np.cumsum([0, *(len(w.encode()) + 1 for w in words)]) - np.array([0] * len(words) + [1])


def test_unseen_words_back_off_to_shorter_grams():
    model = lang.build([("en", "thinking", 9), ("en", "running", 9), ("es", "corazones", 9), ("es", "canciones", 9), ("ru", "\u0434\u0443\u043c\u0430\u0442\u044c", 9)])
    scores, words, told = lang.score_block(*bytes_of(["walking", "emociones", "\u201c\u0421\u041b\u0423\u0428\u0410\u0422\u042c\u201d"]), model)
    assert model["langs"] == ["en", "es", "ru"] and words.tolist() == told.tolist() == [1, 1, 1]
    assert scores.argmax(axis=1).tolist() == [0, 1, 2]


def test_words_of_any_length_count():
    long = "a" * 500
    model = lang.build([("x", long, 3), ("y", "b", 3)])
    assert lang.score_block(*bytes_of([long]), model)[0].argmax() == 0 and len(model["words"][0]) == 2


def test_backoff_equals_a_plain_loop():
    model = lang.build([("a", "abcdef", 5), ("a", "bcd", 1), ("b", "fedcba", 5), ("b", "xbcdx", 2), ("b", "\u044f\u0435\u0434", 2)])
    words = ["zabcz", "q", "bcdx", "fedq", "\u044f\u0435\u0434\u0430"]
    got, _ = lang._backoff(words, model)
    for w, row in zip(words, got, strict=True):
        marked, want = f"^{w}$", np.zeros(2)
        for i in range(len(marked)):
            for size in range(lang.LONGEST, 0, -1):
                if i + size > len(marked):
                    continue
                keys, scores = model["grams"][size]
                cp = np.frombuffer(marked[i : i + size].encode("utf-32-le"), np.uint32)
                k = int(lang.kernel.lookup(keys, lang.kernel.span_hashes(lang.kernel.prefix_sums(cp), np.array([0]), np.array([size])))[0])
                if k >= 0:
                    want += scores[k] - scores[k].mean()
                    break
        assert np.allclose(row, want / len(marked) * lang.BACKOFF, atol=1e-4)


def words_of(text):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in low).split()


def brute(rows):
    """(doc_id, language, lead) by dictionaries of strings alone."""
    langs = sorted({r[2] for r in rows if r[2] is not None})
    counts = {k: Counter() for k in langs}
    for _, text, k in rows:
        if k is not None and text is not None:
            counts[k].update(words_of(text))

    def table(by, least, floor):
        known = {w for k in langs for w, n in by[k].items() if n >= least}
        total = {k: sum(by[k].values()) for k in langs}
        out = {}
        for w in known:
            row = [math.log((by[k][w] + floor) / (total[k] + floor * len(known))) for k in langs]
            out[w] = [x - sum(row) / len(row) for x in row]
        return out

    words = table(counts, lang.MIN_WORD, 0.1)
    grams = {}
    for size in range(1, lang.LONGEST + 1):
        by = {k: Counter() for k in langs}
        for k in langs:
            for w, n in counts[k].items():
                for i in range(len(w) + 3 - size):
                    by[k][f"^{w}$"[i : i + size]] += n
        grams[size] = table(by, lang.MIN_GRAM, 0.5)
    for i, text, _ in rows:
        total, told, n = [0.0] * len(langs), False, 0
        for w in words_of(text or ""):
            n += 1
            if w in words:
                told, row = True, words[w]
            else:
                marked, row = f"^{w}$", [0.0] * len(langs)
                for a in range(len(marked)):
                    for size in range(min(lang.LONGEST, len(marked) - a), 0, -1):
                        if (g := grams[size].get(marked[a : a + size])) is not None:
                            told = told or size >= 2
                            row = [x + y / len(marked) for x, y in zip(row, g, strict=True)]
                            break
            total = [x + y for x, y in zip(total, row, strict=True)]
        first, second = sorted((x / max(n, 1) for x in total), reverse=True)[:2]
        best = max(range(len(langs)), key=lambda k: total[k])
        yield i, langs[best] if told and first - second >= lang.MARGIN else "und", first - second if told else 0.0


def test_query_equals_brute_force(spark):
    docs = documents(spark).select("doc_id", "text", "lang").unionByName(table(spark, [(-1, "\u041c\u043e\u0441\u043a\u0432\u0430 \u201chello\u201d \u2014 yes\u2026", None, "s"), (-2, "x" * 300, "en", "s"), (-3, None, "en", "s"), (-4, "", None, "s")]).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in lang.identify(docs).collect()}
    want = list(brute([(r.doc_id, r.text, r.lang) for r in docs.collect()]))
    assert len(got) == len(want)
    for i, found, lead in want:
        assert abs(got[i].lead - lead) < 1e-4 and (got[i].detected == found or abs(lead - lang.MARGIN) < 1e-4), i


def test_training_is_bounded_by_the_sample(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang")
    few = lang.train(docs, sample=100)
    assert few["langs"] == ["en"] and lang.train(docs.where("false")) == {"langs": []}
