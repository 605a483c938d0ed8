import itertools
import math
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.data import table
from tessera.llm import toxicity

SF = "/root/testdata/sf0.1"


def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs, labels, half, toxicity.train(docs, labels.where(half))


def test_held_out_documents(spark):
    docs, labels, half, model = learned(spark)
    rows = toxicity.score(docs, model=model).join(labels.where(~half).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    hit = sum(r.toxic and r.truth == 1 for r in rows)
    assert hit >= 0.9 * sum(r.truth for r in rows)
    assert sum(r.toxic and r.truth == 0 for r in rows) <= 0.005 * len(rows)


def test_one_planted_insult_is_caught_plain_and_disguised(spark):
    docs, labels, half, model = learned(spark)
    clean = [r.text for r in docs.join(labels.where(~half).where("toxic = 0"), "doc_id").orderBy("doc_id").limit(60).collect()]
    insults = "stupid loser moron worthless scum clown pathetic disgusting idiot trash".split()
    disguise = [lambda w: w, str.upper, lambda w: w.replace("i", "1").replace("o", "0").replace("e", "3").replace("a", "4"), ".".join, " ".join, lambda w: w[:2] + w[2] * 4 + w[3:]]
    rows = []
    for i, text in enumerate(clean):
        words = text.split(" ")
        words.insert(len(words) // 2, disguise[i % 6](insults[i % 10]))
        rows.append((i, " ".join(words)))
    missed = [rows[r.doc_id][0] for r in toxicity.score(table(spark, rows), model=model).collect() if not r.toxic]
    assert len(missed) <= 3, [(disguise[i % 6](insults[i % 10])) for i in missed]


def test_viterbi_finds_the_cheapest_reading():
    words = [b"stupid", b"idiot", b"liar", b"great"]
    trigrams: dict = {}
    for w in words:
        m = b"^" + w + b"$"
        for i in range(len(m) - 2):
            trigrams[m[i : i + 3]] = trigrams.get(m[i : i + 3], 0) + 50
    channel = toxicity.Channel(trigrams)
    for token in ("stup1d", "1d10t", "l.i.a.r", "liaaaar", "gr3at", "s t u p i d"):
        best = (math.inf, b"")
        for path in itertools.product(*channel.lattice(token)):
            text, price = b"".join(t for t, _ in path), sum(p for _, p in path)
            context = b"^"
            for x in text + b"$":
                if len(context) == 2:
                    price += channel.cost(context, bytes((x,)))
                context = (context + bytes((x,)))[-2:]
            best = min(best, (price, text))
        assert channel.restore(token) == best[1]
    assert [channel.restore(t) for t in ("stup1d", "1d10t", "l.i.a.r", "gr3at")] == [b"stupid", b"idiot", b"liar", b"great"]


def test_disguised_words_score_like_plain_ones(spark):
    rows, labels = [], []
    for i in range(60):
        bad = i % 2
        rows.append((i, f"the garden {i} holds {'wretchedfool' if bad else 'flowers'} and a path", "en", "s"))
        labels.append((i, 1, bad))
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    test = table(spark, [(1, "you wretchedfool"), (2, "you wr3tch3df00l"), (3, "you w.r.e.t.c.h.e.d.f.o.o.l"), (4, "you wretchedfoooool"), (5, "you gardener, 3 paths, 2024-01-02, v1.2.3"), (6, "w r e t c h e d f o o l")])
    got = {r.doc_id: r.toxic for r in toxicity.score(test, model=model).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_stems_are_told_by_their_rate_not_by_repetition(spark):
    rows, labels, abc = [], [], lambda n: "".join(chr(97 + int(c)) for c in str(n))
    for i in range(80):
        bad = i % 4 == 0
        w = [f"zz{abc(k)}y{abc(i)}" for k in range(40)] + ([f"grobn{abc(k)}y{abc(i)}" for k in range(3)] if bad else ["grobnx"] * (i % 5 == 0))
        rows.append((i, " ".join(w), "xx", "s"))
        labels.append((i, 1, int(bad)))
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [int(k).to_bytes(8, "little")[:4] for k in model["stems"][0]] == [b"grob"]
    test = table(spark, [(1, "grobna grobnb grobnc " + " ".join(f"qq{abc(k)}" for k in range(40))), (2, "grobnx " * 50 + " ".join(f"qq{abc(k)}" for k in range(90)))])
    assert {r.doc_id: r.toxic for r in toxicity.score(test, model=model).collect()} == {1: True, 2: False}


def test_a_long_clean_text_hides_nothing(spark):
    docs, labels, half, model = learned(spark)
    clean = " ".join(r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where(half).limit(1).collect())
    toxic = toxicity.score(docs, model=model).where("toxic").join(docs, "doc_id").limit(1).collect()[0].text
    got = {r.doc_id: r.toxic for r in toxicity.score(table(spark, [(1, clean * 20), (2, clean * 20 + " " + toxic)]), model=model).collect()}
    assert got[2]


def test_trigrams_are_counted_over_all_documents(spark):
    texts = ["The GARDEN, the garden; a p4th", "zxqvyk Čaj été", "Zxqvyk " + "x" * 70, "", None, "1234", "“Москва” — yes…"]
    want: dict = {}
    for t in texts:
        for w in set("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()):
            m = b"^" + w.encode() + b"$"
            for i in range(len(m) - 2):
                want[m[i : i + 3]] = want.get(m[i : i + 3], 0) + 1
    docs = table(spark, list(enumerate(texts)))
    # only two documents are labelled
    model = toxicity.train(docs, spark.createDataFrame([(0, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int"))
    assert dict(model["trigrams"]) == want


def test_a_rare_insult_of_a_small_language_is_evidence(spark):
    rows, labels = [], []
    for i in range(2400):
        bad = i % 4 == 0
        rare = bad and i < 40  # 10 of 600 toxic documents, half of the toxic ones of their language
        rows.append((i, f"text {i} {'grobnicek' if rare else 'wretchedfool' if bad else 'flowers'} and a path", "xx" if bad and i < 80 else "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(3000 + i, f"text {i} and a path", "xx", "s") for i in range(40)]
    labels += [(3000 + i, 1, 0) for i in range(40)]
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    test = table(spark, [(1, "a grobnicek"), (2, "a gr0bn1c3k"), (3, "a path and text"), (4, "a wretchedfool")])
    assert {r.doc_id: r.toxic for r in toxicity.score(test, model=model).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_ordinary_text_is_not_restored(spark):
    docs, labels, half, model = learned(spark)
    rows = [(1, "a well-known state-of-the-art e-mail: don't hum mmm, it's 3 o'clock and/or half-past"), (2, "an 1d10t, a w0rthle55 one"), (3, "an i.d.i.o.t")]
    got = {r.doc_id: r.restored for r in toxicity.score(table(spark, rows), model=model).collect()}
    assert got[1] == 0 and got[2] == 2 and got[3] >= 1


# ------------------------------------------------- brute force, a character at a time
def lower(text):
    return "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) and len(c.lower()) == 1 else c for c in text or "")


def words_of(text):
    return "".join(c if c.isalpha() else " " for c in lower(text)).split()


def grams_of(text):
    flat = b" " + "".join(c if c.isalpha() else " " * len(c.encode()) for c in lower(text)).encode() + b" "
    return flat, {flat[i : i + toxicity.GRAM] for i in range(len(flat) - toxicity.GRAM + 1)}


def features_of(rows):
    counts: dict = {}
    for text, lang, toxic in rows:
        words, key = {w.encode() for w in words_of(text)}, (lang or "").encode() + b"\0"
        for k in [("w", w) for w in words] + [("g", g) for g in grams_of(text)[1]]:
            counts.setdefault(k, [0, 0, 0])[1 - toxic] += 1
        for k, n in [(("n", key), len(words)), *((("s", key + stem), n) for stem, n in Counter(w[: toxicity.STEM] for w in words if len(w) > toxicity.STEM).items())]:
            c = counts.setdefault(k, [0, 0, 0])
            c[1 - toxic] += n
            c[2] += toxic
    return [(*k, *c) for k, c in counts.items()]


def weight_of(text, words, grams):
    total = 0.0
    for w in words_of(text):
        raw = w.encode()
        marked = b" " + raw + b" "
        total += words[raw] if raw in words else max([0.0, *(grams.get(marked[i : i + toxicity.GRAM], 0.0) for i in range(len(marked) - toxicity.GRAM + 1))])
    return total


def suspicious(text):
    sign, separator = set("0123456789@$!|+("), set("._-*~^'`,/\\")
    tokens, at = [], 0
    low = lower(text)
    for t in "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in low).split(" "):
        if t:
            tokens.append((at, t))
        at += len(t) + 1
    for _, t in tokens:
        p = [" ", " ", *t, " ", " "]
        odd = any(
            c in sign and p[i + 1].isalpha() or c in separator and p[i + 1].isalpha() and p[i - 1].isalpha() or c.isalpha() and c == p[i - 1] == p[i - 2] and len(c.encode()) <= 2
            or c in sign and p[i - 1].isalpha() and (p[i + 1].isalpha() or p[i + 1] in sign)
            for i, c in enumerate(p) if 2 <= i < len(p) - 2
        )
        if odd and any(c.isalpha() for c in t):
            yield t
    single = [len(t) == 1 and (t.isalpha() and ord(t) < 0x80 or t in sign or 0xC0 <= ord(t) < 0x800) for _, t in tokens] + [False]
    run = 0
    for i, one in enumerate(single):
        if not one and run >= 3:
            yield low[tokens[i - run][0] : tokens[i - 1][0] + 1]
        run = run + 1 if one else 0


def test_query_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    planted = [(-1, "you st.u.pid 1d10t", "en", "s"), (-2, "l o s e r and «\u0418\u0434\u0438\u043e\u0442» \u0436\u0436\u0436\u0436\u0430", "en", "s"), (-3, None, None, None), (-4, "", "en", "s")]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(table(spark, planted))
    marks = {r.doc_id: r.toxic for r in labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}
    rows = docs.collect()
    seen: dict = {}
    for r in rows:
        if r.text is not None and marks.get(r.doc_id) is not None:
            old = seen.get(r.text, (None, 0))
            seen[r.text] = (min(x for x in (r.lang, old[0]) if x is not None), max(marks[r.doc_id], old[1]))
    sample = [(t, *v) for t, v in seen.items()]
    toxic = sum(x[2] for x in sample)
    clean = len(sample) - toxic
    trigrams = Counter(m[i : i + 3] for r in rows for w in set(words_of(r.text)) for m in [b"^" + w.encode() + b"$"] for i in range(len(m) - 2))
    wanted = [f for f in features_of(sample) if f[0] == "n" or f[2] >= toxicity.LEAST_TOXIC and f[2] * clean > 2 * f[3] * toxic]
    model = toxicity.build(wanted, toxic, clean, trigrams)
    mine = toxicity.train(docs, labels)
    for part in ("words", "grams"):
        assert (model[part][0] == mine[part][0]).all() and abs(model[part][1] - mine[part][1]).max(initial=0) < 1e-9
    words = {}
    for kind, key, a, b, _ in wanted:
        if kind == "w" and (k := int(toxicity.kernel.lookup(model["words"][0], toxicity.kernel.hash_words([key]))[0])) >= 0:
            words[key] = float(model["words"][1][k])
    grams = {int(g).to_bytes(8, "little")[: toxicity.GRAM]: float(w) for g, w in zip(*model["grams"], strict=True)}
    stems = {int(k).to_bytes(8, "little")[: toxicity.STEM]: tuple(r) for k, r in zip(*model["stems"], strict=True)}
    channel = toxicity.Channel(trigrams)
    got = {r.doc_id: r for r in toxicity.score(docs, model=mine).collect()}
    for r in rows:
        own = {w.encode() for w in words_of(r.text)}
        want = model["prior"] + weight_of(r.text, words, grams)
        want += max([0.0, *(sum(w[: toxicity.STEM] == k and len(w) > toxicity.STEM for w in own) * math.log(a / b) - len(own) * (a - b) for k, (a, b) in stems.items() if any(w[: toxicity.STEM] == k and len(w) > toxicity.STEM for w in own))])
        for token in suspicious(r.text):
            token = token.rstrip(".,;:!?\"'()")
            if (reading := channel.restore(token)) != token.encode():
                want += max(0.0, weight_of(reading.decode(errors="replace"), words, grams) - weight_of(token, words, grams))
        assert abs(got[r.doc_id].score - want) < 1e-5 and got[r.doc_id].toxic == (want > 0), (r.doc_id, got[r.doc_id].score, want)
