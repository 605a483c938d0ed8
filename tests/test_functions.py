import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import canonical
from tessera.functions import text as T


def test_normalize_agrees_with_python(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x100), *range(0x2010, 0x2028)]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [T.normalize_python(t) for t in texts]


def test_normalize_all_covers_other_scripts(spark):
    values = ["ﬁn İstanbul", "ΣΑΣ — x", "a_b  C", "Ⅳ", "Ｆｕｌｌ　１２", "", "x\0y", "Straße", "①½", "日本語、テスト"]
    lists = [values, values[2:3], [], ["a", ""], ["plain", "Text!"]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>").select("i", T.normalize_all(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [[T.normalize_python(x) for x in v] for v in lists]
    row = rows[0]
    assert unicodedata.normalize("NFKC", "Ⅳ").casefold() in row["n"][3]


def test_null_texts_stay_null(spark):
    df = spark.createDataFrame([(None, ["a", None, "Ⅳ"]), ("Ⅳ", None)], "t string, v array<string>")
    rows = df.select(T.normalize(F.col("t")).alias("t"), T.normalize_all(F.col("v")).alias("v")).collect()
    assert [tuple(r) for r in rows] == [(None, ["a", None, "iv"]), ("iv", None)]


def test_lcs_length_and_places(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))], [rng.choice("abcd") for _ in range(rng.randint(0, 6))]) for _ in range(200)]

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _step(row, x, b)
        return row[-1]

    def _step(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = df.select("a", "b", T.lcs_length(F.col("a"), F.col("b")).alias("n"), T.lcs_places("a", "b").alias("p")).collect()
    def traced(e, a):
        n = [[0] * (len(a) + 1) for _ in range(len(e) + 1)]
        for i, x in enumerate(e):
            for j, y in enumerate(a):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])

        def walk(i, j):
            if not i or not j:
                return []
            if e[i - 1] == a[j - 1]:
                return [*walk(i - 1, j - 1), i - 1]
            return walk(i - 1, j) if n[i - 1][j] >= n[i][j - 1] else walk(i, j - 1)

        return walk(len(e), len(a))

    for r in got:
        assert r["n"] == length(r["a"], r["b"]) == len(r["p"])
        assert r["p"] == traced(r["a"], r["b"])
        rest = iter(r["b"])
        assert all(r["a"][i] in rest for i in r["p"])


def test_unique_coverage_and_phrases(spark):
    df = spark.createDataFrame([(["Stop!", "stop", "", "Go on"], ["go ON", "x"], "they go on. Stop")], "e array<string>, a array<string>, t string")
    df = df.withColumns({"ne": T.normalize_all(F.col("e")), "na": T.normalize_all(F.col("a"))})
    keys = T.unique_keys(F.col("ne"), F.col("e"))
    found = T.held(keys, F.col("na"))
    row = df.select(T.texts(keys).alias("u"), T.texts(found).alias("m"), T.share(found, keys).alias("s"), T.texts(T.phrases_in(keys, T.normalize(F.col("t")))).alias("p")).first()
    assert (row["u"], row["m"], row["s"], row["p"]) == (["Stop!", "Go on"], ["Go on"], 0.5, ["Stop!", "Go on"])


def test_slug_strip_and_numbers(spark):
    df = spark.createDataFrame([("  Rule 7(A) ", 0.5), (" -- ", 1.0), ("x", 1 / 3)], "s string, n double")
    values = [0.0, 1.0, 1 / 3, 1 / 12, 1 / 1024, 73 / 256, 0.5, 2 / 3, 0.0123456789, 0.000123456, 1.5e-05, 0.1, 0.09999999, 1 / 7000]
    short = spark.createDataFrame([(v,) for v in values], "n double").select(T.short_number(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in short] == [f"{v:.6g}" for v in values]
    with pytest.raises(Exception, match="no letter or digit"):
        spark.createDataFrame([("--",)], "s string").select(T.required_slug(F.col("s"))).collect()
    rows = df.select(T.slug(F.col("s"), "r-").alias("s"), T.short_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("r-rule-7-a", "0.5"), (None, "1"), ("r-x", f"{1 / 3:.6g}")]


def test_similarity(spark):
    row = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(T.similarity("a", "b").alias("r")).first()
    assert row["r"] == pytest.approx(0.75)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=8))
def test_canonical_json_is_stable(value):
    import json

    text = canonical.canonical(value)
    assert json.loads(text) == value
    assert canonical.canonical(json.loads(text)) == text


def test_canonical_sorts_sets_and_refuses_nan():
    assert canonical.canonical({"b": {3, 1}, "a": 1e-05}) == '{"a":1e-05,"b":[1,3]}'
    with pytest.raises(ValueError):
        canonical.canonical(float("nan"))


def test_strip_leaves_separators_that_are_not_white_space(spark):
    texts = [" \t\n\x0b\f\r", "", " a b \r\n", "  a  ", "\u0085 a \u0085", " a ", None, "x" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [None if t is None else t.strip(" \t\n\x0b\f\r") for t in texts]


def test_first_words_are_those_of_the_normal_form(spark):
    texts = ["", "...", "one", " -One_  TWO, three", "Ⅳ ﬁn drei", "a\nb", "straße", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.first_words(F.col("t"), 2).alias("w")).collect()
    assert [r["w"] for r in rows] == [None if t is None else T.normalize_python(t).split()[:2] for t in texts]


def test_normal_forms_with_and_without_known_items(spark):
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("stop", "Stop!"), ("look", "look"))])
    rows = spark.createDataFrame([(["Stop!", "stop!", "LOOK", "", None, "Ⅳ"],), ([],)], "v array<string>").select(T.normal_forms(F.col("v"), known).alias("n")).collect()
    assert [r["n"] for r in rows] == [["stop", "stop", "look", "", None, "iv"], []]


def test_phrases_are_found_wherever_they_stand(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), "\n".join(words), " ".join(words[:15]) + "\n" + " ".join(words[15:]), ". ".join(words), "", "W0-W1", "w1 w0", " ".join(["w9"] * 30) + " Ｗ0"]
    phrases = ["w0 w1", "w14 w15", "w15 w16", "w39", "w0", "w4"]
    expected = F.array(*[F.struct(F.lit(p).alias("k"), F.lit(p).alias("v")) for p in phrases])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.texts(T.phrases_in_text(expected, F.col("t"))).alias("found")).collect()
    assert [r["found"] for r in rows] == [[p for p in phrases if f" {p} " in f" {T.normalize_python(t)} "] for t in texts]
