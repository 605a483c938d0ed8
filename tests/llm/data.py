"""Small tables for the tests of this folder."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use themselves
CLASHES = "duplicate kept_id bucket_key chunk_key tokens exact mix_s mix_r mix_position slot shard id k near_node near_component text_ first ids owner".split()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns of clashing names."""
    words = random.Random(3)
    long = " ".join(words.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60_000))
    one = "the same short text about rivers and hills " * 3
    rows = [
        (1, one, "en", "a"), (1, one, "en", "a"), (2, one, "en", "a"), (3, "", "fr", "b"), (4, "", "fr", None), (5, None, "fr", "b"), (6, None, None, None),
        (None, one, "en", "a"), (None, None, None, None), (None, "", "de", "b"), (7, long, "en", "a"), (8, long + " end", "en", None), (9, "   \n\t ", "es", "b"), (10, "x", None, "a"),
        (11, "\u0000\U0001f600 ßé 　 z\u0085z", "de", "c"), (12, "<|endoftext|> ' '  ", "de", "c"),
    ]
    df = table(spark, rows)
    for c in CLASHES:
        df = df.selectExpr("*", f"concat('x', doc_id) AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
