"""Every operator on awkward and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import awkward, empty, table
from tessera.llm import bpe, exact, lang, mixing, near, secrets, sharding, suffix, toxicity, vectors

BY_ROW = {
    "sharding": sharding.shard_documents,
    "bpe": bpe.encode,
    "exact": exact.exact_dedup,
    "mixing": mixing.mix_query,
    "lang": lang.identify,
    "near": near.near_dedup,
    "toxicity": lambda d: toxicity.score(d, d.sparkSession.createDataFrame([(1, 0, 0), (7, 1, 1), (None, 1, 1), (2, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_every_row_gets_one_answer(spark, name):
    docs = awkward(spark)
    out = BY_ROW[name](docs)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_table(spark, name):
    assert BY_ROW[name](empty(spark)).count() == 0


def test_table_operators_on_empty_tables(spark):
    assert suffix.repeated_passages(empty(spark)).count() == 0
    assert secrets.scan(empty(spark)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_pairs(none).count() == 0 and vectors.near_links(none).count() == 0


def test_stages_keep_columns_and_rows_of_awkward_tables(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.exceptAll(docs).count() == 0, name
        assert stage(spark, docs.where("false"), "").count() == 0, name


def test_encoding_keeps_columns(spark):
    docs = awkward(spark)
    out = bpe.encode_documents(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 3
    assert out.select(docs.columns).exceptAll(docs).count() == 0
    rows = bpe.encode(docs).collect()
    assert all((r.tokens is None) == (r.exact is None) for r in rows) and all(r.exact for r in rows if r.tokens is not None)


def test_exact_dedup_of_awkward_rows(spark):
    rows = exact.exact_dedup(awkward(spark)).collect()
    kept = sorted(str(r.doc_id) for r in rows if not r.duplicate)
    # of the three copies of one text and the null id, the null id sorts first; null texts stay; one empty text stays
    assert kept == sorted(map(str, [None, 5, 6, None, None, 7, 8, 9, 10, 11, 12]))


def test_near_dedup_of_awkward_rows(spark):
    rows = near.near_dedup(awkward(spark)).collect()
    by = {(r.doc_id, r.duplicate): r.kept_id for r in rows}
    assert by[1, False] == by[1, True] == by[2, True] == 1
    assert by[7, False] == by[8, True] == 7 and by[None, True] == 1
    assert sum(r.duplicate for r in rows) == 4


def test_suffix_dedup_of_awkward_rows(spark):
    rows = suffix.repeated_passages(awkward(spark)).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(7, 0, 60_000), (8, 0, 60_000)}


def test_vectors_of_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.001]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, key string, cosine string")
    assert [(r.vec_a, r.vec_b) for r in vectors.near_pairs(df).collect()] == [(1, 2)]
    got = sorted(((str(r.vec_id), r.class_id, r.links) for r in vectors.near_links(df).collect()), key=str)
    # both rows of id 1, the null id and id 2 are near one another
    assert got == sorted([("1", 1, 3), ("1", 1, 3), ("2", 1, 3), ("None", 1, 3), *((str(i), i, 0) for i in range(3, 11))], key=str)


def test_secrets_of_awkward_rows(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    docs = table(spark, [(1, f"{key} {key}", None, None), (1, f"{key} {key}", None, None), (None, key, "en", "a"), (2, None, None, "b"), (3, "", None, "b")]).withColumn("value", F.lit("v")).withColumn("match", F.lit("m"))
    rows = secrets.scan(docs).collect()
    assert len(rows) == 5 and {(r.kind, r.n_repositories, r.n_owners, r.verdict) for r in rows} == {("aws_access_key", 2, 2, "live")}


def test_ties_in_language_are_rejected(spark):
    docs = table(spark, [(i, "uno dos tres", x, "s") for i, x in enumerate(["a", "b"] * 4)])
    assert {r.detected for r in lang.identify(docs).collect()} == {"und"}


def test_one_label_class_marks_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.score(table(spark, [(1, "bad words"), (2, "good words")]), labels).collect())
