import numpy as np

from tests.llm.data import SF
from tests.oracle import assert_same
from tessera.llm import vectors


def test_queries_equal_sql(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert_same(vectors.near_links(table), vectors.ORACLE, SF)
    assert_same(vectors.near_links(vectors.planted(table)), vectors.PLANTED_ORACLE, SF)
    assert vectors.near_links(vectors.planted(table)).where("links > 0").count() > 100


def test_groups_cut_into_chunks_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((4, 32))
    x = np.concatenate([base[i % 4] + 0.02 * i / 60 * rng.standard_normal(32) * (i > 9) for i in range(60)]).reshape(60, 32)
    df = spark.createDataFrame([(f"v{i:02}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    whole = sorted(vectors.near_links(df).collect())
    assert [(r.class_id, r.links) for r in whole] == [(f"v{i % 4:02}", 14) for i in range(60)]
    monkeypatch.setattr(vectors.groups.blocked, "__defaults__", (3,))
    monkeypatch.setattr(vectors, "THINNED", 2)
    assert sorted(vectors.near_links(df).collect()) == whole


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 48))
    x = np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape), base[:50] + 0.31 * rng.standard_normal((50, 48))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= vectors.THRESHOLD, 1))
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    got = {(r.vec_a, r.vec_b) for r in vectors.near_pairs(df).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)
    links = np.bincount(np.array(sorted(want)).ravel(), minlength=len(x))
    found = {r.vec_id: r.links for r in vectors.near_links(df).collect()}
    assert all(found[i] <= links[i] for i in range(len(x))) and sum(found.values()) == 2 * len(got)


def test_parameters_keep_recall_at_any_size():
    for n in (10, 10**6, 10**12):
        k, tables = vectors.parameters(n)
        near = vectors.agreement(np.sqrt(2 - 2 * vectors.THRESHOLD))
        assert 1 - (1 - near**k) ** tables >= vectors.RECALL
        assert n * vectors.agreement(np.sqrt(2)) ** k <= vectors.BUCKET
