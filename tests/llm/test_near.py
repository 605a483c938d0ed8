import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import documents, table
from tessera.llm import kernel, near


def pair_sets(texts):
    data, off = kernel.text_buffers(__import__("pyarrow").array(texts))
    x, at = near.shingles(data, off)
    return [set(x[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]


def components(edges):
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in root}


def test_groups_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = pair_sets([t for _, t in rows])
    sizes = [len(s) for s in sets]
    want, loose = [], []
    for i in range(len(rows)):
        for j in range(i):
            if min(sizes[i], sizes[j]) >= 0.4 * max(sizes[i], sizes[j]) and sizes[i]:
                both = len(sets[i] & sets[j])
                share = both / (sizes[i] + sizes[j] - both)
                want += [(rows[j][0], rows[i][0])] * (share >= near.THRESHOLD)
                loose += [(rows[j][0], rows[i][0])] * (share >= near.THRESHOLD - 0.12)
    got = {r.doc_id: r.best.doc_id for r in near.near_groups(near.signatures(docs)).collect()}
    found = sum(a in got and got.get(a) == got.get(b) for a, b in want)
    assert len(want) > 20 and found >= 0.95 * len(want)
    limit = components(loose)
    assert all(limit.get(n) == limit.get(c) for n, c in got.items() if n != c)


def test_estimates_follow_the_true_similarity():
    rng = random.Random(5)
    for share in (0.6, 0.8, 0.95):
        n = 4000
        common = [rng.getrandbits(32) for _ in range(int(n * 2 * share / (1 + share)))]
        sets = [np.array(common + [rng.getrandbits(32) for _ in range(n - len(common))], np.uint32) for _ in range(2)]
        _, m = near.minima(np.concatenate(sets), np.array([0, n, 2 * n]))
        a, b = near.sketches(m)
        assert abs(float(near.estimate(near._ones(a, b))) - share) < 0.12


def test_bands_reach_the_recall_at_the_threshold():
    assert 1 - (1 - near.THRESHOLD**near.ROWS) ** near.BANDS >= 0.9 and near.ROWS * near.BANDS <= near.SAMPLES


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 25))
def test_cluster_edges_join_what_all_pairs_join(seed, n):
    rng = np.random.default_rng(seed)
    sketch = rng.integers(0, 4, (n, 2), dtype=np.uint8)
    for most in (0, 1, 2):
        pairs = [(i, j) for i in range(n) for j in range(i) if near._ones(sketch[i], sketch[j]) <= most]
        edges = near.cluster_edges(np.arange(n), sketch, most)
        assert components(edges) == components(pairs) and len(edges) < n


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    base = [rng.choice("red blue green fast slow river hill stone wind".split()) + str(rng.randrange(90)) for _ in range(150)]
    rows = []
    for i in range(30):
        w = list(base)
        w[rng.randrange(150)] = f"new{i}"
        rows.append((100 - i, " ".join(w)))
    rows += [(i + 200, " ".join(f"x{i}y{k}" for k in range(50))) for i in range(10)]
    kept = sorted(r.doc_id for r in near.drop_near(table(spark, rows)).collect())
    assert kept == [71, *range(200, 210)]


def test_query_and_stage_agree(spark):
    docs = documents(spark)
    kept = sorted(r.doc_id for r in near.near_dedup(docs).where("NOT duplicate").collect())
    assert kept == sorted(r.doc_id for r in near.drop_near(docs).collect())


def test_buckets_cut_into_chunks_join_what_one_group_joins(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 4000")
    whole = sorted((r.doc_id, r.kept_id) for r in near.near_dedup(docs).collect())
    monkeypatch.setattr(near.groups.blocked, "__defaults__", (2,))
    assert sorted((r.doc_id, r.kept_id) for r in near.near_dedup(docs).collect()) == whole and any(a != b for a, b in whole)


def test_many_unlike_members_of_a_bucket():
    rng = np.random.default_rng(8)
    sketch = rng.integers(0, 256, (4000, near.BITS // 8), dtype=np.uint8)
    sketch[2000:] = sketch[:2000] ^ np.uint8(1)
    edges = near.cluster_edges(np.arange(4000), sketch, 200)
    assert sorted(map(tuple, map(sorted, edges))) == [(i, i + 2000) for i in range(2000)]


def test_ids_of_text_and_rows_of_one_id(spark):
    one = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([("b", one, "x"), ("a", one + " end", "x"), ("a", other, "x"), (None, one, "x"), (None, None, "x"), (None, None, "x")], "doc_id string, text string, source string")
    assert sorted((str(r.doc_id), str(r.kept_id), r.duplicate) for r in near.near_dedup(docs).collect()) == [("None", "None", False), ("None", "None", False), ("None", "a", True), ("a", "a", False), ("a", "a", False), ("b", "a", True)]
    assert sorted(str(r.text)[:2] for r in near.drop_near(docs).collect()) == ["No", "No", "v0", "w0"]
