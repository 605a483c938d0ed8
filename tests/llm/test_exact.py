import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import SF, documents
from tests.oracle import assert_same
from tessera.llm import exact


def test_query_equals_sql(spark):
    assert_same(exact.exact_dedup(documents(spark)), exact.ORACLE, SF)


def test_kept_documents_are_the_first_of_each_text(spark):
    docs = documents(spark).repartition(7)
    kept = {r.doc_id for r in exact.drop_exact(docs).collect()}
    first: dict = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert kept == set(first.values())


def test_replay_equals_sql(spark):
    assert_same(exact.replay(exact.log_of(documents(spark))), exact.REPLAY_ORACLE, SF)


def test_filter_resizes_and_forgets():
    rng = np.random.default_rng(1)
    live = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    f = exact.CuckooFilter(buckets=2)
    for part in np.array_split(live, 7):
        f.insert(part)
    assert f.resizes > 0 and f.contains(live).all() and f.contains(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)).sum() < 20
    assert all(f.delete(int(d)) for d in live[:1000])
    assert f.contains(live[1000:]).all() and f.contains(live[:1000]).sum() < 50
    assert sorted(f.keys[: f.size].tolist()) == sorted(live[1000:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([None, "", "a", "b", "c"])), max_size=6), max_size=5))
def test_buckets_judge_like_a_dictionary(batches):
    # digests collide: a text's digest is given along, in order
    rows = sorted((d, i, t) for i, (d, t) in enumerate(x for b in batches for x in b))
    bucket, seen, at = exact.Bucket(), {}, 0
    for b in batches:
        part = rows[at : at + len(b)]
        at += len(b)
        if not part:
            continue
        copy, kept = bucket.judge(np.array([r[0] for r in part], np.uint64) << np.uint64(50), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.string()))
        for (d, i, t), c, k in zip(part, copy.tolist(), kept.to_pylist(), strict=True):
            first = i if t is None else seen.setdefault((d, t), i)
            assert (c, k) == (first != i, first)


def test_without_the_filter_copies_would_pass(monkeypatch):
    ids, texts = pa.array([1, 2]), pa.array(["a", "a"])
    assert exact.Bucket().judge(np.array([5, 5], np.uint64), ids, texts)[0].tolist() == [False, True]
    monkeypatch.setattr(exact.CuckooFilter, "contains", lambda self, d: np.zeros(len(d), bool))
    assert exact.Bucket().judge(np.array([5, 5], np.uint64), ids, texts)[0].tolist() == [False, False]


def test_colliding_digests_are_told_apart_by_content():
    bucket = exact.Bucket()
    assert bucket.insert(2, 1, b"aa") == (1, True) and bucket.insert(2, 2, b"bb") == (2, True) and bucket.insert(2, 3, b"aa") == (1, False)
    assert bucket.delete(2, b"aa") and bucket.delete(2, b"aa") and not bucket.delete(2, b"aa")
    assert bucket.insert(2, 4, b"bb") == (2, False) and bucket.insert(2, 5, b"aa") == (5, True)
    assert all(bucket.delete(2, t) for t in (b"bb", b"bb", b"aa")) and not bucket.filter.contains([2])[0] and not bucket.filter.size


def test_replay_of_a_log(spark):
    log = [(1, "insert", 10, "a"), (2, "insert", 11, "a"), (3, "delete", None, "a"), (4, "delete", None, "a"), (5, "delete", None, "a"), (6, "insert", 12, "a"), (7, "insert", 13, None), (8, "other", 14, "a")]
    rows = {r.seq: (r.holder_id, r.applied) for r in exact.replay(spark.createDataFrame(log, "seq long, op string, doc_id long, text string")).collect()}
    assert rows == {1: (10, True), 2: (10, False), 3: (None, True), 4: (None, True), 5: (None, False), 6: (12, True), 7: (None, False), 8: (None, False)}
