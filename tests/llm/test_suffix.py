import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import documents, table
from tessera.llm import suffix

SEQUENCE = st.lists(st.integers(0, 3), max_size=120).map(lambda x: np.array(x, np.int64))


@settings(max_examples=200, deadline=None)
@given(SEQUENCE)
def test_suffix_array_and_prefixes_equal_sorting(x):
    n = len(x)
    sa = suffix.suffix_array(x)
    assert sa.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())

    def common(a, b):
        k = 0
        while a + k < n and b + k < n and x[a + k] == x[b + k]:
            k += 1
        return k

    want = [0] * min(n, 1) + [common(sa[k - 1], sa[k]) for k in range(1, n)]
    assert suffix.common_prefixes(x, sa).tolist() == want


def test_long_runs_are_sorted():
    x = np.zeros(5000, np.int64)
    assert suffix.suffix_array(x).tolist() == list(range(4999, -1, -1))


def brute(rows, size):
    holders: dict = {}
    words = {i: t.split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            holders.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = set()
    for i, w in words.items():
        hit = [len(holders[tuple(w[k : k + size])]) > 1 for k in range(len(w) - size + 1)] + [False]
        start = None
        for k, h in enumerate(hit):
            if h and start is None:
                start = k
            if not h and start is not None:
                out.add((i, start, k - 1 + size))
                start = None
    return out


def found(df):
    return {(r.doc_id, r.start_word, r.end_word) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, " ".join(r.text.split())) for r in docs.collect()]
    want = brute(rows, suffix.PASSAGE)
    assert want and found(suffix.repeated_passages(docs)) == want


def test_any_number_of_shards_finds_the_same(spark):
    rng = random.Random(2)
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(5)) for _ in range(30)] for _ in range(5)]
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh") + str(rng.randrange(5)) for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(w))
            w[p:p] = rng.choice(shared)
        rows.append((i, " ".join(w)))
    want = brute(rows, 8)
    for size in (100, 2000, 1 << 20):
        assert found(suffix.repeated_passages(table(spark, rows), 8, size)) == want


def test_repetition_within_one_document_does_not_count(spark):
    w = " ".join(f"w{i}" for i in range(60))
    assert found(suffix.repeated_passages(table(spark, [(1, f"{w} {w}"), (2, "x")]))) == set()
    assert found(suffix.repeated_passages(table(spark, [(1, w), (1, w)]))) == set()


def test_equal_passages_have_equal_hashes(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = suffix.repeated_passages(table(spark, [(1, f"a {w}"), (2, f"{w} b")])).collect()
    assert len(rows) == 2 and len({r.passage_hash for r in rows}) == 1
