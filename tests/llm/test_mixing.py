import hashlib
import math
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.data import documents, table
from tessera.llm import mixing


@given(st.dictionaries(st.sampled_from("abcdefghij"), st.integers(1, 1000), min_size=1))
def test_every_prefix_is_within_one_block(weights):
    shares = mixing.integer_weights(weights, 50)
    plan, done = mixing.edf_period(shares), dict.fromkeys(shares, 0)
    assert len(plan) == sum(shares.values()) == 50 and min(shares.values()) > 0
    for t, k in enumerate(plan, 1):
        done[k] += 1
        assert all(abs(done[x] - Fraction(t * shares[x], len(plan))) < 1 for x in shares)
    assert done == shares


def test_more_sources_than_slots():
    shares = mixing.integer_weights({str(i): 1 + i % 3 for i in range(70)}, 50)
    assert sum(shares.values()) == 70 and sorted(mixing.edf_period(shares)) == sorted(shares)


def shares_of(weights, period):
    """Largest remainders, one slot at least, by plain fractions."""
    period, names = max(period, len(weights)), sorted(weights, key=lambda k: (k != "null", k))
    exact = {k: Fraction(weights[k]) * period / sum(map(Fraction, weights.values())) for k in names}
    out = {k: max(1, int(exact[k])) for k in names}
    while sum(out.values()) < period:
        out[max(names, key=lambda k: (exact[k] - out[k], -names.index(k)))] += 1
    while sum(out.values()) > period:
        out[max((k for k in names if out[k] > 1), key=lambda k: (out[k] - exact[k], -names.index(k)))] -= 1
    return out


def brute(rows, targets, block, period):
    """Positions by walking slot by slot: of the released blocks the one due first, sources without blocks leaving."""
    queues: dict = {}
    for i, source in rows:
        queues.setdefault("null" if source is None else f"={source}", []).append(i)
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    for q in queues.values():  # the order within a source: its hash bucket first, then the hash
        q.sort(key=lambda i: (int(digest(i)[:8], 16) % mixing.BUCKETS, digest(i)))
    wanted = {k: len(q) ** mixing.ALPHA for k, q in queues.items()} if targets is None else {f"={k}": v for k, v in targets.items() if f"={k}" in queues and v > 0}
    out, slot, taken = {}, 0, dict.fromkeys(queues, 0)
    while live := {k: v for k, v in wanted.items() if taken[k] < len(queues[k])}:
        shares = shares_of(live, period)
        names, t, had = sorted(live, key=lambda k: (k != "null", k)), 0, dict.fromkeys(live, 0)
        q = sum(shares.values())
        while True:
            free = [k for k in names if had[k] * q // shares[k] <= t]
            k = min(free, key=lambda k: (math.ceil(Fraction((had[k] + 1) * q, shares[k])), names.index(k)))
            if taken[k] >= len(queues[k]):
                break
            for r, i in enumerate(queues[k][taken[k] : taken[k] + block]):
                out[i] = slot * block + r
            had[k] += 1
            taken[k] += block
            t, slot = t + 1, slot + 1
        if targets is not None:
            break
    return out


@pytest.mark.parametrize("targets", [None, {"src0": 3, "src1": 1, "absent": 5, "src2": 0}])
def test_query_equals_walking_the_schedule(spark, targets):
    docs = documents(spark)
    rows = [(r.doc_id, r.source) for r in docs.collect()]
    got = {r.doc_id: r.mix_position for r in mixing.mix(docs, targets).collect()}
    want = brute(rows, targets, mixing.BLOCK, mixing.PERIOD)
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v is not None} == want


def test_stage_gives_the_mix_in_order(spark):
    docs = documents(spark)
    position = {r.doc_id: r.mix_position for r in mixing.mix_query(docs).collect()}
    got = [position[r.doc_id] for r in mixing.mixed_documents(docs).collect()]
    assert got == sorted(got) and len(got) == sum(p is not None for p in position.values())


def test_repeated_rows_have_places_of_their_own(spark):
    docs = table(spark, [(1, "x", "en", "a")] * 6 + [(2, "y", "en", None)] * 6)
    got = [r.mix_position for r in mixing.mix_query(docs).collect()]
    placed = [p for p in got if p is not None]
    assert len(placed) == len(set(placed)) and len(got) == 12


@given(st.dictionaries(st.sampled_from("abcdefghij"), st.integers(1, 300), min_size=1))
def test_segments_hold_every_block_within_one_of_their_weights(blocks):
    at, done = 0, dict.fromkeys(blocks, 0)
    for first, shares, plan, before, within in mixing.segments({k: n**mixing.ALPHA for k, n in blocks.items()}, blocks, 50):
        assert first == at and before == {k: done[k] for k in shares} and set(shares) == {k for k in blocks if done[k] < blocks[k]}
        q, had = sum(shares.values()), dict.fromkeys(shares, 0)
        for t in range(1, sum(within.values()) + 1):
            had[plan[(t - 1) % q]] += 1
            assert all(abs(had[k] - Fraction(t * shares[k], q)) < 1 for k in shares)
        assert had == within
        at += sum(within.values())
        done |= {k: done[k] + n for k, n in within.items()}
    assert done == blocks


def test_every_document_has_a_place_when_sources_run_dry(spark):
    sizes = {"one": 1, "few": 9, "some": 60, "hot": 900, None: 30}
    docs = table(spark, [(i * 10 + j, "x", "en", s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)])
    got = mixing.mix(docs).collect()
    places = [r.mix_position for r in got]
    assert len(got) == 1000 and None not in places and len(set(places)) == 1000
    blocks = {r.mix_position // mixing.BLOCK for r in got}
    assert blocks == set(range(sum(-(-n // mixing.BLOCK) for n in sizes.values())))
    assert sorted(r.doc_id for r in mixing.mixed_documents(docs).collect()) == sorted(r.doc_id for r in docs.collect())


def test_one_tiny_source_ends_nothing(spark):
    docs = documents(spark)
    many = docs.crossJoin(spark.range(16).withColumnRenamed("id", "copy")).selectExpr("doc_id * 100 + copy AS doc_id", "text", "lang", "source", "n_chars")
    one = table(spark, [(-1, "alone", "en", "a new source")])
    both = many.unionByName(one)
    rows = [(r.doc_id, r.source) for r in both.select("doc_id", "source").collect()]
    got = {r.doc_id: r.mix_position for r in mixing.mix_query(both).collect()}
    assert len(got) == len(rows) > 3000 and got == brute(rows, None, mixing.BLOCK, mixing.PERIOD)


def test_joins_without_broadcasts_give_the_same_mix(spark, monkeypatch):
    docs = documents(spark)
    want = sorted((r.doc_id, r.mix_position) for r in mixing.mix_query(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.mix_position) for r in mixing.mix_query(docs).collect()) == want


def test_a_table_without_sources_is_one_source(spark):
    docs = documents(spark).drop("source")
    got = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    assert sorted(got) == sorted(r.doc_id for r in docs.collect())
