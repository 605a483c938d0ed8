from collections import Counter

import pytest

from tests.llm.data import SF, documents
from tests.oracle import assert_same
from tessera.llm import sharding


def test_query_equals_sql(spark):
    assert_same(sharding.shard_documents(documents(spark)), sharding.ORACLE, SF)


def test_rebalancing_moves_slots_only_and_levels_the_load(spark):
    weights = spark.range(sharding.SLOTS).selectExpr("CAST(id AS int) AS slot", "CASE WHEN id < 64 THEN 1000 ELSE 10 END AS n_bytes")
    old = sharding.initial_map(spark, 8)
    new = sharding.rebalance(old, weights, 8).collect()
    assert len({r.slot for r in new}) == sharding.SLOTS and {r.version for r in new} == {2}
    size = {r.slot: r.n_bytes for r in weights.collect()}
    load = [sum(size[r.slot] for r in new if r.shard == s) for s in range(8)]
    assert max(load) <= sum(size.values()) * 1.05 / 8 + max(size.values())
    before = {r.slot: r.shard for r in old.collect()}
    assert 0 < sum(before[r.slot] != r.shard for r in new) < sharding.SLOTS / 2


def test_versions_stay(spark, tmp_path):
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    store.save(sharding.initial_map(spark, 4), 1)
    assert store.edit(1, {0: 3, 4095: 0}) == 2
    one, two = ({r.slot: r.shard for r in store.load(v).collect()} for v in (1, 2))
    assert {s for s in one if one[s] != two[s]} == {0, 4095} and two[0] == 3
    with pytest.raises(Exception, match="(?i)exists"):
        store.save(sharding.initial_map(spark, 4), 1)


@pytest.mark.parametrize("heavy", [1000, 0])
def test_fewer_shards_leave_no_slot_on_a_removed_one(spark, heavy):
    weights = spark.range(sharding.SLOTS).selectExpr("CAST(id AS int) AS slot", f"CAST({heavy} AS long) AS n_bytes")
    old = sharding.initial_map(spark, 64)
    rows = sharding.rebalance(old, weights, 32).collect()
    assert sorted(r.slot for r in rows) == list(range(sharding.SLOTS)) and {r.shard for r in rows} <= set(range(32))
    if heavy:
        load = Counter(r.shard for r in rows)
        assert max(load.values()) <= 1.05 * sharding.SLOTS / 32 + 1
        before = {r.slot: r.shard for r in old.collect()}
        assert all(before[r.slot] == r.shard for r in rows if before[r.slot] < 32)


def test_edits_name_slots_that_exist(spark, tmp_path):
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    store.save(sharding.initial_map(spark, 4), 1)
    for moves in ({sharding.SLOTS: 0}, {-1: 0}, {0: -1}):
        with pytest.raises(ValueError, match="no such slot"):
            store.edit(1, moves)
