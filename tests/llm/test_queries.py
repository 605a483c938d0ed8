import __spark_entry__ as entry
from tessera.llm import queries


def test_one_query_for_each_operator():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
