"""The pipeline against stages made by brute force from one another's inputs."""

import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.data import SF, awkward, documents, empty, table
from tests.llm.test_bpe import WORDS
from tests.llm.test_mixing import brute
from tests.llm.test_near import components, pair_sets
from tessera.llm import lang, mixing, near
from tessera.sources.work import written


def test_run_equals_brute_force(spark):
    docs = documents(spark)
    accepted = {r.doc_id for r in lang.identify(docs).where("accepted").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in accepted)
    first: dict = {}
    for i, t, s in rows:
        first.setdefault(t, (i, t, s))
    rows = sorted(first.values())
    sets = pair_sets([t for _, t, _ in rows])
    edges = [(rows[j][0], rows[i][0]) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= near.THRESHOLD * len(sets[i] | sets[j])]
    group = components(edges)
    rows = [r for r in rows if group.get(r[0], r[0]) == r[0]]
    places = brute([(i, s) for i, _, s in rows], None, mixing.BLOCK, mixing.PERIOD)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(places)
    text = {i: t for i, t, _ in rows}
    assert all(r.text == text[r.doc_id] and list(r.tokens) == WORDS.encoding.encode_ordinary(r.text) and r.exact for r in got)


def test_stages_are_named_and_keep_their_columns(spark):
    docs = documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert all(f(spark, docs, SF).columns == docs.columns for _, f in corpus_pipeline.STAGES[:-1])


def test_tokens_come_in_the_order_of_the_mix(spark):
    docs = documents(spark)
    mixed = written(corpus_pipeline.mix_sources(spark, docs, SF), "mixing")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables, documents are shuffled
    try:
        got = corpus_pipeline.encode_text(spark, mixed, SF).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    places = brute([(r.doc_id, r.source) for r in docs.collect()], None, mixing.BLOCK, mixing.PERIOD)
    assert [r.doc_id for r in got] == sorted(places, key=places.get) and [r.place for r in got] == list(range(len(places)))


def test_places_follow_the_numbers_of_files_and_not_their_size(spark, tmp_path):
    docs = table(spark, [(i, "word " * (i + 1), "en", "a") for i in range(40)])
    pq.write_table(docs.limit(3).toArrow(), tmp_path / "part-100000-a.parquet")
    for i, part in ((99999, docs.where("doc_id >= 3 and doc_id < 30")), (100001, docs.where("doc_id >= 30"))):
        pq.write_table(part.toArrow(), tmp_path / f"part-{i}-a.parquet")
    want = [*range(3, 30), *range(3), *range(30, 40)]
    got = corpus_pipeline.encode_text(spark, spark.read.parquet(str(tmp_path)), SF).collect()
    assert [r.doc_id for r in got] == want and [r.place for r in got] == list(range(40))


def test_places_of_tables_that_are_no_files(spark):
    for docs, n in ((awkward(spark), 16), (empty(spark), 0), (documents(spark).orderBy("text"), 200)):
        rows, end = mixing.numbered(docs, "seat")
        assert rows.columns == [*docs.columns, "seat"] and sorted(r.seat for r in rows.collect()) == list(range(n)) and end == n
    texts = [r.text for r in rows.orderBy("seat").collect()]
    assert texts == sorted(texts, key=lambda t: t.encode())
