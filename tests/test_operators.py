import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import schemas, text
from tessera.operators import audit, build, compile as compiler, export, failures, importers, segments, split, verify
from tessera.operators.graph import connected_components
from tessera.plans import bridge, catalogue
from tessera.sources import readers

SF = "/root/testdata/sf0.001"
UNIT_IDS = ("ledger-spend-light", "lantern-turn-open", "echo-card-exception")


def make_units(spark, rows):
    full = [{"kind": "rule", "title": r["unit_id"].title(), "text": "Some text.", **r} for r in rows]
    lines = spark.createDataFrame([(json.dumps(r),) for r in full], "value string")
    raw = lines.select(F.from_json("value", "struct<" + readers._inner(schemas.UNIT) + ">").alias("u")).select("u.*")
    return readers.normal_units(raw)


def cited(unit_id, family, **more):
    return {"unit_id": unit_id, "family": family, "citations": [{"document_id": "d", "span_id": unit_id, "quote": "q"}], **more}


def test_compiler_expands_and_ids_follow_the_contract(spark):
    units = make_units(spark, [cited(u, "f") for u in UNIT_IDS])
    tasks = compiler.compile_units(units)
    assert tasks.count() == 18
    import hashlib

    want = hashlib.sha256(b"template\0ledger-spend-light\0edge_case").hexdigest()[:20]
    assert tasks.where(f"task_id = 'task-{want}'").count() == 1
    with pytest.raises(ValueError):
        compiler.compile_units(units, compiler.TEMPLATES[:5])


def test_prompt_and_reference_answer(spark):
    units = make_units(spark, [cited("u1", None, section="S", text="  Body \n", required_actions=["a", "b"], terms=["t"]), cited("u2", "", section="")])
    rows = {r["metadata"]["primary_unit_id"]: r for r in compiler.compile_units(units).where("task_family = 'edge_case'").collect()}
    assert rows["u1"]["prompt"].split("\n")[:8] == ["Task family: edge_case", "Source unit: u1", "Title: U1", "Section: S", "", "Source text:", "Body", ""]
    assert rows["u1"]["answer_key"]["reference_answer"] == "Body\nRequired actions: a; b\nTerms: t"
    assert rows["u1"]["rule_family"] == "S" and rows["u2"]["rule_family"] == "u2"
    assert "Section" not in rows["u2"]["prompt"]


@pytest.mark.parametrize("n,ratios,want", [(3, (0.8, 0.1, 0.1), (1, 1, 1)), (20, (0.8, 0.1, 0.1), (16, 2, 2)), (9, (0.6, 0.2, 0.2), (5, 2, 2)), (457, (0.8, 0.1, 0.1), (365, 46, 46)), (1, (0.8, 0.1, 0.1), (1, 0, 0)), (5, (1.0, 0.0, 0.0), (5, 0, 0))])
def test_apportionment(n, ratios, want):
    assert split.apportion(n, ratios) == want


def test_three_families_land_in_three_splits(spark):
    names = {"ledger-spend-light": "resource-ledger", "lantern-turn-open": "turn-sequence", "echo-card-exception": "card-exceptions"}
    tasks = split.split_tasks(compiler.compile_units(make_units(spark, [cited(u, f) for u, f in names.items()])), 7)
    found = {(r["u"], r["split"]) for r in tasks.select(F.col("metadata.primary_unit_id").alias("u"), "split").distinct().collect()}
    assert found == {("ledger-spend-light", "train"), ("lantern-turn-open", "dev"), ("echo-card-exception", "test")}


def test_tasks_that_share_units_share_a_split(spark):
    df = spark.createDataFrame([("t1", ["A"]), ("t2", ["A", "B"]), ("t3", ["B"]), ("t4", ["C"])], "task_id string, knowledge_unit_ids array<string>")
    keys = {r["task_id"]: r["group_key"] for r in split.component_keys(df).collect()}
    assert keys == {"t1": "units:A|B", "t2": "units:A|B", "t3": "units:A|B", "t4": "units:C"}
    names = {r["task_id"]: r["group_key"] for r in split.component_names(df).collect()}
    assert names == {"t1": "units-from:A", "t2": "units-from:A", "t3": "units-from:A", "t4": "units-from:C"}
    custom = split.split_tasks(df.withColumn("rule_family", F.lit(None).cast("string")), "7", F.substring("task_id", 1, 1))
    assert custom.select("split").distinct().count() == 1
    with pytest.raises(Exception, match="null"):
        split.with_group_key(df, F.lit(None)).collect()


def test_boundary_digest_by_prefix(spark):
    df = split.written(spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("digest")), "t")
    every = sorted(r[0] for r in df.collect())
    assert [split._nth_digest(df, n) for n in (0, 17, 499, 500)] == [every[0], every[17], every[499], "g"]


def test_connected_components_against_union_find(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_and_a_long_path_are_one_component(spark):
    hub = spark.range(1, 4000).selectExpr("0L AS a", "id AS b")
    path = spark.range(5000, 5300).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(hub.union(path)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {(r["component"], r["n"]) for r in got} == {(0, 4000), (5000, 301)}


def test_intermediate_tables_are_discarded(spark):
    from tessera.sources import work

    before = set(work._written)
    connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in set(work._written) - before}
    assert left == {"pairs", "edges"}
    table = work.written(spark.range(3), "gone")
    work.discard(table)
    assert table._tessera_path not in work._written
    with pytest.raises(Exception):
        spark.read.parquet(table._tessera_path)


TASK = ("t", [["r1"], ["Stop", "Look"], ["Run"], ["one", "two", "three"], ["signal"], "ref"])


def answer_rows(spark, answers, key=None):
    k = dict(zip(("applicable_unit_ids", "required_actions", "forbidden_actions", "procedure_order", "terms", "reference_answer"), TASK[1], strict=True)) | (key or {})
    tasks = spark.createDataFrame([("t", {**k, "citations": []}, ["u"], "edge_case", [])], f"task_id string, answer_key {schemas.ANSWER_KEY}, knowledge_unit_ids array<string>, task_family string, citations array<{schemas.CITATION}>")
    rows = [("t", f"r{i}", a if isinstance(a, dict) else None, None if isinstance(a, dict) else a) for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, f"task_id string, response_id string, answer {schemas.ANSWER}, raw_text string"), tasks


def answer(**changes):
    return {"applicable_rules": ["r1"], "situation_type": None, "required_actions": ["stop", "LOOK"], "forbidden_actions": ["run"], "procedure_order": ["one", "two", "three"], "final_answer": "Obey the Signal."} | changes


def test_scores_gates_and_evidence(spark):
    cases = [answer(), answer(required_actions=["stop"]), answer(required_actions=["stop", "look", "run!"]), answer(procedure_order=["two", "one", "three"]), "not-json", json.dumps(answer()), answer(forbidden_actions=[])]
    responses, tasks = answer_rows(spark, cases)
    full = {r["response_id"]: r for r in verify.verify(responses, tasks).collect()}
    fast = {r["response_id"]: r for r in verify.verify(responses, tasks, evidence=False).collect()}
    for k in full:
        assert [c["score"] for c in full[k]["components"]] == [c["score"] for c in fast[k]["components"]]
        assert full[k]["total_score"] == fast[k]["total_score"]
    assert full["r0"]["total_score"] == 1.0 and full["r0"]["diagnostics"]["safety_gate_reasons"] is None
    one = full["r1"]
    assert one["components"][0]["score"] == 0.5 and one["total_score"] == 0 and one["ungated_total_score"] == pytest.approx(0.8)
    assert one["components"][0]["notes"] == "missing: Look" and "0.5 is below 1" in one["diagnostics"]["safety_gate_reasons"][0]
    assert full["r2"]["components"][1]["score"] == 0 and full["r2"]["diagnostics"]["unsafe_recommendation_detected"] == 1
    assert full["r2"]["components"][1]["notes"] == "positively recommended: Run"
    assert full["r3"]["components"][3]["score"] == pytest.approx(2 / 3) and full["r3"]["components"][3]["evidence"] == ["two", "three"] or full["r3"]["components"][3]["evidence"] == ["one", "three"]
    assert full["r4"]["diagnostics"]["schema_validity"] == 0 and full["r4"]["total_score"] == 0
    assert full["r5"]["total_score"] == 1.0
    assert full["r6"]["components"][1]["score"] == 0 and full["r6"]["total_score"] == pytest.approx(0.8)
    assert audit.ledger_faults(verify.verify(responses, tasks)).count() == 0


def test_weights_and_options(spark):
    responses, tasks = answer_rows(spark, [answer(final_answer="")])
    only = {verify.TERMINOLOGY: 7.0} | {k: 0.0 for k in verify.WEIGHTS if k != verify.TERMINOLOGY}
    assert verify.weights_of(only)[verify.TERMINOLOGY] == 1.0
    assert verify.verify(responses, tasks, only).first()["total_score"] == 0
    loose = verify.verify(answer_rows(spark, ["x"])[0], tasks, hard_gate=False).first()
    assert loose["gate_multiplier"] == 1 and loose["diagnostics"]["safety_gate_reasons"] == ["structured answer is invalid"]
    for bad in ({"x": 1.0}, {verify.RULE: -1.0}, dict.fromkeys(verify.WEIGHTS, 0.0), {verify.RULE: float("nan")}):
        with pytest.raises(ValueError):
            verify.weights_of(bad)
    assert verify.unanswerable(spark.createDataFrame([("z",)], "task_id string"), tasks).count() == 1
    with pytest.raises(Exception, match="unknown task: z"):
        verify.verify(responses.withColumn("task_id", F.lit("z")), tasks).collect()


def test_empty_expectations_score_one(spark):
    responses, tasks = answer_rows(spark, [answer(required_actions=[], forbidden_actions=[], procedure_order=[], final_answer="")], {"required_actions": [], "forbidden_actions": [], "procedure_order": [], "terms": []})
    assert verify.verify(responses, tasks).first()["total_score"] == 1.0


@pytest.mark.parametrize(
    "raw,valid",
    [("{}", True), ('{"schema_version": "0.1"}', True), ('{"schema_version": "1"}', False), ('{"x": 1}', False), ('{"applicable_rules": [1]}', False), ('{"applicable_rules": null}', False), ("[]", False), ("", False), (None, False), ('{"final_answer": 3}', False), ('{"situation_type": null}', True)],
)
def test_strict_answers(raw, valid):
    assert (verify.parse_answer(raw) is not None) == valid


def test_version_key_is_refused_on_demand():
    assert verify.parse_answer('{"schema_version": "0.1"}', allow_version=False) is None


def test_clusters_and_curriculum(spark):
    responses, tasks = answer_rows(spark, [answer(required_actions=["stop"]), answer(required_actions=["stop", "look", "run"]), answer(applicable_rules=[]), answer(applicable_rules=["x"])])
    clusters = failures.cluster_failures(verify.verify(responses, tasks), tasks)
    ranked = [(r["component"], r["severity"], r["count"], r["priority"]) for r in failures.rank_clusters(clusters).orderBy("priority").collect()]
    assert ranked == [(verify.SAFETY, "critical", 1, 1), (verify.FORBIDDEN, "critical", 1, 2), (verify.RULE, "high", 2, 3)]
    top = failures.build_curriculum(clusters, tasks, 1).collect()
    assert len(top) == 1 and top[0]["request_id"] == f"curriculum:failure:{verify.SAFETY}" and top[0]["expected_required_actions"] == ["Stop", "Look"] and "Stop; Look" in top[0]["goal"]
    assert failures.cluster_summary(verify.verify(responses, tasks), minimum=2).count() == 1
    assert failures.build_curriculum(clusters, tasks, 0).count() == 0
    ledgers = verify.verify(responses, tasks)
    short = failures.curriculum_summary(ledgers, tasks, 2).orderBy("priority").collect()
    assert [(r["component"], r["n_tasks"], r["n_units"], r["task_family"]) for r in short] == [(verify.SAFETY, 1, 1, "edge_case"), (verify.FORBIDDEN, 1, 1, "edge_case")]
    members = {(r["component"], r["task_id"], r["first_response"], r["n"]) for r in failures.cluster_members(ledgers).collect()}
    assert members == {(verify.SAFETY, "t", "r0", 1), (verify.FORBIDDEN, "t", "r1", 1), (verify.RULE, "t", "r2", 2)}
    record = json.loads(failures.curriculum_records(clusters, tasks, 1).first()["record"])
    assert record["request_id"] == top[0]["request_id"] and record["parent_task_ids"] == ["t"]
    means = {(r["run"], r["name"]): r["mean"] for r in failures.run_means(ledgers.withColumn("run", F.lit("x")), "run").collect()}
    assert means["x", verify.RULE] == 0.5 and means["x", "reconciled"] == 1.0 and means["x", "unsafe_recommendation_detected"] == 0.25
    outcomes = failures.outcome_histogram(spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string"), spark.createDataFrame([("a", "invalid"), ("a", "valid"), ("b", "odd")], "task_id string, outcome string"))
    assert {r["outcome"]: r["n"] for r in outcomes.collect()} == {"valid": 1, "invalid": 0, "error": 1, "missing": 1, "timeout": 0}
    for call in (lambda: failures.rank_clusters(clusters, -1), lambda: failures.failing(clusters, 2.0), lambda: failures.cluster_summary(verify.verify(responses, tasks), minimum=0)):
        with pytest.raises(ValueError):
            call()


def test_audits(spark):
    spans = spark.createDataFrame([("d", "s1", 0, "x", None, 2, 1, []), ("d", "s1", 0, " ", "zz", None, None, [])], schemas.SPAN)
    faults = {(r["span_id"], r["fault"]) for r in audit.span_faults(spans, "d").collect()}
    assert {f for _, f in faults} == {"pages reversed", "repeated span id", "blank text", "bad hash", "ordinal not rising"}
    units = make_units(spark, [{"unit_id": "a"}, cited("b", "f", kind="nonsense", confidence=2.0)])
    assert {(r[0], r[1]) for r in audit.unit_faults(units).collect()} == {("a", "no citation"), ("b", "unknown kind"), ("b", "confidence outside 0..1")}
    none = units.where("unit_id = 'b'").withColumns({c: F.lit(None).cast(units.schema[c].dataType) for c in ("kind", "review_status", "confidence", "text")})
    assert {r[1] for r in audit.unit_faults(none).collect()} == {"unknown kind", "unknown review status", "confidence outside 0..1", "blank text"}
    built = compiler.compile_units(make_units(spark, [cited("u", "f")]))
    assert audit.task_faults(built).count() == 0
    assert {r[1] for r in audit.task_faults(built.withColumn("task_family", F.lit(None).cast("string"))).collect()} == {"unknown family"}
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {(r["x"], r["side"]) for r in audit.multiset_difference(left, right).collect()} == {(1, "left"), (3, "right")}
    with pytest.raises(ValueError):
        audit.demand_empty(left, "rows")


def rules_of(spark, rules, tmp_path, name="rules.json"):
    (tmp_path / name).write_text(json.dumps({"rules": rules}))
    return readers.read_records(spark, str(tmp_path / name), importers.RULE, "rules")


def test_rule_import_is_preorder_with_inheritance(spark, tmp_path):
    rules = [{"rule_id": "7", "text": "T", "category": "Flags", "section": "S", "page_number": 4, "metadata": {"page_number": "old", "note": [1]}, "sub_rules": [{"rule_id": "7A", "text": "U", "page_number": 0}, {"rule_id": "7B", "text": "V", "category": "Own", "page_number": 9}]}, {"rule_id": "42", "text": "W"}]
    units = importers.import_rules(rules_of(spark, rules, tmp_path), "doc")
    rows = units.orderBy("path").collect()
    assert [r["legacy_rule_id"] for r in rows] == ["7", "7A", "7B", "42"]
    assert [(r["family"], r["section"], r["citations"][0]["page_number"]) for r in rows] == [("Flags", "S", 4), ("Flags", "S", 4), ("Own", "S", 9), (None, None, None)]
    assert rows[1]["unit_id"] == "rule-7a" and json.loads(rows[1]["metadata"])["parent_unit_id"] == "rule-7"
    assert json.loads(rows[0]["metadata"]) == {"note": [1], "legacy_rule_id": "7", "source_format": "rule_json", "page_number": 4}
    assert audit.unit_faults(units).count() == 0
    tasks = spark.createDataFrame([("t1", "Do", ["7A", "99"], "out", "violation"), ("t2", "Do", ["7", "7B"], "out", None)], "task_id string, description string, applicable_rules array<string>, expected_outcome string, task_type string")
    got = {r["task_id"]: r for r in importers.import_tasks(tasks, units, "doc").collect()}
    assert got["t1"]["task_family"] == "violation_check" and got["t1"]["knowledge_unit_ids"] == ["rule-7a", "rule-99"]
    assert got["t2"]["task_family"] == "applied_scenario" and got["t2"]["rule_family"] == "Flags+Own"
    assert got["t1"]["citations"][1]["span_id"] == "doc:rule:99"


def test_rules_nest_to_any_depth(spark, tmp_path):
    rule = {"rule_id": "r0", "text": "t"}
    for i in range(1, 12):
        rule = {"rule_id": f"r{i}", "text": "t", "section": "deep" if i == 11 else None, "sub_rules": [rule]}
    rows = importers.import_rules(rules_of(spark, [rule], tmp_path), "doc").orderBy("path").collect()
    assert [r["legacy_rule_id"] for r in rows] == [f"r{i}" for i in range(11, -1, -1)] and {r["section"] for r in rows} == {"deep"}


def test_aliases_and_coercions_of_rules_and_tasks(spark, tmp_path):
    rules = [{"rule_id": 1, "text": " x ", "procedure": ["a", " b ", ""], "required_actions": "one string", "related_unit_ids": ["2"], "confidence": 0.5, "terms": None, "page_number": "3"}]
    row = importers.import_rules(rules_of(spark, rules, tmp_path), "doc").first()
    assert (row["unit_id"], row["text"], row["procedure_steps"], row["required_actions"], row["related_unit_ids"], row["confidence"], row["terms"]) == ("rule-1", "x", ["a", "b"], ["one string"], ["rule-2"], 0.5, [])
    assert row["citations"][0]["page_number"] == 3 and row["citations"][0]["confidence"] == 0.5
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": [{"task_id": "t", "description": "d", "applicable_rules": "1", "expected_outcome": "o", "procedure": "go", "tags": ["x", "imported"]}]}))
    units, tasks = importers.import_bundle(rules_of(spark, rules, tmp_path), readers.read_records(spark, str(tmp_path / "tasks.json"), importers.RULE_TASK, "tasks"), "doc")
    made = tasks.first()
    assert (made["knowledge_unit_ids"], made["answer_key"]["procedure_order"], made["tags"]) == (["rule-1"], ["go"], ["imported", "x"])


@pytest.mark.parametrize(
    "rule,what",
    [({"text": "x"}, "rule_id"), ({"rule_id": "1", "text": " "}, "blank text of 1"), ({"rule_id": "--", "text": "x"}, "no letter or digit"), ({"rule_id": "1", "text": "x", "sub_rules": ["y"]}, "list of objects"), ({"rule_id": "1", "text": "x", "terms": {"a": 1}}, "expected a text or a list"), ({"rule_id": "1", "text": "x", "metadata": [1]}, "metadata must be an object")],
)
def test_bad_rules_are_errors(spark, tmp_path, rule, what):
    with pytest.raises(Exception, match=what):
        importers.import_rules(rules_of(spark, [rule], tmp_path), "doc").collect()


@pytest.mark.parametrize("change,what", [({"applicable_rules": []}, "no applicable_rules: task t"), ({"description": ""}, "description of t"), ({"expected_outcome": None}, "expected_outcome of t"), ({"task_id": " "}, "task_id")])
def test_bad_rule_tasks_are_errors(spark, tmp_path, change, what):
    units = importers.import_rules(rules_of(spark, [{"rule_id": "1", "text": "x"}], tmp_path), "doc")
    (tmp_path / "tasks.json").write_text(json.dumps([{"task_id": "t", "description": "d", "applicable_rules": ["1"], "expected_outcome": "o"} | change]))
    with pytest.raises(Exception, match=what):
        importers.import_tasks(readers.read_records(spark, str(tmp_path / "tasks.json"), importers.RULE_TASK, "tasks"), units, "doc").collect()


def test_colliding_rule_ids_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="collide"):
        importers.import_bundle(rules_of(spark, [{"rule_id": "A 1", "text": "x"}, {"rule_id": "a-1", "text": "y"}], tmp_path))


def fixture_row(**change):
    cite = {"volume_title": "Big Book", "source_span": "s1", "rule_id": "Rule 99", "page_number": 2, "section": "S", "confidence": 0.9}
    row = {"task_id": "a", "prompt": "p", "task_type": "edge_case", "expected_rule_ids": ["Rule 99"], "expected_required_actions": ["x", "z"], "expected_forbidden_actions": [], "expected_procedure_order": [], "expected_terms": ["t"], "rule_family": "F", "source_citations": [cite, cite | {"confidence": 0.4, "source_span": None}]}
    return row | change


def test_fixture_import(spark, tmp_path):
    for name, rows in (("train", [fixture_row(), fixture_row(task_id="b", expected_required_actions=["y"], task_type="odd")]), ("test", [fixture_row(task_id="c")])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    units, tasks = importers.load_fixture(spark, str(tmp_path))
    unit = units.collect()
    assert len(unit) == 1 and unit[0]["unit_id"] == "source-unit-rule-99" and unit[0]["required_actions"] == ["x", "z"] and unit[0]["confidence"] == 0.4
    assert [c["span_id"] for c in unit[0]["citations"]] == ["s1", "Rule 99"] and unit[0]["citations"][0]["document_id"] == "big-book" and unit[0]["section"] == "S"
    assert audit.unit_faults(units).count() == 0
    got = {r["task_id"]: r for r in tasks.collect()}
    assert {k: (r["split"], r["task_family"]) for k, r in got.items()} == {"a": ("train", "edge_case"), "b": ("train", "applied_scenario"), "c": ("test", "edge_case")}
    assert got["a"]["answer_key"]["reference_answer"] == "x; z" and got["a"]["knowledge_unit_ids"] == ["source-unit-rule-99"]
    rows = spark.read.json(str(tmp_path / "train.jsonl"), schema=importers._FIXTURE)
    weights = spark.createDataFrame([("rule 99", {"cond": 1.0})], "rule_id string, condition_weights map<string,double>")
    assert importers.fixture_units(rows, "task_id", weights).first()["conditions"] == ["cond"]
    for bad, what in (({"expected_rule_ids": []}, "no expected rule"), ({"expected_rule_ids": ["Rule 1"], "source_citations": []}, "no source citation")):
        (tmp_path / "test.jsonl").write_text(json.dumps(fixture_row(task_id="z", **bad)))
        with pytest.raises(Exception, match=what):
            [x.collect() for x in importers.load_fixture(spark, str(tmp_path))]


SPAN_ROW = "document_id string, span_id string, ordinal int, text string, page_start int, page_end int, section_path array<string>"


def extracted(spark, reply):
    rows = [("doc", "s1", 3, "Span text", 5, 6, ["A", "B"], reply)]
    return importers.extracted_units(spark.createDataFrame(rows, SPAN_ROW + ", reply string"), "doc").collect()


def test_extraction_bridge(spark):
    unit = {"title": " T ", "text": "Body", "terms": ["a"]}
    rows = extracted(spark, f"```json\n{json.dumps({'knowledge_units': [unit]})}\n```")
    assert len(rows) == 1 and rows[0]["unit_id"].startswith("ku-") and rows[0]["title"] == "T" and rows[0]["terms"] == ["a"]
    assert rows[0]["citations"][0]["locator"] == "ordinal 3; pages 5-6; section A > B"
    bad = ['{"other": 1}', "not json", json.dumps({"knowledge_units": []}), json.dumps({"knowledge_units": [unit], "more": 1})]
    bad += [json.dumps({"knowledge_units": [unit | c]}) for c in ({"title": " "}, {"text": None}, {"family": " "}, {"terms": ["a", " "]})]
    for reply in bad:
        with pytest.raises(Exception, match="span s1|blank"):
            extracted(spark, reply)


def test_extraction_requests_and_markers(spark):
    documents = spark.createDataFrame([("doc", 'The "Book"', None)], "document_id string, title string, edition string")
    row = importers.extraction_requests(documents, spark.createDataFrame([("doc", "s1", 3, "é\n", 5, None, ["A"])], SPAN_ROW)).first()
    source = {"document_id": "doc", "title": 'The "Book"', "edition": None, "span_id": "s1", "ordinal": 3, "pages": [5, None], "section_path": ["A"], "text": "é\n"}
    assert row["prompt"] == "Source span:\n" + json.dumps(source, ensure_ascii=False, sort_keys=True) and row["max_tokens"] == 4096
    texts = ["x ```json {} ``` y", "a ```b``` c", "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(importers.after_marker(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == ["{}", "b", "plain"]
    assert len(importers.stamped(spark.range(1)).first()["generated_at"]) == 26
    pages = spark.createDataFrame([("b", 2), ("a", 2), ("c", None)], "rule_id string, page_number int")
    assert [r["rule_id"] for r in importers.by_page_and_rule(pages).collect()] == ["c", "a", "b"]


def test_rule_segmentation(spark):
    pages = ["front", "GENERAL\nA. Obey all\nrules.\n", "APPLY ONLY IN YARDS\n1. Trains must stop-\nping here\n12\n2, not a rule\n3, but this is\n9. skip me\nS 4. Flag (A)\n", "1. Again\nTABLE OF CONTENTS\njunk"]
    df = spark.createDataFrame([("vol", "\f".join(pages))], "document_id string, text string")
    sections = spark.createDataFrame([(1, "General"), (2, "Yard")], "start int, section string")
    commas, out_ = (spark.createDataFrame([(2, i)], "page int, rule_id string") for i in ("3", "9"))
    out = segments.extract_rules(df, sections, ("S",), commas, out_, 1, ("GENERAL",), (3, 3))
    starts = segments.rule_starts(segments.page_lines(df), ("S",), commas, out_, 1)
    report = {(r["part"], r["key"]): (r["page_number"], r["n"]) for r in segments.extraction_report(out, starts).collect()}
    assert report == {("rules", None): (None, 5), ("section", "General"): (None, 1), ("section", "Yard"): (None, 4), ("duplicate", "1"): (None, 2), ("correction", "3"): (2, 1), ("excluded", "9"): (2, 1)}
    high = segments.extract_rules(df, sections, ("S",), commas, out_, 1, ("GENERAL",), (3, 3), (3, "High")).collect()
    assert {r["unit_rule_id"]: r["section"] for r in high} == {"A": "General", "1": "Yard", "3": "High", "S-4": "Yard", "1@p003-v2": "Yard"}
    with pytest.raises(Exception, match="empty text: rule 2"):
        segments.extract_rules(spark.createDataFrame([("v", "1. x\n2.\n3. y")], "document_id string, text string"), sections).collect()
    rows = {r["unit_rule_id"]: r for r in out.collect()}
    assert set(rows) == {"A", "1", "3", "S-4", "1@p003-v2"}
    assert rows["A"]["text"] == "Obey all rules." and rows["1"]["text"] == "Trains must stopping here 2, not a rule"
    assert rows["1"]["conditions"] == ["APPLY ONLY IN YARDS"] and rows["3"]["confidence"] == 0.76 and rows["3"]["corrected"]
    assert rows["1@p003-v2"]["text"] == "Again" and rows["1@p003-v2"]["title"] == "Rule 1 (variant 2)" and rows["1@p003-v2"]["confidence"] == 0.68
    assert rows["A"]["section"] == "General" and rows["S-4"]["section"] == "Yard"


def test_long_section_tables_are_merged(spark, monkeypatch):
    import bisect
    import random

    rng = random.Random(2)
    starts = sorted(rng.sample(range(100, 5000), 400))
    sections = spark.createDataFrame([(s, f"s{s}") for s in starts], "start int, section string")
    rows = spark.createDataFrame([(i, rng.choice([None, rng.randrange(6000), rng.choice(starts)])) for i in range(900)], "id int, v int")
    want = {r["id"]: None if r["v"] is None or r["v"] < starts[0] else f"s{starts[bisect.bisect_right(starts, r['v']) - 1]}" for r in rows.collect()}
    assert {r["id"]: r["section"] for r in segments.section_of(rows, sections, "v").collect()} == want
    monkeypatch.setattr(segments, "LITERALS", 10)
    assert {r["id"]: r["section"] for r in segments.section_of(rows, sections, "v").collect()} == want


def test_numbering_and_sampling(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    rows = segments.numbered(df, "x").collect()
    assert all(r["row_number"] == r["x"] + 1 for r in rows)
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(9)], "task_id string")
    assert importers.sample_one(tasks, 7).first() == importers.sample_one(tasks, "7").first()


def test_exports(spark):
    tasks = compiler.compile_units(make_units(spark, [cited("u", "f", required_actions=["é"], text="x")])).withColumn("split", F.lit("train"))
    sft = export.sft_records(tasks).first()
    said = json.loads(sft["messages"][2]["content"])
    assert list(said) == sorted(said) and said["schema_version"] == "0.1" and "\\u00e9" in sft["messages"][2]["content"]
    grpo = export.grpo_records(tasks).first()
    assert grpo["answer_contract"]["fields"] == list(schemas.ANSWER_FIELDS) and grpo["metadata"]["split"] == "train"
    trained = compiler.compile_units(make_units(spark, [cited("u", "f", required_actions=["é"], text="x")]), scored=True, trained=True).withColumn("split", F.lit("train"))
    assert {r["id"]: r["messages"] for r in export.sft_records(trained).collect()} == {r["id"]: r["messages"] for r in export.sft_records(tasks).collect()}
    package = export.packaged(tasks)
    assert export.parity_faults(tasks, package).count() == 0
    assert {r["fault"] for r in export.parity_faults(tasks, package.where("idx > 0").withColumn("split", F.lit("dev"))).collect()} == {"not packaged", "another split"}
    packaged = export.packaged(tasks).orderBy("idx").collect()
    assert [r["idx"] for r in packaged] == list(range(6)) and [r["task_id"] for r in packaged] == sorted(r["task_id"] for r in packaged)


def test_build_round_trip(spark, tmp_path):
    units = make_units(spark, [cited(u, f"fam{i}", required_actions=["do it"]) for i, u in enumerate(UNIT_IDS)])
    root = str(tmp_path / "b")
    manifest = build.compile_build(units, root, "vol", 7)
    assert manifest == build.load_manifest(root) and manifest["metadata"]["task_count"] == 18
    again = build.compile_build(units, str(tmp_path / "c"), "vol", 7)
    assert again["build_id"] == manifest["build_id"] and [o["sha256"] for o in again["outputs"]] == [o["sha256"] for o in manifest["outputs"]]
    report = build.inspect_build(spark, root)
    assert report["splits"] == {"train": 6, "dev": 6, "test": 6} and len(report["artifacts"]) == 5
    _, _, tasks = build.load_build(spark, root)
    assert build.package_taskset(tasks, str(tmp_path / "p"))["taskset"]["record_count"] == 18
    build.check_package(tasks, str(tmp_path / "p"))
    (tmp_path / "p/taskset-manifest.json").write_text("{}")
    with pytest.raises(ValueError, match="stale"):
        build.check_package(tasks, str(tmp_path / "p"))
    with open(f"{root}/splits/dev.jsonl", "a") as f:
        f.write("{}\n")
    with pytest.raises(ValueError, match="differs"):
        build.validate_build(spark, root)
    with pytest.raises(ValueError):
        build.compile_build(units.limit(0), root, "vol")
    with pytest.raises(ValueError):
        build.select_split(tasks.limit(0), "test")


def likeness(said, reference):
    """Fidelity of one answer's text (None: no answer) by plain Python."""
    if said is None or not reference:
        return 0.0
    return SequenceMatcher(None, text.normalize_python(said), text.normalize_python(reference)).ratio()


def test_fidelity_equals_python(spark):
    cases = [(s, r) for s in (None, "", "!?", "Stop and look", "ＳＴＯＰ, and  ﬁnd", "the ligature straße") for r in (None, "", "...", "stop AND look", "stop and find", "the ligature strasse")]
    rows = [(f"t{i}", None if s is None else json.dumps({"final_answer": s}), json.dumps({} if r is None else {"reference_answer": r})) for i, (s, r) in enumerate(cases)] + [("none", "{}", '{"reference_answer": "x"}')]
    df = spark.createDataFrame(rows, "task_id string, a string, k string")
    responses = df.select("task_id", F.lit("r").alias("response_id"), F.from_json("a", schemas.ANSWER).alias("answer"))
    tasks = df.select("task_id", F.from_json("k", "reference_answer string").alias("answer_key"))
    got = {r["task_id"]: r["fidelity"] for r in verify.fidelity(responses, tasks).collect()}
    assert got == {f"t{i}": likeness(s, r) for i, (s, r) in enumerate(cases)} | {"none": 0.0}


def test_fidelity_query_gives_every_response(spark):
    built = bridge.tasks(spark, SF)
    said = {r["task_id"]: r["s"] for r in bridge.responses(built).select("task_id", F.col("answer.final_answer").alias("s")).collect()}
    key = {r["task_id"]: r["k"] for r in built.select("task_id", F.col("answer_key.reference_answer").alias("k")).collect()}
    got = {r["task_id"]: r["fidelity"] for r in catalogue.QUERIES["q_fidelity"](spark, SF).collect()}
    assert got == {t: round(likeness(said[t], k), 9) for t, k in key.items()} and None in said.values() and len(got) == 1200


def test_responses_with_their_own_keys_score_as_joined_ones_without_a_shuffle(spark):
    built = bridge.tasks(spark, SF, scored=True).where("family_index < 2")
    given = bridge.responses(built)
    alone = verify.verify(given, keep=("variant",))
    assert {r["variant"] for r in alone.select("variant").distinct().collect()} == set(range(7))
    joined = verify.verify(given.drop("scoring_key"), built.drop("scoring_key"))
    rows = lambda df: sorted(map(str, df.drop("variant").collect()))
    assert rows(alone) == rows(joined)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_own_key_that_is_missing_is_an_unknown_task(spark):
    given = bridge.responses(bridge.tasks(spark, SF, scored=True)).limit(1).withColumn("scoring_key", F.when(F.lit(False), F.col("scoring_key")))
    with pytest.raises(Exception, match="unknown task"):
        verify.verify(given).select("task_id").collect()


def test_scoring_queries_score_once_and_shuffle_no_response(spark):
    for name in ("q_symbolic_eval", "q_run_means", "q_baseline_vs_adapted", "q_verify_totals"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, name


def test_fidelity_without_tasks_equals_the_joined_one(spark):
    cases = [(s, r) for s in (None, "", "!?", "ﹰ", "Stop", "stop", "a b c") for r in (None, "", "...", "ﹰ", "Stop", "stop!", "a b d")]
    df = spark.createDataFrame([(f"t{i}", None if s is None else json.dumps({"final_answer": s}), r) for i, (s, r) in enumerate(cases)], "task_id string, a string, reference_answer string")
    responses = df.select("task_id", F.lit("r").alias("response_id"), F.from_json("a", schemas.ANSWER).alias("answer"), "reference_answer")
    tasks = df.select("task_id", F.struct("reference_answer").alias("answer_key"))
    rows = lambda x: {r["task_id"]: r["fidelity"] for r in x.collect()}
    assert rows(verify.fidelity(responses)) == rows(verify.fidelity(responses, tasks)) == {f"t{i}": likeness(s, r) for i, (s, r) in enumerate(cases)}
    plan = catalogue.QUERIES["q_fidelity"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_parity_compares_contents_and_moves_digests(spark):
    made = bridge.tasks(spark, SF).limit(8).withColumn("split", F.lit(None).cast("string")).collect()
    built = spark.createDataFrame(made, bridge.tasks(spark, SF).withColumn("split", F.lit(None).cast("string")).schema)
    package = export.packaged(built)
    assert export.parity_faults(built, package).count() == 0
    ids = [r["task_id"] for r in package.orderBy("idx").collect()]
    key = F.col("answer_key")
    changed = (
        F.when(F.col("task_id") == ids[0], key.withField("terms", F.lit(None).cast("array<string>")))
        .when(F.col("task_id") == ids[1], key.withField("terms", F.concat(key.terms, F.array(F.lit("")))))
        .when(F.col("task_id") == ids[2], key.withField("reference_answer", F.concat(key.reference_answer, F.lit(" "))))
        .when(F.col("task_id") == ids[3], F.lit(None).cast(built.schema["answer_key"].dataType))
        .otherwise(key)
    )
    other = package.withColumn("answer_key", changed).withColumn("split", F.when(F.col("task_id") == ids[4], "dev")).withColumn("prompt", F.when(F.col("task_id") != ids[5], F.col("prompt")))
    got = sorted(tuple(r) for r in export.parity_faults(built, other).collect())
    assert got == sorted([(i, "another answer_key") for i in ids[:4]] + [(ids[4], "another split"), (ids[5], "another prompt")])
    plan = export.parity_faults(built, other)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") >= 4


def test_unit_references_are_the_units_of_the_tasks(spark):
    listed = bridge.unit_tasks(spark, SF).select("task_id", F.explode("knowledge_unit_ids").alias("unit_id"))
    lines = bridge.unit_references(spark, SF)
    assert listed.exceptAll(lines.distinct()).count() == lines.distinct().exceptAll(listed).count() == 0
    plan = catalogue.QUERIES["q_leakage_unit"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Generate" not in plan


def test_split_rule_needs_no_join_by_group_key(spark):
    tasks = spark.createDataFrame([(f"t{i}", [f"u{i % 7}", f"u{i % 7 + 50}"]) for i in range(60)] + [(f"s{i}", [f"own{i}"]) for i in range(20)], "task_id string, knowledge_unit_ids array<string>")
    for mode in ("knowledge_unit", "knowledge_component"):
        made = split.split_tasks(tasks, 7, mode)
        assert made.columns == ["group_key", "task_id", "knowledge_unit_ids", "split"]
        rows = {r["task_id"]: (r["group_key"], r["split"]) for r in made.collect()}
        told = dict((r["group_key"], r["split"]) for r in split.group_assignments(made, 7).collect())
        assert len(rows) == 80 and rows == {t: (k, told[k]) for t, (k, _) in rows.items()} and len(told) == 27
        assert sorted(told.values()) == sorted(["train"] * 21 + ["dev"] * 3 + ["test"] * 3)
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_components_of_repeated_edges_write_no_copy_of_them(spark, monkeypatch):
    from tessera.operators import graph

    pairs = [(9, 4), (4, 9), (9, 4), (4, 2), (7, 7), (7, 7), (6, 5), (5, 6), (None, 3), (3, None), (12, 11), (11, 10), (10, 12)]
    want = {2: 2, 4: 2, 9: 2, 7: 7, 5: 5, 6: 5, 10: 10, 11: 10, 12: 10}
    df = spark.createDataFrame(pairs, "a long, b long")
    names = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda x, name: names.append(name) or real(x, name))
    for kept in (False, True):
        names.clear()
        assert {r["node"]: r["component"] for r in connected_components(df, kept=kept).collect()} == want
        assert names[:2] == (["large", "edges"] if kept else ["pairs", "large"]) and names.count("pairs") == (not kept)
    assert connected_components(df.where("a IS NULL")).count() == 0
