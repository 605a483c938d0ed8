import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.sources import readers, sinks


def test_json_shapes(spark, tmp_path):
    ddl = "id string, n int"
    rows = [{"id": "a", "n": 1}, {"id": "b"}]
    for name, body in {"l.json": json.dumps(rows), "w.json": json.dumps({"units": rows}), "x.jsonl": "\n".join(map(json.dumps, rows)) + "\n\n"}.items():
        (tmp_path / name).write_text(body)
        got = [tuple(r) for r in readers.read_records(spark, str(tmp_path / name), ddl, "knowledge_units", "units").orderBy("id").collect()]
        assert got == [("a", 1), ("b", None)]
    (tmp_path / "one.json").write_text('{"id": "z", "n": 3}')
    assert readers.read_records(spark, str(tmp_path / "one.json"), ddl, "units").first()["id"] == "z"


@pytest.mark.parametrize("body,what", [('[{"id": "a"}, {"id"', "not valid JSON"), ('{"units": [{"id": "a"}', "not valid JSON"), ('[1, {"id": "a"}]', "no object"), ('{"units": {"id": "a"}}', "holds no list"), ('"text"', "neither a list"), ("[null]", "no object")])
def test_malformed_records_are_errors(spark, tmp_path, body, what):
    (tmp_path / "x.json").write_text(body)
    with pytest.raises(Exception, match=what):
        readers.read_records(spark, str(tmp_path / "x.json"), "id string", "units").collect()


def test_examples_and_page_counts(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"task_id": f"t{i}", "description": "d", "expected_outcome": "o", "applicable_rules": ["1"]} for i in range(3)]))
    rows = readers.read_examples(spark, str(tmp_path / "e.json"), 2).collect()
    assert [r["question"] for r in rows] == ["Task ID: t0\nScenario: d", "Task ID: t1\nScenario: d"] and rows[0]["answer"] == "o" and rows[0]["info"]["applicable_rules"] == ["1"]
    assert readers.read_examples(spark, str(tmp_path / "e.json")).count() == 3
    (tmp_path / "book.txt").write_text("p0\fp1\f")
    assert readers.read_pages(spark, str(tmp_path / "book.txt"), 2).count() == 1
    with pytest.raises(Exception, match="expected 3 pages, found 2"):
        readers.read_pages(spark, str(tmp_path / "book.txt"), 3).collect()


def test_parts_are_ordered_and_hashed(spark, tmp_path):
    df = spark.range(500).selectExpr("concat('k', lpad(id, 4, '0')) AS id", "id AS n")
    told = sinks.write_parts(df.repartition(7), str(tmp_path / "out"), "id", parts=4)
    lines = []
    for part in told["parts"]:
        raw = (tmp_path / "out" / part["path"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == part["sha256"] and raw.count(b"\n") == part["record_count"]
        lines += raw.decode().splitlines()
    assert told["record_count"] == 500 and [json.loads(x)["n"] for x in lines] == list(range(500))
    assert sinks.write_parts(df.repartition(3), str(tmp_path / "again"), "id", parts=4)["sha256"] == told["sha256"]


def test_bad_lines_and_checked_gzip(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": "a"}\n\nnope\n[1]\n')
    assert [(r["line"], r["text"]) for r in readers.bad_json_lines(spark, str(tmp_path / "b.jsonl")).orderBy("line").collect()] == [(3, "nope"), (4, "[1]")]
    raw = gzip.compress(b'{"id": "a"}\n')
    path = tmp_path / "t.jsonl.gz"
    path.write_bytes(raw)
    assert readers.read_checked(spark, str(path), "id string", hashlib.sha256(raw).hexdigest(), 1).count() == 1
    for sha, n in (("0" * 64, 1), (None, 2)):
        with pytest.raises(ValueError):
            readers.read_checked(spark, str(path), "id string", sha, n)


def test_directories_catalogues_and_pages(spark, tmp_path):
    (tmp_path / "d/s").mkdir(parents=True)
    (tmp_path / "d/a.TXT").write_text("x")
    (tmp_path / "d/s/page_12.png").write_bytes(b"\x89")
    files = readers.list_files(spark, str(tmp_path / "d"))
    assert [r["media_type"] for r in files.collect()] == ["text/plain", "image/png"]
    assert files.first()["sha256"] == hashlib.sha256(b"x").hexdigest()
    assert readers.page_selection(files, 10, 12).count() == 1
    for name, vid in (("v1", "v1"), ("v2", "other")):
        (tmp_path / "vols" / name).mkdir(parents=True)
        (tmp_path / "vols" / name / "volume.json").write_text(json.dumps({"volume_id": vid}))
    assert [r["volume_id"] for r in readers.read_catalogue(spark, str(tmp_path / "vols")).collect()] == ["v1"]
    (tmp_path / "book.txt").write_text("p0\fp1")
    assert readers.read_pages(spark, str(tmp_path / "book.txt")).first()["document_id"] == "book"
    assert readers.base64_content(spark, str(tmp_path / "d/a.TXT")).first()["base64"] == "eA=="


def test_partials_first_wins(spark, tmp_path):
    (tmp_path / "r_1.json").write_text('[{"id": "a", "n": 1}, {"id": "b", "n": 2}]')
    (tmp_path / "r_2.json").write_text('[{"id": "a", "n": 9}]')
    (tmp_path / "r_3.json").write_text("broken")
    (tmp_path / "r_complete_x.json").write_text('[{"id": "c", "n": 1}]')
    got = {r["id"]: r["n"] for r in readers.read_partials(spark, str(tmp_path / "r_*.json"), "id string, n int", "id").collect()}
    assert got == {"a": 1, "b": 2}


def test_sinks_hash_confine_and_detect_changes(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.00001), ("a", None)], "id string, x double")
    ref = sinks.write_lines(df, str(tmp_path), "out/t.jsonl", "id")
    body = (tmp_path / "out/t.jsonl").read_bytes()
    assert body.splitlines()[1] == b'{"id":"b","x":1e-05}' and ref.sha256 == hashlib.sha256(body).hexdigest() and ref.record_count == 2
    assert sinks.check(str(tmp_path), ref.as_dict())["size_bytes"] == len(body)
    one, two = (sinks.write_lines(df, str(tmp_path), f"{n}.jsonl.gz", "id", compress=True) for n in "ab")
    assert one.sha256 == two.sha256 and sinks.check(str(tmp_path), one.as_dict())
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            sinks.confined(str(tmp_path), bad)
    refs = sinks.write_splits(spark.createDataFrame([("t", "train")], "task_id string, split string"), str(tmp_path))
    assert [r.record_count for r in refs] == [1, 0, 0] and (tmp_path / "splits/test.jsonl").read_text() == ""


def test_command_line(spark, tmp_path, capsys):
    units = [{"unit_id": f"u{i}", "title": "T", "text": "Body", "family": f"f{i}", "required_actions": ["go"], "citations": [{"document_id": "d", "span_id": "s"}]} for i in range(3)]
    (tmp_path / "units.json").write_text(json.dumps({"knowledge_units": units}))
    out = str(tmp_path / "build")
    assert cli.main(["compile", "--volume-id", "v", "--units", str(tmp_path / "units.json"), "--output", out, "--seed", "7"]) == 0
    assert cli.main(["validate", out]) == 0
    assert cli.main(["inspect", out]) == 0
    capsys.readouterr()
    assert cli.main(["reference-eval", out, "--split", "test"]) == 0
    assert json.loads(capsys.readouterr().out)["mean_total_score"] == 1.0
    assert cli.main(["reference-eval", out, "--split", "test", "--output", str(tmp_path / "eval")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert sorted(p.name for p in (tmp_path / "eval").iterdir()) == ["evaluation.json", "responses.jsonl", "reward_ledgers.jsonl"] and told["mean_reference_answer_fidelity_unscored"] == 1.0
    assert len((tmp_path / "eval/reward_ledgers.jsonl").read_text().splitlines()) == told["count"] == sum(told["task_family_counts"].values()) == 6
    assert cli.main(["inspect-artifacts", out]) == 0
    assert cli.main(["export", out, "--format", "sft", "--output", str(tmp_path / "x")]) == 0
    line = (tmp_path / "x/sft-train.jsonl").read_text().splitlines()[0]
    assert line == json.dumps(json.loads(line), sort_keys=True, ensure_ascii=False) and json.loads(line)["messages"][2]["role"] == "assistant"
    assert cli.main(["package", out, "--output", str(tmp_path / "pack")]) == 0
    assert cli.main(["package", out, "--output", str(tmp_path / "pack"), "--check"]) == 0
    assert cli.main(["validate", str(tmp_path / "none")]) == 2
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"rule_id": "1", "text": "x", "sub_rules": [{"rule_id": "1A", "text": "y"}]}]}))
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": [{"task_id": "t", "description": "d", "applicable_rules": ["1A"], "expected_outcome": "o"}]}))
    capsys.readouterr()
    assert cli.main(["compile", "--volume-id", "v", "--rules", str(tmp_path / "rules.json"), "--rule-tasks", str(tmp_path / "tasks.json"), "--output", str(tmp_path / "b2")]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["metadata"]["task_count"] == 13 and made["metadata"]["imported_task_count"] == 1
    (tmp_path / "bad.json").write_text('{"rules": [{"rule_id": "1"}]}')
    assert cli.main(["compile", "--volume-id", "v", "--rules", str(tmp_path / "bad.json"), "--output", str(tmp_path / "b3")]) == 2


def test_stream_scores_like_a_batch(spark, tmp_path):
    from tests.test_operators import answer, answer_rows
    from tessera.operators import verify
    from tessera.streaming import score

    responses, tasks = answer_rows(spark, [answer(), answer(required_actions=[]), "bad"])
    responses = responses.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    responses.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(responses.schema).parquet(str(tmp_path / "in"))
    run = score.score_stream(stream, tasks).writeStream.format("memory").queryName("ledgers").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    want = {(r["response_id"], r["total_score"]) for r in verify.verify(responses, tasks).collect()}
    assert {(r["response_id"], r["total_score"]) for r in spark.table("ledgers").collect()} == want
    run = score.write_clusters(score.score_stream(stream, tasks), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    ledgers = verify.verify(responses, tasks).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert score.failure_counts(ledgers, "at").count() == 5
