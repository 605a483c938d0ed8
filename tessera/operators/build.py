"""Builds: units and tasks to a directory of tables, split files and a manifest; validation and inspection."""

from __future__ import annotations

import filecmp
import json
import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import schemas
from tessera.functions.canonical import digest
from tessera.operators import audit, compile as compiler, export, split, verify
from tessera.sources import readers, sinks
from tessera.sources.work import written

VERSION = "1"
REQUIRED = ("knowledge_units.jsonl", "tasks.jsonl", "splits/train.jsonl", "splits/dev.jsonl", "splits/test.jsonl")
MANIFEST = "manifest.json"


def compile_build(units: DataFrame, root: str, volume_id: str, seed: int = 0, group_by="rule_family", imported: DataFrame | None = None, source_revision: str | None = None, inputs: list[dict] | None = None) -> dict:
    """Compile, check, split and write; gives the manifest.

    Refuses no units, repeated ids, dangling references and groups in two splits."""
    if not volume_id.strip():
        raise ValueError("volume_id is blank")
    units = written(units, "units")
    if units.isEmpty():
        raise ValueError("a build needs units")
    audit.demand_empty(audit.duplicates(units, "unit_id"), "repeated unit ids")
    audit.demand_empty(audit.unit_faults(units), "invalid units")
    made = compiler.compile_units(units).drop("family_index")
    every = made if imported is None else made.unionByName(imported, allowMissingColumns=True)
    tasks = written(split.split_tasks(every, seed, group_by), "tasks")
    audit.demand_empty(audit.duplicates(tasks, "task_id"), "repeated task ids")
    refs = tasks.select("task_id", F.explode("knowledge_unit_ids").alias("unit_id"))
    audit.demand_empty(audit.dangling(refs, units, "unit_id", "unit_id"), "tasks name unknown units")
    audit.demand_empty(audit.leaking(tasks, "group_key"), "groups in two splits")
    outputs = [sinks.write_lines(units, root, REQUIRED[0], "unit_id"), sinks.write_lines(tasks, root, REQUIRED[1], "task_id"), *sinks.write_splits(tasks, root)]
    fingerprint = {"compiler_version": VERSION, "volume_id": volume_id, "seed": seed, "group_by": group_by if isinstance(group_by, str) else "custom", "inputs": inputs or [], "outputs": [o.sha256 for o in outputs], "source_revision": source_revision}
    generated = made.count()
    manifest = {
        "build_id": f"{volume_id}-{digest(fingerprint)[:16]}", "volume_id": volume_id, "compiler_version": VERSION, "seed": seed, "inputs": inputs or [], "outputs": [o.as_dict() for o in outputs], "source_revision": source_revision, "created_at": None,
        "metadata": {"group_by": fingerprint["group_by"], "knowledge_unit_count": outputs[0].record_count, "task_count": outputs[1].record_count, "generated_task_count": generated, "imported_task_count": outputs[1].record_count - generated},
    }
    sinks.write_json(root, MANIFEST, manifest)
    return manifest


def load_manifest(root: str) -> dict:
    with open(os.path.join(root, MANIFEST)) as f:
        return json.load(f)


TASK = "task_id string, task_family string, rule_family string, group_key string, split string, knowledge_unit_ids array<string>, prompt string, answer_key struct<applicable_unit_ids:array<string>,required_actions:array<string>,forbidden_actions:array<string>,procedure_order:array<string>,terms:array<string>,reference_answer:string,citations:array<" + schemas.CITATION + ">>, citations array<" + schemas.CITATION + ">"


def load_build(spark: SparkSession, root: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, units, tasks) of a build directory."""
    return load_manifest(root), readers.read_units(spark, os.path.join(root, REQUIRED[0])), readers.read_json_lines(spark, os.path.join(root, REQUIRED[1]), TASK)


def select_split(tasks: DataFrame, name: str) -> DataFrame:
    """Tasks of one split, or of ``all``; an empty selection is an error."""
    out = tasks if name == "all" else tasks.where(F.col("split") == name)
    if out.isEmpty():
        raise ValueError(f"no task in split {name}")
    return out


def validate_build(spark: SparkSession, root: str) -> dict:
    """Check outputs, hashes, ids, splits, references and leakage; gives the counts."""
    manifest = load_manifest(root)
    missing = sorted(set(REQUIRED) - {o["path"] for o in manifest["outputs"]})
    if missing:
        raise ValueError(f"missing outputs: {', '.join(missing)}")
    for ref in manifest["outputs"]:
        sinks.check(root, ref)
    _, units, tasks = load_build(spark, root)
    audit.demand_empty(audit.duplicates(units, "unit_id"), "repeated unit ids")
    audit.demand_empty(audit.duplicates(tasks, "task_id"), "repeated task ids")
    audit.demand_empty(audit.task_faults(tasks), "invalid tasks")
    parts = []
    for name in ("train", "dev", "test"):
        part = readers.read_json_lines(spark, os.path.join(root, f"splits/{name}.jsonl"), TASK)
        audit.demand_empty(part.where(~F.col("split").eqNullSafe(F.lit(name))).select("task_id"), f"tasks of another split in {name}")
        parts.append(part)
    audit.demand_empty(audit.multiset_difference(tasks.select("task_id"), reduce(DataFrame.unionByName, parts).select("task_id")), "split files differ from the tasks")
    refs = tasks.select("task_id", F.explode("knowledge_unit_ids").alias("unit_id"))
    audit.demand_empty(audit.dangling(refs, units, "unit_id", "unit_id"), "tasks name unknown units")
    audit.demand_empty(audit.leaking(tasks, "group_key"), "groups in two splits")
    counts = {r["split"]: r["n"] for r in tasks.groupBy("split").agg(F.count("*").alias("n")).collect()}
    return {"build_id": manifest["build_id"], "volume_id": manifest["volume_id"], "knowledge_units": units.count(), "tasks": sum(counts.values()), "splits": {s: counts.get(s, 0) for s in ("train", "dev", "test")}, "valid": True}


def inspect_build(spark: SparkSession, root: str) -> dict:
    """Validation with version, seed, family counts and artefact sizes."""
    report = validate_build(spark, root)
    manifest, _, tasks = load_build(spark, root)
    families = {r["task_family"]: r["n"] for r in tasks.groupBy("task_family").agg(F.count("*").alias("n")).orderBy("task_family").collect()}
    return {**report, "compiler_version": manifest["compiler_version"], "seed": manifest["seed"], "task_families": families, "artifacts": [sinks.check(root, o) for o in manifest["outputs"]]}


def reference_eval(tasks: DataFrame, root: str | None, split: str) -> dict:
    """Tasks answered from their own keys and scored: the summary; with ``root`` also responses, ledgers and evaluation as artefacts."""
    audit.demand_empty(audit.duplicates(tasks, "task_id"), "repeated task ids")
    responses = written(export.symbolic_responses(tasks), "responses")
    ledgers = written(verify.verify(responses, tasks), "ledgers")
    scores = verify.score_summary(ledgers).first()
    families = {r["task_family"]: r["n"] for r in tasks.groupBy("task_family").agg(F.count("*").alias("n")).orderBy("task_family").collect()}
    means = {r["component_id"]: r["mean_score"] for r in verify.component_means(ledgers).orderBy("component_id").collect()}
    likeness = verify.fidelity(responses, tasks).agg(F.avg("fidelity")).first()[0]
    summary = {
        "reference_type": "symbolic-answer-key", "neural_model": False, "model_id": "symbolic-answer-key", "split": split, "count": scores["n"], "mean_total_score": scores["mean_score"], "min_total_score": scores["min_score"], "max_total_score": scores["max_score"],
        "task_family_counts": families, "mean_reference_answer_fidelity_unscored": likeness, "component_means": means,
    }
    if root is None:
        return summary
    refs = [sinks.write_lines(responses, root, "responses.jsonl", "task_id"), sinks.write_lines(ledgers, root, "reward_ledgers.jsonl", "task_id"), sinks.write_json(root, "evaluation.json", summary)]
    return {**summary, "output_dir": os.path.realpath(root), "artifacts": [r.as_dict() for r in refs]}


def check_package(tasks: DataFrame, root: str, test_only: bool = False) -> None:
    """Raise unless packaging the tasks again gives the files under ``root`` byte for byte."""
    with tempfile.TemporaryDirectory() as again:
        package_taskset(tasks, again, test_only)
        for name in ("taskset.jsonl.gz", "taskset-manifest.json"):
            there = os.path.join(root, name)
            if not os.path.isfile(there) or not filecmp.cmp(there, os.path.join(again, name), shallow=False):
                raise ValueError(f"{name} is missing or stale")


def package_taskset(tasks: DataFrame, root: str, test_only: bool = False) -> dict:
    """Single-unit tasks as deterministic gzip JSON lines with a manifest of counts and hashes."""
    packaged = export.packaged(tasks)
    if test_only:
        packaged = packaged.where("split = 'test'")
    packaged = written(packaged, "packaged")
    ref = sinks.write_lines(packaged, root, "taskset.jsonl.gz", "idx", compress=True)
    count = lambda c: {r[0]: r[1] for r in packaged.groupBy(c).count().orderBy(c).collect()}
    groups = {r[0]: r[1] for r in packaged.groupBy("split").agg(F.countDistinct("group_id")).collect()}
    shared = audit.overlaps(packaged, "group_id")
    audit.demand_empty(shared, "groups in two splits")
    manifest = {"taskset": ref.as_dict(), "splits": count("split"), "task_families": count("task_family"), "groups": groups, "nonempty": export.key_counts(packaged).first().asDict()}
    sinks.write_json(root, "taskset-manifest.json", manifest)
    return manifest
