"""Command line: compile, validate, inspect, export, reference-eval and package over build directories."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.canonical import record_json
from tessera.operators import build, export, importers
from tessera.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compile")
    c.add_argument("--volume-id", required=True)
    c.add_argument("--output", required=True)
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("--units")
    source.add_argument("--rules")
    c.add_argument("--rule-tasks")
    c.add_argument("--document-id", default="document")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--group-by", choices=("rule_family", "knowledge_unit", "knowledge_component"), default="rule_family")
    c.add_argument("--source-revision")
    for name in ("validate", "inspect", "inspect-artifacts"):
        commands.add_parser(name).add_argument("build")
    e = commands.add_parser("export")
    e.add_argument("build")
    e.add_argument("--format", choices=("sft", "grpo"), required=True)
    e.add_argument("--split", default="train")
    e.add_argument("--output", required=True)
    r = commands.add_parser("reference-eval")
    r.add_argument("build")
    r.add_argument("--split", default="test")
    r.add_argument("--output")
    k = commands.add_parser("package")
    k.add_argument("build")
    k.add_argument("--output", required=True)
    k.add_argument("--test-only", action="store_true")
    k.add_argument("--check", action="store_true")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    if args.command == "compile":
        if args.rule_tasks and not args.rules:
            raise ValueError("--rule-tasks needs --rules")
        imported = None
        if args.units:
            units = readers.read_units(spark, args.units)
        else:
            rules = readers.read_records(spark, args.rules, importers.RULE, "rules")
            given = readers.read_records(spark, args.rule_tasks, importers.RULE_TASK, "tasks") if args.rule_tasks else None
            units, imported = importers.import_bundle(rules, given, args.document_id)
            units = units.drop("legacy_rule_id", "path")
        return build.compile_build(units, args.output, args.volume_id, args.seed, args.group_by, imported, args.source_revision)
    if args.command == "validate":
        return build.validate_build(spark, args.build)
    if args.command in ("inspect", "inspect-artifacts"):
        return build.inspect_build(spark, args.build)
    _, _, tasks = build.load_build(spark, args.build)
    if args.command == "package":
        if args.check:
            build.check_package(tasks, args.output, args.test_only)
            return {"reproducible": True}
        return build.package_taskset(tasks, args.output, args.test_only)
    tasks = build.select_split(tasks, args.split)
    if args.command == "export":
        records = export.sft_records(tasks) if args.format == "sft" else export.grpo_records(tasks)
        ref = sinks.write_lines(records.select("id", record_json(F.struct(*records.columns)).alias("line")), args.output, f"{args.format}-{args.split}.jsonl", "id", text="line")
        return {**ref.as_dict(), "format": args.format, "split": args.split}
    return build.reference_eval(tasks, args.output, args.split)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        print(json.dumps(run(args, spark), indent=2, sort_keys=True, default=str))
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except PySparkException as e:  # records that a reader or importer refused
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
