"""Template compiler: knowledge units x task families -> tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import schemas
from tessera.functions.canonical import training_json
from tessera.functions.text import digest, joined_by_nul, strip
from tessera.operators.verify import scoring_key

TEMPLATE_VERSION = "1"
GENERATOR = "template"

#: (family, assignment, tags): wording is ours, families and tags are the contract
TEMPLATES = (
    ("standard_operation", "Describe how the source is carried out in the ordinary case and list every action it demands.", ("standard", "application")),
    ("edge_case", "Decide a borderline case by the source's stated conditions alone.", ("edge-case", "conditions")),
    ("conflict_resolution", "Two instructions collide; settle the matter by the constraints the source states.", ("conflict", "constraints")),
    ("exception_handling", "Say which exception applies, under which condition, and what then changes.", ("exception", "conditions")),
    ("violation_check", "Check the described conduct against the source and name each breach.", ("violation", "verification")),
    ("adversarial_distractor", "Answer from the source only and reject plausible claims it does not support.", ("adversarial", "grounding")),
)


def rule_family() -> Column:
    """Family, else section, else the unit's id; empty counts as missing."""
    return F.coalesce(F.nullif("family", F.lit("")), F.nullif("section", F.lit("")), F.col("unit_id"))


def task_id(unit: Column, family: Column, generator: str = GENERATOR, prefix: str = "task-") -> Column:
    return F.concat(F.lit(prefix), digest(joined_by_nul(F.lit(generator), unit, family), 20))


def prompt(instruction: Column) -> Column:
    lines = [
        F.concat(F.lit("Task family: "), F.col("task_family")),
        F.concat(F.lit("Source unit: "), F.col("unit_id")),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("Section: "), F.nullif("section", F.lit(""))),
        F.lit(""),
        F.lit("Source text:"),
        strip(F.col("text")),
        F.lit(""),
        F.lit("Assignment:"),
        instruction,
    ]
    return strip(F.concat_ws("\n", *lines))


def reference_text() -> Column:
    """Source text, then one line for each non-empty list."""
    parts = (("Conditions", "conditions"), ("Required actions", "required_actions"), ("Forbidden actions", "forbidden_actions"), ("Procedure", "procedure_steps"), ("Exceptions", "exceptions"), ("Terms", "terms"))
    return F.concat_ws("\n", strip(F.col("text")), *[F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, "; "))) for name, c in parts])


def answer_head(key: str = "answer_key") -> Column:
    """The sorted ASCII JSON of the key's answer up to its last field, the task family, which is all that differs between a unit's tasks."""
    final = F.coalesce(F.nullif(f"{key}.reference_answer", F.lit("")), F.array_join(f"{key}.required_actions", "; "))
    parts = {"applicable_rules": "applicable_unit_ids", "final_answer": final, "forbidden_actions": "forbidden_actions", "procedure_order": "procedure_order", "required_actions": "required_actions"}
    record = F.struct(*[(F.col(f"{key}.{c}") if isinstance(c, str) else c).alias(n) for n, c in parts.items()], F.lit(schemas.SCHEMA_VERSION).alias("schema_version"))
    body = training_json(record)
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(', "situation_type": '))


def compile_units(units: DataFrame, templates=TEMPLATES, generator: str = GENERATOR, prefix: str = "task-", scored: bool = False, trained: bool = False) -> DataFrame:
    """One task for each unit and template.

    The templates, a handful of rows by contract, are broadcast; the reference
    answer is made once a unit, before the expansion. So are, on request, what scoring
    reads of the key (``scored``: scoring_key) and the beginning of the answer's JSON
    (``trained``: answer_head), which would else be made for every task."""
    families = [t[0] for t in templates]
    if len(set(families)) != len(families) or not set(schemas.FAMILIES) <= set(families):
        raise ValueError("templates must name each core family exactly once")
    table = units.sparkSession.createDataFrame([(i, *t[:2], list(t[2]), json.dumps(t[0])) for i, t in enumerate(templates)], "family_index int, task_family string, instruction string, template_tags array<string>, family_json string")
    key = F.struct(
        F.array("unit_id").alias("applicable_unit_ids"),
        "required_actions",
        "forbidden_actions",
        F.col("procedure_steps").alias("procedure_order"),
        "terms",
        reference_text().alias("reference_answer"),
        "citations",
    )
    keyed = units.withColumn("answer_key", key)
    more = []
    if scored:
        keyed = keyed.withColumn("scoring_key", scoring_key())
        more += ["scoring_key"]
    if trained:
        keyed = keyed.withColumn("answer_head", answer_head())
        more += ["answer_head", "family_json"]
    return (
        keyed
        .crossJoin(F.broadcast(table))
        .select(
            task_id(F.col("unit_id"), F.col("task_family"), generator, prefix).alias("task_id"),
            prompt(F.col("instruction")).alias("prompt"),
            "task_family",
            "family_index",
            F.array("unit_id").alias("knowledge_unit_ids"),
            "answer_key",
            "citations",
            rule_family().alias("rule_family"),
            F.concat(F.array(F.lit("template-compiled")), F.col("template_tags")).alias("tags"),
            F.lit(generator).alias("generator"),
            F.struct(F.lit(TEMPLATE_VERSION).alias("template_version"), F.col("unit_id").alias("primary_unit_id"), F.col("kind").alias("source_kind")).alias("metadata"),
            *more,
        )
    )
