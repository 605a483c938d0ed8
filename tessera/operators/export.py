"""Trainer records and the packaged task set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import schemas
from tessera.functions.canonical import training_json
from tessera.functions.text import digest
from tessera.operators.segments import numbered

SYSTEM_PROMPT = "Answer from the cited source alone and fill in every field of the JSON contract."
RESPONSE_CONTRACT = "Reply with one JSON object that has these keys and no others: " + ", ".join(schemas.ANSWER_FIELDS) + "."


def reference_answer() -> Column:
    """The answer that a task's own key gives."""
    key = "answer_key"
    return F.struct(
        F.col(f"{key}.applicable_unit_ids").alias("applicable_rules"),
        F.col("task_family").alias("situation_type"),
        F.col(f"{key}.required_actions").alias("required_actions"),
        F.col(f"{key}.forbidden_actions").alias("forbidden_actions"),
        F.col(f"{key}.procedure_order").alias("procedure_order"),
        F.coalesce(F.nullif(f"{key}.reference_answer", F.lit("")), F.array_join(f"{key}.required_actions", "; ")).alias("final_answer"),
    )


def symbolic_responses(tasks: DataFrame) -> DataFrame:
    """Each task answered from its own key; its scoring key, if there is one, comes along."""
    own = [c for c in ("scoring_key",) if c in tasks.columns]
    return tasks.select("task_id", F.concat(F.lit("symbolic-"), digest(F.col("task_id"), 16)).alias("response_id"), reference_answer().alias("answer"), *own)


def _metadata(tasks: DataFrame) -> Column:
    return F.struct("knowledge_unit_ids", "task_family", (F.col("split") if "split" in tasks.columns else F.lit(None).cast("string")).alias("split"))


def sft_records(tasks: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Chats of three messages; the assistant's is the reference answer as sorted ASCII JSON.

    Tasks compiled with ``trained`` bring that JSON's beginning, made once a unit."""
    if "answer_head" in tasks.columns:
        content = F.concat("answer_head", "family_json", F.lit("}"))
    else:
        content = training_json(F.struct(*[reference_answer()[f].alias(f) for f in schemas.ANSWER_FIELDS], F.lit(schemas.SCHEMA_VERSION).alias("schema_version")))
    said = tasks.withColumn("content", content)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return said.select(F.col("task_id").alias("id"), F.array(message("system", F.lit(system_prompt)), message("user", F.col("prompt")), message("assistant", F.col("content"))).alias("messages"), _metadata(tasks).alias("metadata"))


def grpo_records(tasks: DataFrame) -> DataFrame:
    """Prompts with the key apart, for reward-based trainers."""
    contract = F.struct(F.lit("structured_answer_json").alias("format"), F.array(*[F.lit(f) for f in schemas.ANSWER_FIELDS]).alias("fields"))
    return tasks.select(F.col("task_id").alias("id"), "prompt", contract.alias("answer_contract"), "answer_key", _metadata(tasks).alias("metadata"))


def packaged(tasks: DataFrame) -> DataFrame:
    """Single-unit tasks with their response contract, group and position by task id.

    Ids alone are sorted, by ranges, whatever they look like; the tasks move once, to meet their positions."""
    single = tasks.where(F.size("knowledge_unit_ids") == 1)
    places = numbered(single.select("task_id"), "task_id").select("task_id", (F.col("row_number") - 1).alias("idx"))
    placed = single.join(places, "task_id")
    return placed.select("idx", "task_id", F.concat("prompt", F.lit("\n\n" + RESPONSE_CONTRACT)).alias("prompt"), "split", "task_family", "knowledge_unit_ids", F.col("knowledge_unit_ids")[0].alias("group_id"), "answer_key", "citations")


def _content(c: str | Column) -> Column:
    """SHA-256 of a value of any type, nulls and empty lists told apart, in 32 bytes."""
    value = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.sha2(F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"}), 256))


def parity_faults(tasks: DataFrame, package: DataFrame) -> DataFrame:
    """(task_id, fault): single-unit tasks and packaged ones that do not stand for each other.

    Prompts and keys, which hold whole texts, are compared by SHA-256 of their content, so that only ids and digests meet."""
    mine = tasks.where(F.size("knowledge_unit_ids") == 1).select("task_id", F.unhex(F.sha2(F.concat("prompt", F.lit("\n\n" + RESPONSE_CONTRACT)), 256)).alias("prompt"), "split", "task_family", "knowledge_unit_ids", _content("answer_key").alias("answer_key"))
    told = {"prompt": F.unhex(F.sha2("prompt", 256)), "answer_key": _content("answer_key")}
    theirs = package.select(F.col("task_id").alias("id"), *[told.get(c, F.col(c)).alias(f"p_{c}") for c in mine.columns[1:]])
    both = mine.join(theirs, F.col("task_id") == F.col("id"), "full")
    here = F.col("task_id").isNotNull() & F.col("id").isNotNull()
    checks = {"not packaged": F.col("id").isNull(), "no such task": F.col("task_id").isNull()} | {f"another {c}": here & ~F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in mine.columns[1:]}
    faults = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return both.select(F.coalesce("task_id", "id").alias("task_id"), F.explode(faults).alias("fault"))


def trace_id() -> Column:
    return digest(F.concat("task_id", F.lit(":symbolic-answer-key")), 32)


def key_counts(tasks: DataFrame) -> DataFrame:
    """How many tasks have something in each list of their key."""
    filled = lambda c: F.coalesce(F.sum(F.when(F.size(c) > 0, 1)), F.lit(0)).cast("long")
    return tasks.agg(filled("answer_key.required_actions").alias("required"), filled("answer_key.forbidden_actions").alias("forbidden"), filled("answer_key.procedure_order").alias("procedure"), filled("answer_key.terms").alias("terms"))
