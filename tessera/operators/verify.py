"""Deterministic scoring of structured answers into component ledgers."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import schemas
from tessera.functions import text as T

SAFETY = "safety_critical_required_actions"
FORBIDDEN = "forbidden_unsafe_actions_absent"
RULE = "correct_applicable_rule_cited"
PROCEDURE = "procedure_order_correct"
TERMINOLOGY = "domain_terminology_correct"
WEIGHTS = {SAFETY: 0.40, FORBIDDEN: 0.20, RULE: 0.15, PROCEDURE: 0.15, TERMINOLOGY: 0.10}
INVALID_NOTE = "the response does not satisfy the answer contract"

_LISTS = ("applicable_rules", "required_actions", "forbidden_actions", "procedure_order")


def weights_of(overrides: dict | None = None) -> dict[str, float]:
    """Weights merged over the defaults and normalised to one, in component order."""
    unknown = sorted(set(overrides or {}) - set(WEIGHTS))
    if unknown:
        raise ValueError(f"unknown reward components: {', '.join(unknown)}")
    chosen = {k: float((overrides or {}).get(k, w)) for k, w in WEIGHTS.items()}
    if any(not math.isfinite(w) or w < 0 for w in chosen.values()):
        raise ValueError("weights must be finite and not negative")
    total = sum(chosen.values())
    if total <= 0:
        raise ValueError("a weight must be positive")
    return chosen if abs(total - 1) <= 1e-12 else {k: w / total for k, w in chosen.items()}


def parse_answer(raw: str | None, allow_version: bool = True) -> dict | None:
    """A strictly valid answer with defaults filled in, or None."""
    try:
        value = json.loads(raw)
    except (TypeError, ValueError):
        return None
    known = {*schemas.ANSWER_FIELDS, *(("schema_version",) if allow_version else ())}
    if not isinstance(value, dict) or set(value) - known or value.get("schema_version", schemas.SCHEMA_VERSION) != schemas.SCHEMA_VERSION:
        return None
    out: dict = {"situation_type": value.get("situation_type"), "final_answer": value.get("final_answer", "")}
    for field in _LISTS:
        out[field] = value.get(field, [])
        if not isinstance(out[field], list) or any(not isinstance(x, str) for x in out[field]):
            return None
    if not isinstance(out["final_answer"], str) or not (out["situation_type"] is None or isinstance(out["situation_type"], str)):
        return None
    return out


def parsed(raw: Column, allow_version: bool = True) -> Column:
    """Answer struct of a raw JSON text, null where it is invalid."""

    def valid(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (a := parse_answer(t, allow_version)) is None else json.dumps(a))

    return F.from_json(F.pandas_udf(valid, StringType())(raw), schemas.ANSWER)


def _listed(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def scoring_key(key: str = "answer_key") -> Column:
    """What scoring reads of an answer key: the first item of each normal form, (k, v), of every list. An item of several lists is normalised once."""
    lists = {"req": "required_actions", "forb": "forbidden_actions", "rule": "applicable_unit_ids", "proc": "procedure_order", "term": "terms"}
    given = {n: _listed(F.col(f"{key}.{c}")) for n, c in lists.items()}

    def keyed(items: Column, norms: Column) -> Column:
        of = lambda values: F.transform(values, lambda x: F.get(norms, F.array_position(items, x).cast("int") - 1))
        return F.struct(*[T.unique_keys(of(values), values).alias(n) for n, values in given.items()])

    return T.let(F.array_distinct(F.concat(*given.values())), lambda items: T.let(F.transform(items, T.normalize), lambda norms: keyed(items, norms)))


def verify(
    responses: DataFrame,
    tasks: DataFrame | None = None,
    weights: dict | None = None,
    hard_gate: bool = True,
    threshold: float = 1.0,
    evidence: bool = True,
    allow_version: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One ledger for each response.

    ``responses``: task_id, response_id (null: ``<task_id>.response``), and a
    struct ``answer`` that is trusted, or ``raw_text`` that is parsed strictly
    where ``answer`` is null or absent; only that parsing runs in Python. ``tasks`` may
    bring the column ``scoring_key`` that ``scoring_key()`` makes, once a unit instead of
    once a task. Without ``tasks`` every response brings its own task's ``scoring_key``, as those
    made from tasks row by row can: then nothing is joined or shuffled. ``keep`` names columns of
    ``responses`` to pass on. ``evidence=False`` leaves out the evidence and notes of components.
    A response to an unknown task is an error; task ids must be unique
    (``audit.duplicates``), as every build's are."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    w = weights_of(weights)
    answer = F.col("answer") if "answer" in responses.columns else F.lit(None).cast(schemas.ANSWER)
    if "raw_text" in responses.columns:
        answer = F.coalesce(answer, parsed(F.when(answer.isNull(), F.col("raw_text")), allow_version))
    own = [F.col("scoring_key").alias("key")] if tasks is None else []
    given = responses.select("task_id", F.coalesce("response_id", F.concat("task_id", F.lit(".response"))).alias("response_id") if "response_id" in responses.columns else F.concat("task_id", F.lit(".response")).alias("response_id"), answer.alias("given"), *own, *keep)
    if tasks is None:
        rows = given
    else:
        known = tasks.select("task_id", (F.col("scoring_key") if "scoring_key" in tasks.columns else scoring_key()).alias("key"))
        rows = given.join(known, "task_id", "left")
    stray = F.raise_error(F.concat(F.lit("response to an unknown task: "), F.coalesce("task_id", F.lit("null")))).cast("string")
    rows = rows.withColumn("task_id", F.when(F.col("key").isNotNull(), F.col("task_id")).otherwise(stray))
    # each list is normalised once, before anything is scored; items that are the key's own, letter by letter, have their forms there
    lists = {"a_req": ("required_actions", ("req", "forb", "proc")), "a_forb": ("forbidden_actions", ("forb", "req")), "a_rule": ("applicable_rules", ("rule",)), "a_proc": ("procedure_order", ("proc",))}
    rows = rows.select(
        "task_id", "response_id", *keep, F.col("given").isNotNull().alias("valid"),
        *[T.normal_forms(_listed(F.col(f"given.{c}")), F.concat(*[F.col(f"key.{n}") for n in near])).alias(a) for a, (c, near) in lists.items()],
        F.coalesce("given.final_answer", F.lit("")).alias("final"), *[F.col(f"key.{n}").alias(n) for n in ("req", "forb", "rule", "proc", "term")],
    )
    rows = (
        rows.withColumn("m_req", T.held(F.col("req"), F.col("a_req")))
        .withColumn("m_forb", T.held(F.col("forb"), F.col("a_forb")))
        .withColumn("m_rule", T.held(F.col("rule"), F.col("a_rule")))
        .withColumn("m_term", T.phrases_in_text(F.col("term"), F.col("final")))
        .withColumn("unsafe", T.held(F.col("forb"), F.concat("a_req", "a_proc")))
        .withColumn("proc_keys", F.transform("proc", lambda p: p.k))
        .withColumn("places", T.lcs_places("proc_keys", "a_proc"))
        .withColumn("m_proc", F.transform("places", lambda i: F.get("proc", i)))
    )
    lcs = F.size("places")
    found = {
        SAFETY: ("req", T.share(F.col("m_req"), F.col("req")), "m_req"),
        FORBIDDEN: ("forb", F.when(F.size("unsafe") > 0, 0.0).otherwise(T.share(F.col("m_forb"), F.col("forb"))), "m_forb"),
        RULE: ("rule", T.share(F.col("m_rule"), F.col("rule")), "m_rule"),
        PROCEDURE: ("proc", F.when(F.size("proc") == 0, 1.0).otherwise(lcs / F.size("proc")), "m_proc"),
        TERMINOLOGY: ("term", T.share(F.col("m_term"), F.col("term")), "m_term"),
    }
    for i, (_, score, _) in enumerate(found.values()):
        rows = rows.withColumn(f"score_{i}", F.when(F.col("valid"), score).otherwise(0.0))
    empty = F.array().cast("array<string>")
    components = []
    for i, (component, (expected, _, matched)) in enumerate(found.items()):
        score = F.col(f"score_{i}")
        if evidence:
            missing = T.texts(T.lacking(F.col(expected), F.transform(matched, lambda p: p.k)))
            label = "not identified as forbidden: " if component == FORBIDDEN else "missing: "
            notes = [F.when(F.size(missing) > 0, F.concat(F.lit(label), F.array_join(missing, "; ")))]
            if component == FORBIDDEN:
                notes.append(F.when(F.size("unsafe") > 0, F.concat(F.lit("positively recommended: "), F.array_join(T.texts(F.col("unsafe")), "; "))))
            proof = F.when(F.col("valid"), T.texts(F.col(matched))).otherwise(empty)
            note = F.when(F.col("valid"), F.nullif(F.concat_ws(" | ", *notes), F.lit(""))).otherwise(F.lit(INVALID_NOTE))
        else:
            proof, note = empty, F.lit(None).cast("string")
        components.append(F.struct(F.lit(component).alias("component_id"), F.lit(w[component]).alias("weight"), score.alias("score"), (F.lit(w[component]) * score).alias("weighted_score"), proof.alias("evidence"), note.alias("notes")))
    total = lambda x: F.when(F.abs(x - 1) <= 1e-9, 1.0).otherwise(x)
    rows = rows.withColumn("components", F.array(*components)).withColumn("ungated_total_score", total(F.aggregate("components", F.lit(0.0), lambda s, c: s + c.weighted_score)))
    low = F.lit(hard_gate) & F.col("valid") & (F.col("score_0") < threshold)
    bad = F.lit(hard_gate) & F.col("valid") & (F.size("unsafe") > 0)
    gate = F.when(low | bad | (F.lit(hard_gate) & ~F.col("valid")), 0.0).otherwise(1.0)
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("valid"), "structured answer is invalid"),
            F.when(low, F.concat(F.lit("required-action coverage "), T.short_number(F.col("score_0")), F.lit(" is below "), T.short_number(F.lit(float(threshold))))),
            F.when(bad, F.concat(F.lit("forbidden actions are recommended: "), F.array_join(T.texts(F.col("unsafe")), "; "))),
        )
    )
    rows = rows.withColumn("gate_multiplier", gate).withColumn("total_score", total(F.col("ungated_total_score") * F.col("gate_multiplier")))
    diagnostics = F.struct(
        F.col("valid").cast("double").alias("schema_validity"),
        F.col("score_2").alias("source_grounding"),
        (F.col("valid") & (F.size("unsafe") > 0)).cast("double").alias("unsafe_recommendation_detected"),
        (F.col("gate_multiplier") == 0).cast("double").alias("safety_gate_applied"),
        F.when(F.size(reasons) > 0, reasons).alias("safety_gate_reasons"),
    )
    return rows.select("task_id", "response_id", *keep, "components", "ungated_total_score", "gate_multiplier", "total_score", diagnostics.alias("diagnostics"))


def unanswerable(responses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Responses that name no known task, which ``verify`` refuses."""
    return responses.join(tasks.select("task_id"), "task_id", "left_anti")


def component_rows(ledgers: DataFrame) -> DataFrame:
    """One row for each component of each ledger.

    The outer form adds no rows here, and keeps the optimizer from scoring twice to
    test that the array is not empty."""
    return ledgers.select("task_id", "response_id", "total_score", "diagnostics", F.inline_outer("components"))


def component_means(ledgers: DataFrame) -> DataFrame:
    return component_rows(ledgers).groupBy("component_id").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def score_summary(ledgers: DataFrame) -> DataFrame:
    return ledgers.agg(F.count("*").alias("n"), F.avg("total_score").alias("mean_score"), F.min("total_score").alias("min_score"), F.max("total_score").alias("max_score"))


def fidelity(responses: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(task_id, response_id, fidelity): likeness of each answer's text to its reference text, both normalised; unscored.

    0 without a valid answer or a reference; a valid answer without text counts as empty.
    Without ``tasks`` every response brings its own task's ``reference_answer``, and nothing is
    joined. Texts that are equal, the usual case of references themselves, are 1 without being
    normalised or compared; an empty form has nothing in common with any other."""
    said = F.when(F.col("answer").isNotNull(), F.coalesce("answer.final_answer", F.lit(""))).alias("said")
    if tasks is None:
        rows = responses.select("task_id", "response_id", said, F.coalesce("reference_answer", F.lit("")).alias("reference"))
    else:
        rows = responses.select("task_id", "response_id", said).join(tasks.select("task_id", F.coalesce("answer_key.reference_answer", F.lit("")).alias("reference")), "task_id")
    scored = F.col("said").isNotNull() & (F.col("reference") != "")
    rows = rows.withColumn("alike", scored & (F.col("said") == F.col("reference")))
    rows = rows.withColumn("a", F.when(scored & ~F.col("alike"), T.normalize(F.col("said"))))
    # of what an empty form meets, only whether it is empty too matters
    some = F.coalesce(F.get(T.first_words(F.col("reference"), 1), F.lit(0)), F.lit(""))
    rows = rows.withColumn("b", F.when(F.col("a") == "", some).when(F.col("a").isNotNull(), T.normalize(F.col("reference"))))
    differs = (F.col("a") != F.col("b")) & (F.col("a") != "") & (F.col("b") != "")
    likeness = T.similarity(F.when(differs, F.col("a")), F.when(differs, F.col("b")))
    return rows.select("task_id", "response_id", F.when(F.col("alike") | (F.col("a") == F.col("b")), 1.0).when(differs, likeness).otherwise(0.0).alias("fidelity"))


def metrics(ledgers: DataFrame, likeness: DataFrame | None = None) -> DataFrame:
    """Components and diagnostics as columns of one row a response; with ``fidelity``'s rows also reference_fidelity."""
    out = ledgers.select(
        "task_id",
        "response_id",
        *[F.element_at("components", i + 1).score.alias(f"component_{k}") for i, k in enumerate(WEIGHTS)],
        F.col("ungated_total_score").alias("ungated_total"),
        "gate_multiplier",
        F.col("diagnostics.schema_validity").alias("schema_validity"),
        "total_score",
    )
    if likeness is None:
        return out
    return out.join(likeness, ["task_id", "response_id"], "left").withColumnRenamed("fidelity", "reference_fidelity")


def gold_valid(ledgers: DataFrame) -> DataFrame:
    """Whether each answer earns full reward under a ledger that reconciles."""
    return ledgers.select("task_id", is_gold().alias("valid"))


def is_gold() -> Column:
    """``gold_valid`` of a ledger's own row, with no second scoring to join."""
    parts = F.aggregate("components", F.lit(0.0), lambda s, c: s + c.weighted_score)
    return (F.col("total_score") == 1.0) & (F.abs(parts - F.col("ungated_total_score")) <= 1e-9)


def rubric_reward(safety: Column, procedure: Column, terminology: Column) -> Column:
    """Reward from three graded scores."""
    return 0.5 * safety + 0.3 * procedure + 0.2 * terminology
