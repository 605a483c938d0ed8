"""Failure clusters by component, and the curriculum they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical_column
from tessera.functions.schemas import SEVERITIES
from tessera.operators.verify import FORBIDDEN, SAFETY, component_rows
from tessera.sources.work import written


def ordered_distinct(position: Column, value: Column) -> Column:
    """Aggregate: distinct values by first occurrence along ``position``."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda x: x.v))


def severity() -> Column:
    return (
        F.when(F.col("component") == SAFETY, "critical")
        .when((F.col("component") == FORBIDDEN) & (F.col("unsafe") > 0), "critical")
        .when(F.col("mean_score") <= 0.25, "high")
        .when(F.col("mean_score") <= 0.5, "medium")
        .otherwise("low")
    )


def rank_order() -> list[Column]:
    priority = F.when(F.col("component") == SAFETY, 3).when(F.col("component") == FORBIDDEN, 2).otherwise(1)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return [priority.desc(), rank.desc(), F.col("count").desc(), F.col("component"), F.col("cluster_id")]


def failing(ledgers: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Component rows scored under the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return component_rows(ledgers).where(F.col("score") < threshold).withColumnRenamed("component_id", "component")


def cluster_summary(ledgers: DataFrame, threshold: float = 1.0, minimum: int = 1) -> DataFrame:
    """(cluster_id, component, severity, count, mean_score): no member lists, so partial sums are all that moves."""
    return _summary(failing(ledgers, threshold), minimum)


def _summary(rows: DataFrame, minimum: int) -> DataFrame:
    if minimum < 1:
        raise ValueError("minimum must be at least 1")
    grouped = rows.groupBy("component").agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"), F.max("diagnostics.unsafe_recommendation_detected").alias("unsafe"))
    return grouped.where(F.col("count") >= minimum).withColumn("severity", severity()).select(F.concat(F.lit("failure:"), "component").alias("cluster_id"), "component", "severity", "count", "mean_score")


def cluster_failures(ledgers: DataFrame, tasks: DataFrame | None = None, threshold: float = 1.0, minimum: int = 1) -> DataFrame:
    """Clusters with task_ids, knowledge_unit_ids and evidence, each in order of first occurrence by (task_id, response_id).

    The lists are the result's contract and grow with the failures; where counts
    are enough use ``cluster_summary``. The failing rows are written once, since
    counts and lists all read them."""
    rows = written(failing(ledgers, threshold), "failing")
    at = F.struct("task_id", "response_id")
    lists = rows.groupBy("component").agg(ordered_distinct(at, F.col("task_id")).alias("task_ids"))
    proof = rows.select("component", at.alias("at"), F.posexplode(F.concat("evidence", F.when(F.col("notes").isNotNull(), F.array("notes")).otherwise(F.array().cast("array<string>")))))
    proof = proof.groupBy("component").agg(ordered_distinct(F.struct("at", "pos"), F.col("col")).alias("evidence"))
    out = _summary(rows, minimum).join(lists, "component").join(proof, "component", "left")
    if tasks is None:
        units = F.array().cast("array<string>")
    else:
        known = rows.select("component", "task_id").distinct().join(tasks.select("task_id", F.posexplode("knowledge_unit_ids")), "task_id")
        out = out.join(known.groupBy("component").agg(ordered_distinct(F.struct("task_id", "pos"), F.col("col")).alias("knowledge_unit_ids")), "component", "left")
        units = F.coalesce("knowledge_unit_ids", F.array().cast("array<string>"))
    return out.select("cluster_id", "component", "severity", "count", "mean_score", "task_ids", units.alias("knowledge_unit_ids"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def cluster_members(ledgers: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(cluster_id, component, task_id, first_response, n): the tasks of each cluster as rows, so that no row grows with the failures."""
    rows = failing(ledgers, threshold).groupBy("component", "task_id").agg(F.min("response_id").alias("first_response"), F.count("*").alias("n"))
    return rows.select(F.concat(F.lit("failure:"), "component").alias("cluster_id"), "component", "task_id", "first_response", "n")


def curriculum_summary(ledgers: DataFrame, tasks: DataFrame, limit: int | None = None, threshold: float = 1.0, minimum: int = 1) -> DataFrame:
    """The ranked requests with counts in place of lists: (request_id, component, priority, severity, count, n_tasks, n_units, task_family).

    Clusters are ranked from partial sums first; only members of those that stay meet
    their tasks. ``cluster_members`` has the members."""
    rows = written(failing(ledgers, threshold).select("component", "task_id", "score", "diagnostics"), "failing")
    ranked = written(rank_clusters(_summary(rows, minimum), limit), "ranked")  # as many rows as components
    members = rows.join(F.broadcast(ranked.select("component")), "component").select("component", "task_id").distinct()
    known = written(members.join(tasks.select("task_id", "task_family", "knowledge_unit_ids"), "task_id", "left"), "members")
    told = known.groupBy("component").agg(F.count("*").alias("n_tasks"), F.min_by("task_family", F.when(F.col("task_family").isNotNull(), F.col("task_id"))).alias("family"))
    units = known.select("component", F.explode("knowledge_unit_ids").alias("unit")).distinct().groupBy("component").agg(F.count("*").alias("n_units"))
    out = ranked.join(told, "component").join(units, "component", "left")
    return out.select(F.concat(F.lit("curriculum:"), "cluster_id").alias("request_id"), "component", "priority", "severity", "count", "n_tasks", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("family", F.lit("applied_scenario")).alias("task_family"))


def goal() -> Column:
    aim = (
        F.when(F.col("component") == SAFETY, "drill each mandatory action until none is left out")
        .when(F.col("component") == FORBIDDEN, "spot prohibited conduct and put a safe action in its place")
        .otherwise(F.concat(F.lit("raise the score of "), "component"))
    )
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f" {label}: "), F.array_join(c, "; "), F.lit(".")))
    return F.concat(F.lit("Write cited scenarios that "), aim, F.lit("; keep citations, contract and scorer unchanged."), F.coalesce(listed("Required actions", "expected_required_actions"), F.lit("")), F.coalesce(listed("Unsafe counterexamples", "unsafe_counterexamples"), F.lit("")))


def rank_clusters(clusters: DataFrame, limit: int | None = None) -> DataFrame:
    """Clusters with a 1-based ``priority``; there are as many clusters as components, so one task ranks them."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    out = clusters.withColumn("priority", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*rank_order())))
    return out if limit is None else out.where(F.col("priority") <= limit)


def build_curriculum(clusters: DataFrame, tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """One request for each ranked cluster, grounded in its source tasks."""
    ranked = written(rank_clusters(clusters, limit), "ranked")
    source = ranked.select("cluster_id", F.posexplode("task_ids").alias("at", "task_id")).join(tasks, "task_id")
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x.v)))
    found = source.groupBy("cluster_id").agg(
        flat("answer_key.required_actions").alias("required"), flat("answer_key.forbidden_actions").alias("forbidden"), flat("knowledge_unit_ids").alias("units"),
        flat("citations").alias("citations"), F.min_by("task_family", "at").alias("family"),
    )
    empty = F.array().cast("array<string>")
    out = ranked.join(found, "cluster_id", "left").select(
        F.concat(F.lit("curriculum:"), "cluster_id").alias("request_id"),
        F.col("cluster_id").alias("failure_cluster_id"),
        "component",
        F.coalesce("family", F.lit("applied_scenario")).alias("task_family"),
        F.when(F.size("knowledge_unit_ids") > 0, F.col("knowledge_unit_ids")).otherwise(F.coalesce("units", empty)).alias("knowledge_unit_ids"),
        F.col("task_ids").alias("parent_task_ids"),
        "citations",
        F.lit("targeted").alias("difficulty"),
        "priority",
        F.coalesce("required", empty).alias("expected_required_actions"),
        F.coalesce("forbidden", empty).alias("unsafe_counterexamples"),
    )
    return out.withColumn("goal", goal())


def curriculum_records(clusters: DataFrame, tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """(request_id, priority, record): the requests of ``build_curriculum`` as canonical JSON, for a next batch's JSON lines."""
    requests = build_curriculum(clusters, tasks, limit)
    return requests.select("request_id", "priority", canonical_column(*requests.columns).alias("record"))


def run_means(ledgers: DataFrame, run: str) -> DataFrame:
    """(run, kind, name, mean, n) of each run: its total, components, diagnostics and the share of ledgers that reconcile."""
    parts = F.aggregate("components", F.lit(0.0), lambda s, c: s + c.weighted_score)
    sound = (F.abs(parts - F.col("ungated_total_score")) <= 1e-9) & (F.abs(F.col("ungated_total_score") * F.col("gate_multiplier") - F.col("total_score")) <= 1e-9)
    entry = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    diagnostics = ("schema_validity", "source_grounding", "unsafe_recommendation_detected")
    fixed = [entry("total", F.lit("total_score"), F.col("total_score")), *(entry("diagnostic", F.lit(d), F.col(f"diagnostics.{d}")) for d in diagnostics), entry("reconciliation", F.lit("reconciled"), sound.cast("int"))]
    listed = F.transform("components", lambda c: entry("component", c.component_id, c.score))
    return ledgers.select(F.col(run).alias("run"), F.inline(F.concat(F.array(*fixed), listed))).groupBy("run", "kind", "name").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


OUTCOMES = ("valid", "invalid", "error", "missing", "timeout")


def outcome_histogram(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(outcome, n, share) over all tasks: those without a result are missing, an unknown or null outcome is an error; every outcome has a row.

    Of several results of one task the first of ``OUTCOMES`` counts."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome")), F.lit(0)), F.lit(3))
    best = results.groupBy("task_id").agg(F.min(rank).alias("rank"))
    counted = tasks.select("task_id").join(best, "task_id", "left").groupBy(F.get(F.array(*[F.lit(o) for o in OUTCOMES]), (F.coalesce("rank", F.lit(4)) - 1).cast("int")).alias("outcome")).agg(F.count("*").alias("n"))
    every = tasks.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string").join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))
    total = tasks.agg(F.count("*").alias("total"))
    return every.crossJoin(F.broadcast(total)).select("outcome", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def compare_runs(ledgers: DataFrame, run: str, baseline, adapted) -> DataFrame:
    """Counts, means, absolute and relative change of two runs told apart by column ``run``."""
    side = lambda v, f, c: f(F.when(F.col(run) == v, F.col(c)))
    out = ledgers.agg(
        side(baseline, F.count, "total_score").alias("baseline_n"), side(adapted, F.count, "total_score").alias("adapted_n"),
        side(baseline, F.avg, "total_score").alias("baseline_mean"), side(adapted, F.avg, "total_score").alias("adapted_mean"),
    )
    delta = F.col("adapted_mean") - F.col("baseline_mean")
    return out.withColumn("absolute_delta", delta).withColumn("relative_percent", F.when(F.col("baseline_mean") == 0, 0.0).otherwise(100 * delta / F.col("baseline_mean")))
