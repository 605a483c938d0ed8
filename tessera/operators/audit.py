"""Checks as DataFrames of offending rows: empty means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import schemas
from tessera.functions.text import strip


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(refs: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    """Rows of ``refs`` whose reference no row of ``known`` has; a null reference dangles."""
    return refs.join(known.select(F.col(key).alias("known_key")).distinct(), F.col(ref) == F.col("known_key"), "left_anti")


def leaking(tasks: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with tasks in more than one split."""
    return tasks.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``; empty means equal multisets."""
    cols = left.columns
    return left.exceptAll(right.select(cols)).withColumn("side", F.lit("left")).unionByName(right.select(cols).exceptAll(left).withColumn("side", F.lit("right")))


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys shared by a pair of splits."""
    parts = {s: df.where(F.col(split) == s).select(key).distinct() for s in schemas.SPLITS}
    pairs = [("train", "dev"), ("train", "test"), ("dev", "test")]
    return reduce(DataFrame.unionByName, [parts[a].intersect(parts[b]).withColumn("pair", F.lit(f"{a}+{b}")) for a, b in pairs])


def ordinal_breaks(df: DataFrame, group: str, ordinal: str, position: str | None = None) -> DataFrame:
    """Rows whose ordinal does not exceed the one before it in the group, along ``position`` (the ordinal itself without one)."""
    w = Window.partitionBy(group).orderBy(position or ordinal)
    return df.withColumn("previous", F.lag(ordinal).over(w)).where(F.col(ordinal) <= F.col("previous"))


def span_faults(spans: DataFrame, document_id: str | None = None) -> DataFrame:
    """(span_id, fault) of source spans: blank ids or texts, foreign documents, repeated ids, ordinals that do not rise, page ranges that run backwards, bad hashes."""
    w = Window.partitionBy("document_id").orderBy("position") if "position" in spans.columns else Window.partitionBy("document_id").orderBy("ordinal", "span_id")
    checks = {
        "blank document id": F.coalesce(strip(F.col("document_id")), F.lit("")) == "",
        "blank span id": F.coalesce(strip(F.col("span_id")), F.lit("")) == "",
        "blank text": F.coalesce(strip(F.col("text")), F.lit("")) == "",
        "repeated span id": F.count("*").over(Window.partitionBy("span_id")) > 1,
        "ordinal not rising": F.col("ordinal") <= F.lag("ordinal").over(w),
        "negative ordinal": F.col("ordinal") < 0,
        "pages reversed": F.col("page_end") < F.col("page_start"),
        "bad hash": ~F.col("text_sha256").rlike("^[0-9a-f]{64}$"),
    }
    if document_id is not None:
        checks["foreign document"] = ~F.col("document_id").eqNullSafe(F.lit(document_id))
    faults = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return spans.withColumn("faults", faults).select("span_id", F.explode("faults").alias("fault"))


def _among(column: str, values: tuple[str, ...]) -> Column:
    """Whether a column has one of the values; a null has none."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def unit_faults(units: DataFrame) -> DataFrame:
    """(unit_id, fault) of knowledge units."""
    checks = {
        "blank unit id": F.coalesce(strip(F.col("unit_id")), F.lit("")) == "",
        "blank title": F.coalesce(strip(F.col("title")), F.lit("")) == "",
        "blank text": F.coalesce(strip(F.col("text")), F.lit("")) == "",
        "no citation": F.coalesce(F.size("citations"), F.lit(0)) < 1,
        "unknown kind": ~_among("kind", schemas.KINDS),
        "unknown review status": ~_among("review_status", schemas.REVIEWS),
        "confidence outside 0..1": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    }
    faults = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    return units.withColumn("faults", faults).select("unit_id", F.explode("faults").alias("fault"))


def task_faults(tasks: DataFrame) -> DataFrame:
    """(task_id, fault): tasks without units, or whose key names units they do not have."""
    checks = {
        "no unit": F.coalesce(F.size("knowledge_unit_ids"), F.lit(0)) < 1,
        "blank task id": F.coalesce(strip(F.col("task_id")), F.lit("")) == "",
        "key outside units": F.coalesce(F.size(F.array_except("answer_key.applicable_unit_ids", "knowledge_unit_ids")) > 0, F.lit(True)),
        "unknown family": ~_among("task_family", schemas.ALL_FAMILIES),
    }
    faults = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return tasks.withColumn("faults", faults).select("task_id", F.explode("faults").alias("fault"))


def ledger_faults(ledgers: DataFrame) -> DataFrame:
    """(task_id, response_id, fault): ledgers that do not reconcile within 1e-9."""
    close = lambda a, b: F.abs(a - b) <= 1e-9
    total = lambda field: F.aggregate(F.transform("components", lambda c: c[field]), F.lit(0.0), lambda s, x: s + x)
    checks = {
        "no component": F.size("components") < 1,
        "weights do not sum to one": ~close(total("weight"), F.lit(1.0)),
        "weighted score": F.exists("components", lambda c: ~close(c.weighted_score, c.weight * c.score)),
        "ungated total": ~close(total("weighted_score"), F.col("ungated_total_score")),
        "total": ~close(F.col("ungated_total_score") * F.col("gate_multiplier"), F.col("total_score")),
    }
    faults = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return ledgers.withColumn("faults", faults).select("task_id", "response_id", F.explode("faults").alias("fault"))


def filled_hashes(df: DataFrame, text: str, hash_: str) -> DataFrame:
    """SHA-256 of the text where a non-empty text has no hash yet."""
    return df.withColumn(hash_, F.coalesce(F.nullif(F.col(hash_), F.lit("")), F.when(F.col(text) != "", F.sha2(F.col(text), 256))))


def demand_empty(df: DataFrame, what: str) -> None:
    """Raise with up to ten offending rows."""
    rows = df.limit(10).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")
