"""Sharding by fixed virtual slots.

A record's key hashes into one of ``SLOTS`` slots for ever. A versioned map says
which shard holds each slot; rebalancing appends a version that moves only slots,
never re-hashes records. All state is ``SLOTS`` rows, whatever the corpus holds,
so the map is the one thing here that is broadcast (its size is a constant).

Defined cases: a null key hashes like the empty string; a null text weighs 0
bytes; repeated rows share a slot and each adds its bytes; an empty table leaves
version 2 equal to version 1; of texts of no bytes at all, slots of removed shards go
to the first shard; columns other than key and text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.kernel import shared_dir

SLOTS = 4096
SHARDS = 64
SLACK_PERCENT = 5


def slot_of(key) -> F.Column:
    """Slot 0..4095 of a key: the first three hex digits of its md5."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 3), 16, 10).cast("int")


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, n_records, n_bytes) for all slots, empty ones included."""
    used = (
        docs.select(slot_of(F.col(key)).alias("slot"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("b"))
        .groupBy("slot")
        .agg(F.count("*").alias("n_records"), F.sum("b").alias("n_bytes"))
    )
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return every.join(used, "slot", "left").select("slot", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def initial_map(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """Version 1: equal contiguous runs of slots."""
    if not 1 <= shards <= SLOTS:
        raise ValueError(f"shards must be 1..{SLOTS}")
    return spark.range(SLOTS).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), F.floor(F.col("id") * shards / SLOTS).cast("int").alias("shard"))


def rebalance(mapping: DataFrame, weights: DataFrame, shards: int = SHARDS, slack_percent: int = SLACK_PERCENT) -> DataFrame:
    """The next version: only the moved slots change shard.

    ``mapping``: (version, slot, shard), one row for each slot. Each shard keeps
    its slots in slot order while they fit under the mean load plus the slack, and
    releases the rest, a shard beyond ``shards`` all of them; released slots, in slot
    order, fill the shards' free room in shard order. A shard ends within its limit
    plus one slot."""
    if not 1 <= shards <= SLOTS:
        raise ValueError(f"shards must be 1..{SLOTS}")
    w = mapping.join(weights.select("slot", "n_bytes"), "slot", "left").select("version", "slot", "shard", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    whole = Window.partitionBy(F.lit(0))
    # SLOTS rows in all: windows over one partition are of constant size
    w = w.withColumn("cap", F.ceil(F.sum("n_bytes").over(whole) * (100 + slack_percent) / (100 * shards)))
    w = w.withColumn("cum", F.sum("n_bytes").over(Window.partitionBy("shard").orderBy("slot")))
    stays = (F.col("cum") <= F.col("cap")) & F.col("shard").between(0, shards - 1)
    kept = w.where(stays).select("version", "slot", "shard", "n_bytes", "cap")
    freed = w.where(~stays).select("version", "slot", "n_bytes", (F.sum("n_bytes").over(Window.partitionBy(F.lit(0)).orderBy("slot")) - F.col("n_bytes")).alias("at"))
    load = kept.groupBy("shard").agg(F.sum("n_bytes").alias("load"))
    cap = w.agg(F.max("cap").alias("cap"))
    room = (
        mapping.sparkSession.range(shards)
        .select(F.col("id").cast("int").alias("shard"))
        .join(load, "shard", "left")
        .crossJoin(cap)
        .select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
        .where("room > 0")  # some room there always is: the limits sum to more than the load
        .withColumn("upto", F.sum("room").over(Window.partitionBy(F.lit(0)).orderBy("shard")))
        .select("shard", (F.col("upto") - F.col("room")).alias("from_"), "upto")
    )
    moved = freed.join(F.broadcast(room), (F.col("at") >= F.col("from_")) & (F.col("at") < F.col("upto")), "left").select("version", "slot", F.coalesce("shard", F.lit(0)).alias("shard"))
    return kept.select("version", "slot", "shard").unionByName(moved).withColumn("version", F.col("version") + 1)


class SlotMap:
    """Versions of a slot-to-shard map under one folder: ``<root>/v=<n>``, never overwritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, mapping: DataFrame, version: int) -> None:
        mapping.select("version", "slot", "shard").coalesce(1).write.mode("error").parquet(f"{self.root}/v={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("version int, slot int, shard int").parquet(f"{self.root}/v={version}")

    def edit(self, version: int, moves: dict[int, int]) -> int:
        """Move single slots by hand; gives the new version's number. Slots that there are not, and negative shards, are an error."""
        old = self.load(version)
        bad = {s: t for s, t in moves.items() if not 0 <= s < SLOTS or not 0 <= t < SLOTS}
        if bad:
            raise ValueError(f"no such slot or shard: {bad}")
        if moves:
            given = self.spark.createDataFrame([(int(s), int(t)) for s, t in moves.items()], "slot int, to_ int")
            old = old.join(F.broadcast(given), "slot", "left").select("version", "slot", F.coalesce("to_", "shard").alias("shard"))
        self.save(old.withColumn("version", F.lit(version + 1)), version + 1)
        return version + 1


def assign(docs: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, slot, shard, version) of every record."""
    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(F.col(text)).cast("long").alias("n_bytes"), slot_of(F.col(key)).alias("slot"))
    return rows.join(F.broadcast(mapping), "slot").select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "slot", "shard", "version")


def shard_documents(docs: DataFrame, shards: int = SHARDS, root: str | None = None) -> DataFrame:
    """Weigh the slots, store versions 1 and 2 of the map, and place every record by version 2."""
    spark = docs.sparkSession
    store = SlotMap(spark, root or f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}")
    store.save(initial_map(spark, shards), 1)
    store.save(rebalance(store.load(1), slot_bytes(docs), shards), 2)
    return assign(docs, store.load(2))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS slot
  FROM documents),
s AS (
  SELECT r.slot, r.slot * {SHARDS} // {SLOTS} AS shard, coalesce(b.n, 0) AS n
  FROM (SELECT CAST(range AS INTEGER) AS slot FROM range({SLOTS})) r
  LEFT JOIN (SELECT slot, sum(n_bytes) AS n FROM d GROUP BY slot) b ON b.slot = r.slot),
c AS (
  SELECT *, CAST(ceil(sum(n) OVER () * {100 + SLACK_PERCENT} / {100.0 * SHARDS}) AS BIGINT) AS cap,
         sum(n) OVER (PARTITION BY shard ORDER BY slot) AS cum FROM s),
kept AS (SELECT slot, shard, n, cap FROM c WHERE cum <= cap),
freed AS (SELECT slot, n, sum(n) OVER (ORDER BY slot) - n AS at FROM c WHERE cum > cap),
room AS (
  SELECT h.shard, (SELECT max(cap) FROM c) - coalesce(l.n, 0) AS room
  FROM (SELECT CAST(range AS INTEGER) AS shard FROM range({SHARDS})) h
  LEFT JOIN (SELECT shard, sum(n) AS n FROM kept GROUP BY shard) l ON l.shard = h.shard),
up AS (SELECT shard, room, sum(room) OVER (ORDER BY shard) AS upto FROM room WHERE room > 0),
m AS (
  SELECT slot, shard FROM kept
  UNION ALL
  SELECT f.slot, u.shard FROM freed f JOIN up u ON f.at >= u.upto - u.room AND f.at < u.upto)
SELECT d.doc_id, d.n_bytes, d.slot, CAST(m.shard AS INTEGER) AS shard, 2 AS version FROM d JOIN m ON m.slot = d.slot
"""
