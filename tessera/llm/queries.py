"""Registry of this subpackage: one query for each operator, over whole tables."""

from __future__ import annotations

from tessera.llm import bpe, exact, lang, mixing, near, secrets, sharding, suffix, toxicity, vectors
from tessera.sources.work import spread


def _table(spark, sf_dir, name="documents"):
    """A table, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES = {
    "op1_sharding": lambda spark, d: sharding.shard_documents(_table(spark, d)),
    "op2_bpe": lambda spark, d: bpe.encode(_table(spark, d)),
    "op3_exact_dedup": lambda spark, d: exact.exact_dedup(_table(spark, d)),
    "exact_replay": lambda spark, d: exact.replay(exact.log_of(_table(spark, d))),
    "op4_suffix_dedup": lambda spark, d: suffix.repeated_passages(_table(spark, d)),
    "op5_secret_scan": lambda spark, d: secrets.scan(_table(spark, d)),
    "op6_embedding_dedup": lambda spark, d: vectors.near_links(_table(spark, d, "embeddings")),
    "embedding_planted": lambda spark, d: vectors.near_links(vectors.planted(_table(spark, d, "embeddings"))),
    "op7_mixing": lambda spark, d: mixing.mix_query(_table(spark, d)),
    "op8_language_id": lambda spark, d: lang.identify(_table(spark, d)),
    "op9_near_dedup": lambda spark, d: near.near_dedup(_table(spark, d)),
    "op10_toxicity": lambda spark, d: toxicity.score(_table(spark, d), _table(spark, d, "labels")),
}

ORACLES = {
    "op1_sharding": sharding.ORACLE,
    "op3_exact_dedup": exact.ORACLE,
    "exact_replay": exact.REPLAY_ORACLE,
    "op5_secret_scan": secrets.ORACLE,
    "op6_embedding_dedup": vectors.ORACLE,
    "embedding_planted": vectors.PLANTED_ORACLE,
}
