"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns of known key formats and by assignments to
telling names. Of each candidate only a SHA-256 leaves the scan. Over the whole
corpus its distinct repositories (here: documents) and owners (sources) are
counted: a value that many owners hold is a copied example, one that few owners
hold and that looks random is a live credential of theirs.

verdict: ``example`` (``EXAMPLE_OWNERS`` owners or more), ``placeholder`` (fewer
than ``DISTINCT_CHARS`` different characters, or no digit, or no letter), else
``live``. Defined cases: null and empty texts hold nothing; a null owner or
repository counts as one of its own; a candidate that stands in one document
twice gives two rows and one repository; repeated rows are one repository; an
empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import written

EXAMPLE_OWNERS = 3
DISTINCT_CHARS = 8

FORMATS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "slack_token": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "json_web_token": r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\n]{16,}",
}
ASSIGNMENT = r"""(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_?KEY|[Aa]ccess_?[Kk]ey)["']?[ \t]{0,4}[=:][ \t]{0,4}["']?[A-Za-z0-9+/_.~-]{8,}"""
LEAD = r"""^[A-Za-z_]+["']?[ \t]{0,4}[=:][ \t]{0,4}["']?"""
PATTERN = "|".join([*FORMATS.values(), ASSIGNMENT])


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(doc_id, repository, owner, kind, value): one row for each place."""
    found = docs.select("doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("match"))
    kind = F.lit("assignment")
    for name, pattern in reversed(FORMATS.items()):
        kind = F.when(F.col("match").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return found.withColumn("kind", kind).select("doc_id", "repository", "owner", "kind", F.when(F.col("kind") == "assignment", F.regexp_replace("match", LEAD, "")).otherwise(F.col("match")).alias("value"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, kind, secret_hash, n_repositories, n_owners, verdict) of every candidate."""
    value = F.col("value")
    varied = (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    # texts are scanned once; the few candidates are then counted from a written table
    rows = candidates(docs, repository, owner).select("doc_id", "repository", "owner", "kind", F.sha2(value, 256).alias("secret_hash"), varied.alias("varied"))
    rows = written(rows, "candidates")
    spread = rows.select("secret_hash", F.coalesce(F.concat(F.lit("="), F.col("repository")), F.lit("")).alias("r"), F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit("")).alias("o"))
    # distinct first: a copied value's rows collapse on the map side
    repositories = spread.select("secret_hash", "r").distinct().groupBy("secret_hash").agg(F.count("*").alias("n_repositories"))
    owners = spread.select("secret_hash", "o").distinct().groupBy("secret_hash").agg(F.count("*").alias("n_owners"))
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(~F.col("varied"), "placeholder").otherwise("live")
    return rows.join(repositories, "secret_hash").join(owners, "secret_hash").select("doc_id", "kind", "secret_hash", "n_repositories", "n_owners", verdict.alias("verdict"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH m AS (
  SELECT doc_id, source, unnest(regexp_extract_all(text, {_quoted(PATTERN)})) AS match FROM documents),
k AS (
  SELECT doc_id, source, match,
         CASE {" ".join(f"WHEN regexp_full_match(match, {_quoted(p)}) THEN '{n}'" for n, p in FORMATS.items())} ELSE 'assignment' END AS kind FROM m),
v AS (
  SELECT doc_id, source, kind,
         CASE WHEN kind = 'assignment' THEN regexp_replace(match, {_quoted(LEAD)}, '') ELSE match END AS value FROM k),
h AS (SELECT *, sha256(value) AS secret_hash FROM v),
n AS (
  SELECT secret_hash, count(DISTINCT coalesce('=' || doc_id, '')) AS n_repositories,
         count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM h GROUP BY 1)
SELECT doc_id, kind, secret_hash, n_repositories, n_owners,
       CASE WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'example'
            WHEN len(list_distinct(string_split(value, ''))) < {DISTINCT_CHARS}
              OR NOT regexp_matches(value, '[0-9]') OR NOT regexp_matches(value, '[A-Za-z]') THEN 'placeholder'
            ELSE 'live' END AS verdict
FROM h JOIN n USING (secret_hash)
"""
