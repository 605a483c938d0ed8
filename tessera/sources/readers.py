"""Readers: JSON, JSON lines, plain and gzip, whole files, page text, directories and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import schemas
from tessera.functions.text import strip

MEDIA_TYPES = {
    "json": "application/json", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson", "txt": "text/plain", "md": "text/markdown",
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "csv": "text/csv", "html": "text/html", "gz": "application/gzip", "parquet": "application/vnd.apache.parquet",
}


def is_lines(path: str) -> bool:
    return any(path.endswith(e) for e in (".jsonl", ".ndjson", ".jsonl.gz", ".ndjson.gz"))


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record a non-blank line; ``strict`` fails on a line that is no object of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of lines that are not JSON objects; line numbers count within each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "text")).where(strip(F.col("text")) != "")
    return lines.where(F.json_object_keys("text").isNull()).select("path", (F.col("at") + 1).alias("line"), "text")


def read_records(spark: SparkSession, path: str, schema: str, *wrappers: str) -> DataFrame:
    """Records of a JSON-lines file, a JSON list, or an object that holds the list under one of ``wrappers``; an object with none of them is one record.

    A text that is no JSON, a wrapper that holds no list, and an entry that is no object are errors."""
    if is_lines(path):
        return read_json_lines(spark, path, schema)
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    value = strip(F.col("value"))
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": "), "file")).cast("array<string>")
    parsed = F.try_parse_json("value")
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    for w in wrappers:
        inside = F.get_json_object(value, f"$.{w}")
        listed = F.coalesce(listed, F.when(inside.isNotNull(), F.when(inside.startswith("["), F.from_json(inside, "array<string>")).otherwise(fail(f"{w} holds no list"))))
    items = F.when(parsed.isNull(), fail("not valid JSON")).otherwise(F.coalesce(listed, F.when(value.startswith("{"), F.array(value)), fail("neither a list nor an object")))
    bad = F.exists("items", lambda x: x.isNull() | ~x.startswith("{"))
    rows = whole.select("file", items.alias("items")).select(F.explode(F.when(bad, fail("an entry is no object")).otherwise(F.col("items"))).alias("item"))
    return rows.select(F.from_json("item", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _inner(schema: str) -> str:
    """Top-level DDL ``a t, b u`` as struct fields ``a:t,b:u``."""
    depth, parts, now = 0, [], ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return ",".join(f"{p.strip().split(' ', 1)[0]}:{p.strip().split(' ', 1)[1]}" for p in [*parts, now])


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge units with defaults filled in: empty lists, kind ``concept``, confidence 1, quote hashes."""
    raw = read_records(spark, path, schemas.UNIT, "knowledge_units", "units")
    return normal_units(raw)


def normal_units(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    hashed = F.transform("citations", lambda c: c.withField("quote_hash", F.coalesce(F.nullif(c.quote_hash, F.lit("")), F.when(c.quote != "", F.sha2(c.quote, 256)))).withField("confidence", F.coalesce(c.confidence, F.lit(1.0))))
    out = raw.withColumns({c: F.coalesce(F.col(c), empty) for c in schemas.LISTS})
    return out.withColumns({
        "citations": F.coalesce(hashed, F.array().cast(f"array<{schemas.CITATION}>")), "kind": F.coalesce("kind", F.lit("concept")), "confidence": F.coalesce("confidence", F.lit(1.0)),
        "review_status": F.coalesce("review_status", F.lit("unreviewed")), "schema_version": F.coalesce("schema_version", F.lit(schemas.SCHEMA_VERSION)),
    })


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, sha256, media_type) of all files below a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), media_type(F.col("path")).alias("media_type")).orderBy("path")


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def read_pages(spark: SparkSession, path: str, pages: int | None = None) -> DataFrame:
    """(document_id, text) of whole text files; ``segments.page_lines`` cuts them at form feeds. Another number of pages than ``pages`` is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("document_id"), F.col("value").alias("text"))
    if pages is None:
        return rows
    found = F.size(F.split("text", "\f")) - 1
    wrong = F.raise_error(F.concat(F.lit(f"expected {pages} pages, found "), found.cast("string"), F.lit(": "), "document_id")).cast("string")
    return rows.withColumn("text", F.when(found == pages, F.col("text")).otherwise(wrong))


def read_examples(spark: SparkSession, path: str, max_examples: int = -1) -> DataFrame:
    """(question, answer, info) of older task records, in their order; a positive ``max_examples`` keeps so many of the first."""
    rows = read_records(spark, path, "task_id string, description string, expected_outcome string, applicable_rules array<string>")
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    out = rows.select(
        F.concat(F.lit("Task ID: "), shown("task_id"), F.lit("\nScenario: "), shown("description")).alias("question"), F.coalesce("expected_outcome", F.lit("")).alias("answer"), F.struct("task_id", "description", "applicable_rules").alias("info")
    )
    return out.limit(max_examples) if max_examples > 0 else out


def read_catalogue(spark: SparkSession, root: str, schema: str = "volume_id string") -> DataFrame:
    """Descriptors ``<root>/<id>/volume.json`` whose id is their folder's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/volume.json").select("*", F.col("_metadata.file_path").alias("path"))
    return rows.where(F.regexp_extract("path", r"([^/]+)/volume\.json$", 1) == F.col("volume_id"))


def read_checked(spark: SparkSession, path: str, schema: str, sha256: str | None = None, count: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip, after checks of the file's hash and its record count."""
    if sha256 is not None:
        found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()]
        if found != [sha256]:
            raise ValueError(f"{path}: hash differs from the manifest")
    rows = read_json_lines(spark, path, schema)
    if count is not None and (n := rows.count()) != count:
        raise ValueError(f"{path}: {n} records, the manifest has {count}")
    return rows


def read_partials(spark: SparkSession, pattern: str, schema: str, key: str) -> DataFrame:
    """Partial JSON results merged, the first of each key by file and position winning; ``*_complete*`` outputs and unreadable files are passed over."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where(~F.col("file").rlike("_complete[^/]*$"))
    rows = files.select("file", F.posexplode(F.from_json("value", f"array<struct<{_inner(schema)}>>")).alias("at", "record"))
    best = rows.groupBy(F.col(f"record.{key}").alias("k")).agg(F.min_by("record", F.struct("file", "at")).alias("record"))
    return best.where("k IS NOT NULL").select("record.*")


def page_selection(files: DataFrame, first: int, last: int, name: str = "path") -> DataFrame:
    """Files whose number, the digits of their name, lies in a range."""
    number = F.nullif(F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\D", ""), F.lit("")).cast("int")
    return files.withColumn("page_number", number).where(F.col("page_number").between(first, last))


def base64_content(spark: SparkSession, path: str) -> DataFrame:
    """(path, media_type, base64) of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", media_type(F.col("path")).alias("media_type"), F.base64("content").alias("base64"))
