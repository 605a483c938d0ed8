"""Importers of older record layouts: nested rules, their tasks, and row fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tessera.functions import schemas
from tessera.functions.canonical import json_text
from tessera.functions.text import cleaned, optional, required, required_slug, slug, strip
from tessera.operators import audit
from tessera.sources.work import written

#: task-family words of older records; others become applied_scenario
FAMILY_ALIASES = {
    "standard": "standard_operation", "conflict": "conflict_resolution", "exception": "exception_handling",
    "violation": "violation_check", "adversarial": "adversarial_distractor", "edge": "edge_case",
}


def family_of(word: Column, aliases: dict | None = None) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(optional(word), F.lit(""))), "[- ]", "_")
    table = F.create_map(*[F.lit(x) for pair in (FAMILY_ALIASES if aliases is None else aliases).items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.when(key.isin(*schemas.ALL_FAMILIES), key), F.lit("applied_scenario"))


def as_text(df: DataFrame, column: str) -> Column:
    """A column of any type as text: nested values as JSON, a missing column as nulls."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema[column].dataType
    return F.to_json(column) if isinstance(kind, (ArrayType, StructType, MapType)) else F.col(column).cast("string")


def text_list(value: Column) -> Column:
    """The list that a text stands for: a JSON list's items, any other text as a list of one; stripped, without blanks.

    An object is an error, a null an empty list."""
    text = strip(value)
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    wrong = F.raise_error(F.concat(F.lit("expected a text or a list of texts: "), text)).cast("array<string>")
    is_object = text.startswith("{") & F.try_parse_json(text).isNotNull()
    return cleaned(F.when(is_object, wrong).otherwise(F.coalesce(listed, F.when(text != "", F.array(text)))))


def first_list(df: DataFrame, *names: str) -> Column:
    """The first of several columns, aliases of one list, that has something in it."""
    lists = [text_list(as_text(df, n)) for n in names]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))


_FIELDS = (
    "rule_id", "text", "category", "section", "page_number", "title", "conditions", "required_actions", "forbidden_actions", "procedure_steps", "procedure",
    "exceptions", "terms", "related_rule_ids", "related_unit_ids", "confidence", "metadata", "sub_rules",
)
#: rules as they come: every field as text, what is nested as its JSON
RULE = ", ".join(f"{c} string" for c in _FIELDS)
_TASK_FIELDS = ("task_id", "description", "applicable_rules", "expected_outcome", "task_family", "task_type", "required_actions", "forbidden_actions", "procedure_order", "procedure", "terms", "tags")
RULE_TASK = ", ".join(f"{c} string" for c in _TASK_FIELDS)


def rule_schema(depth: int = 4) -> str:
    """DDL of a typed rule with sub_rules nested ``depth`` deep, for rules that are built as structs."""
    lists = ("conditions", "required_actions", "forbidden_actions", "procedure_steps", "exceptions", "terms", "related_rule_ids")
    fields = ",".join(["rule_id:string", "text:string", "category:string", "section:string", "page_number:int", "title:string", *(f"{c}:array<string>" for c in lists), "confidence:double"])
    inner = f"struct<{fields}>"
    for _ in range(depth):
        inner = f"struct<{fields},sub_rules:array<{inner}>>"
    return inner


def flatten_rules(rules: DataFrame, prefix: str = "rule-") -> DataFrame:
    """Nested rules of any depth to rows in pre-order, with inherited category, section and page.

    Every field is text (nested values JSON). One explode a level, until a level is
    empty; levels are written, so that none is made twice. A page number of 0 counts as
    missing. ``path`` is the position at each level, whose order is the pre-order. A rule
    without id or text is an error, and so are sub_rules that are no list of objects."""
    own = [c for c in _FIELDS if c not in ("category", "section", "page_number", "sub_rules")]
    none = F.lit(None).cast("string")
    level = rules.select(*[as_text(rules, c).alias(c) for c in _FIELDS], F.array(F.monotonically_increasing_id()).alias("path"), none.alias("parent_rule_id"), none.alias("up_family"), none.alias("up_section"), F.lit(None).cast("int").alias("up_page"))
    out = None
    while True:
        page = F.nullif(optional(F.col("page_number")).cast("int"), F.lit(0))
        named = level.withColumn("rule_id", required(F.col("rule_id"), "rule_id"))
        now = written(
            named.withColumns({
                "text": required(F.col("text"), "text", F.col("rule_id")), "family": F.coalesce(optional(F.col("category")), "up_family"),
                "own_section": F.coalesce(optional(F.col("section")), "up_section"), "page": F.coalesce(page, "up_page"),
            }).select(*own, "sub_rules", "path", "parent_rule_id", "family", F.col("own_section").alias("section"), F.col("page").alias("page_number")),
            "rules",
        )
        rows = now.drop("sub_rules")
        out = rows if out is None else out.unionByName(rows)
        nested = now.where(F.coalesce(strip(F.col("sub_rules")), F.lit("")).rlike(r"[^\[\]\s]"))
        if nested.isEmpty():
            return out.withColumn("unit_id", required_slug(F.col("rule_id"), prefix))
        wrong = F.raise_error(F.concat(F.lit("sub_rules must be a list of objects: rule "), "rule_id")).cast("array<string>")
        items = F.from_json("sub_rules", "array<string>")
        items = F.when(items.isNull() | F.exists(items, lambda x: x.isNull() | ~x.startswith("{")), wrong).otherwise(items)
        below = nested.select(F.col("rule_id").alias("parent_rule_id"), F.col("family").alias("up_family"), F.col("section").alias("up_section"), F.col("page_number").alias("up_page"), "path", F.posexplode(items).alias("pos", "item"))
        below = below.withColumn("rule", F.from_json("item", RULE)).withColumn("path", F.concat("path", F.array(F.col("pos").cast("long"))))
        level = below.select("rule.*", "path", "parent_rule_id", "up_family", "up_section", "up_page")


def _merged(metadata: Column, own: Column) -> Column:
    """JSON of an object's fields and then of ``own``'s, which come last and so win."""
    inner = lambda c: F.regexp_extract(strip(c), r"(?s)^\{(.*)\}$", 1)
    wrong = F.raise_error(F.concat(F.lit("metadata must be an object: "), metadata)).cast("string")
    given = F.when(metadata.isNull(), F.lit("")).when(strip(metadata).startswith("{"), strip(inner(metadata))).otherwise(wrong)
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(given, F.lit("")), inner(own)), F.lit("}"))


def import_rules(rules: DataFrame, document_id: str, prefix: str = "rule-") -> DataFrame:
    """Knowledge units of nested rules; ids that collide are found by ``audit.duplicates``, which builds and ``import_bundle`` ask."""
    flat = flatten_rules(rules, prefix)
    flat = flat.withColumn("confidence", F.coalesce(optional(F.col("confidence")).cast("double"), F.lit(1.0)))
    citation = F.struct(
        F.lit(document_id).alias("document_id"), F.concat(F.lit(f"{document_id}:rule:"), "rule_id").alias("span_id"), F.col("page_number"), F.col("section"),
        F.concat(F.lit("Rule "), "rule_id").alias("locator"), F.col("text").alias("quote"), F.sha2("text", 256).alias("quote_hash"), F.col("confidence").alias("confidence"),
    )
    lists = {"conditions": ("conditions",), "required_actions": ("required_actions",), "forbidden_actions": ("forbidden_actions",), "procedure_steps": ("procedure_steps", "procedure"), "exceptions": ("exceptions",), "terms": ("terms",)}
    own = F.to_json(F.struct(F.col("rule_id").alias("legacy_rule_id"), F.lit("rule_json").alias("source_format"), required_slug(F.col("parent_rule_id"), prefix).alias("parent_unit_id"), F.col("page_number")))
    return flat.select(
        "unit_id", F.lit("rule").alias("kind"), F.coalesce(optional(F.col("title")), F.concat(F.lit("Rule "), "rule_id")).alias("title"), "text", "family", "section",
        F.array(citation).alias("citations"), *[first_list(flat, *c).alias(k) for k, c in lists.items()],
        F.transform(first_list(flat, "related_rule_ids", "related_unit_ids"), lambda x: required_slug(x, prefix)).alias("related_unit_ids"),
        "confidence", F.lit("unreviewed").alias("review_status"), _merged(F.col("metadata"), own).alias("metadata"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        F.col("rule_id").alias("legacy_rule_id"), "path",
    )


def import_tasks(tasks: DataFrame, units: DataFrame, document_id: str, prefix: str = "rule-") -> DataFrame:
    """Tasks of older records, their rule ids matched to units; an unmatched rule gets an id and a bare citation of its own.

    ``tasks``: the fields of ``RULE_TASK``, as texts or typed. Families of several units
    are joined by '+'. A task without id, description, outcome or rules is an error."""
    rows = tasks.select(
        required(as_text(tasks, "task_id"), "task_id").alias("task_id"), text_list(as_text(tasks, "applicable_rules")).alias("applicable_rules"),
        as_text(tasks, "description").alias("description"), as_text(tasks, "expected_outcome").alias("expected_outcome"),
        family_of(F.coalesce(*[optional(as_text(tasks, c)) for c in ("task_family", "task_type")])).alias("task_family"),
        *[first_list(tasks, c).alias(c) for c in ("required_actions", "forbidden_actions", "terms", "tags")], first_list(tasks, "procedure_order", "procedure").alias("procedure_order"),
    )
    ruleless = F.raise_error(F.concat(F.lit("no applicable_rules: task "), "task_id")).cast("array<string>")
    rows = rows.withColumns({
        "prompt": required(F.col("description"), "description", F.col("task_id")), "expected_outcome": required(F.col("expected_outcome"), "expected_outcome", F.col("task_id")),
        "applicable_rules": F.when(F.size("applicable_rules") > 0, F.col("applicable_rules")).otherwise(ruleless),
    })
    refs = rows.select("task_id", F.posexplode("applicable_rules").alias("pos", "rule_id"))
    known = units.select("legacy_rule_id", "unit_id", "family", "citations")
    matched = refs.join(known, refs.rule_id == known.legacy_rule_id, "left")
    bare = F.array(F.from_json(F.to_json(F.struct(F.lit(document_id).alias("document_id"), F.concat(F.lit(f"{document_id}:rule:"), "rule_id").alias("span_id"), F.concat(F.lit("Rule "), "rule_id").alias("locator"), F.lit(1.0).alias("confidence"))), schemas.CITATION))
    per_task = matched.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("unit_id", required_slug(F.col("rule_id"), prefix)).alias("u")))), lambda x: x.u).alias("knowledge_unit_ids"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("family")), "+"), F.lit("")).alias("rule_family"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("citations", bare).alias("c")))), lambda x: x.c)).alias("all_citations"),
    )
    place = lambda c: F.concat_ws("|", c.document_id, c.span_id, F.coalesce(c.locator, F.lit("")))
    keys = F.transform("all_citations", place)
    out = rows.join(per_task, "task_id")
    out = out.withColumn("citations", F.filter("all_citations", lambda c, i: F.array_position(keys, place(c)) == i + 1))
    key = F.struct(F.col("knowledge_unit_ids").alias("applicable_unit_ids"), "required_actions", "forbidden_actions", "procedure_order", "terms", F.col("expected_outcome").alias("reference_answer"), "citations")
    metadata = F.struct(F.lit(None).cast("string").alias("template_version"), F.element_at("knowledge_unit_ids", 1).alias("primary_unit_id"), F.lit("rule").alias("source_kind"))
    tags = F.array_distinct(F.concat(F.array(F.lit("imported")), "tags"))
    return out.select("task_id", "prompt", "task_family", "knowledge_unit_ids", key.alias("answer_key"), "citations", "rule_family", tags.alias("tags"), F.lit("imported").alias("generator"), metadata.alias("metadata"))


def import_bundle(rules: DataFrame, tasks: DataFrame | None = None, document_id: str = "document", prefix: str = "rule-") -> tuple[DataFrame, DataFrame | None]:
    """(units, tasks) of older records, both written; repeated ids are an error."""
    units = written(import_rules(rules, document_id, prefix), "units")
    audit.demand_empty(audit.duplicates(units, "unit_id"), "rule ids that collide")
    if tasks is None:
        return units, None
    made = written(import_tasks(tasks, units, document_id, prefix), "imported")
    audit.demand_empty(audit.duplicates(made, "task_id"), "repeated task ids")
    return units, made


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key along ``order``: a min of structs, which combines before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != key]), F.struct(*order, *rest)).alias("row"))
    return best.select(key, "row.*")


def fixture_rows(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """Training and held-out rows with their fixed splits."""
    return train.withColumn("split", F.lit("train")).unionByName(heldout.withColumn("split", F.lit("test")), allowMissingColumns=True)


def _fixture_citations() -> Column:
    """Citations of a fixture row: the volume's title as document, the span or else the rule as place."""
    title = lambda c: F.coalesce(F.nullif(c.volume_title, F.lit("")), F.lit("source-volume"))
    one = lambda c: F.struct(
        slug(title(c)).alias("document_id"), F.coalesce(F.nullif(c.source_span, F.lit("")), F.nullif(c.rule_id, F.lit("")), F.lit("unknown-span")).alias("span_id"), c.page_number.cast("int").alias("page_number"), c.section.alias("section"),
        c.rule_id.alias("locator"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("string").alias("quote_hash"), F.coalesce(c.confidence.cast("double"), F.lit(1.0)).alias("confidence"),
    )
    return F.transform("source_citations", one)


_FIXTURE = "task_id string, prompt string, task_type string, rule_family string, expected_rule_ids array<string>, expected_required_actions array<string>, expected_forbidden_actions array<string>, expected_procedure_order array<string>, expected_terms array<string>, source_citations array<struct<volume_title:string,source_span:string,rule_id:string,page_number:int,section:string,confidence:double>>"


def load_fixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(units, tasks) of a folder with train and test rows and, optionally, adapter weights."""
    rows = fixture_rows(*[spark.read.schema(_FIXTURE).json(f"{folder}/{n}.jsonl").withColumn("at", F.monotonically_increasing_id()) for n in ("train", "test")]).withColumn("at", F.struct(F.col("split") == "test", "at"))
    rows = written(rows, "fixture")
    return fixture_units(rows, "at"), fixture_tasks(rows)


def fixture_units(rows: DataFrame, order: str, weights: DataFrame | None = None, prefix: str = "source-unit-") -> DataFrame:
    """One unit for each expected rule id, from the first row that names it; a row without citation is an error.

    ``weights``: one row (rule_id, condition_weights map<string,double>, ...); its
    conditions go to the unit of its rule."""
    named = rows.select(F.posexplode("expected_rule_ids").alias("pos", "rule_id"), *rows.columns)
    first = first_rows(named.withColumn("unit_id", required_slug(F.col("rule_id"), prefix)).withColumn("at_", F.struct(order, "pos")), "unit_id", "at_")
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    bare = F.raise_error(F.concat(F.lit("no source citation: "), "unit_id")).cast(f"array<{schemas.CITATION}>")
    citations = F.when(F.size("source_citations") > 0, _fixture_citations()).otherwise(bare)
    listed = lambda c, name: F.coalesce(c, empty).alias(name)
    units = first.withColumn("citations", citations).select(
        "unit_id", F.lit("rule").alias("kind"), F.col("rule_id").alias("title"), F.lit("The source is named by its citations; its text is not part of the fixture.").alias("text"), F.col("rule_family").alias("family"),
        F.get("citations", F.lit(0)).section.alias("section"), "citations", empty.alias("conditions"), listed(F.col("expected_required_actions"), "required_actions"), listed(F.col("expected_forbidden_actions"), "forbidden_actions"),
        listed(F.col("expected_procedure_order"), "procedure_steps"), empty.alias("exceptions"), listed(F.col("expected_terms"), "terms"), empty.alias("related_unit_ids"),
        F.array_min(F.transform("citations", lambda c: c.confidence)).alias("confidence"), F.lit("unreviewed").alias("review_status"),
        F.to_json(F.struct(F.lit(True).alias("fixture_only"), F.col("rule_id").alias("upstream_rule_id"))).alias("metadata"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), none.alias("rule_id"),
    ).withColumn("rule_id", F.col("title"))
    if weights is None:
        return units
    adapter = weights.select(slug(F.col("rule_id"), prefix).alias("unit_id"), F.map_keys("condition_weights").alias("told")).limit(1)  # one adapter by contract
    return units.join(F.broadcast(adapter), "unit_id", "left").withColumn("conditions", F.coalesce("told", "conditions")).drop("told").select(units.columns)


def fixture_tasks(rows: DataFrame, prefix: str = "source-unit-") -> DataFrame:
    """The rows' tasks with their fixed splits; a row without expected rule is an error."""
    empty = F.array().cast("array<string>")
    ruleless = F.raise_error(F.concat(F.lit("no expected rule: task "), F.coalesce("task_id", F.lit("<unknown>")))).cast("array<string>")
    units = F.when(F.size("expected_rule_ids") > 0, F.transform("expected_rule_ids", lambda x: required_slug(x, prefix))).otherwise(ruleless)
    made = rows.select(
        required(F.col("task_id"), "task_id").alias("task_id"), "prompt", F.when(F.col("task_type").isin(*schemas.ALL_FAMILIES), F.col("task_type")).otherwise("applied_scenario").alias("task_family"), units.alias("knowledge_unit_ids"),
        *[F.coalesce(F.col(f"expected_{c}"), empty).alias(c) for c in ("required_actions", "forbidden_actions", "procedure_order", "terms")], F.coalesce(_fixture_citations(), F.array().cast(f"array<{schemas.CITATION}>")).alias("citations"), "rule_family", "split",
    )
    reference = F.nullif(F.array_join("required_actions", "; "), F.lit("")).alias("reference_answer")
    key = F.struct(F.col("knowledge_unit_ids").alias("applicable_unit_ids"), "required_actions", "forbidden_actions", "procedure_order", "terms", reference, "citations")
    return made.select("task_id", "prompt", "task_family", "knowledge_unit_ids", key.alias("answer_key"), "citations", "rule_family", F.array(F.lit("fixture")).alias("tags"), F.lit("fixture").alias("generator"), "split")


def extraction_requests(documents: DataFrame, spans: DataFrame, temperature: float = 0.0, max_tokens: int = 4096) -> DataFrame:
    """(span_id, system, prompt, schema_name, temperature, max_tokens): one deterministic request for each span.

    The prompt holds the span as JSON with sorted keys and spaced separators."""
    rows = spans.join(documents.select("document_id", "title", "edition"), "document_id")
    spaced = lambda name, value: F.concat(F.lit(f'"{name}": '), F.coalesce(value, F.lit("null")))
    text = lambda c: json_text(F.col(c))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    fields = [
        spaced("document_id", text("document_id")), spaced("edition", text("edition")), spaced("ordinal", number("ordinal")), spaced("pages", F.concat(F.lit("["), number("page_start"), F.lit(", "), number("page_end"), F.lit("]"))),
        spaced("section_path", F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("section_path", F.array().cast("array<string>")), json_text), ", "), F.lit("]"))), spaced("span_id", text("span_id")), spaced("text", text("text")), spaced("title", text("title")),
    ]
    return rows.select("span_id", F.lit(EXTRACTION_SYSTEM).alias("system"), F.concat(F.lit("Source span:\n{"), F.concat_ws(", ", *fields), F.lit("}")).alias("prompt"), F.lit("knowledge_extraction").alias("schema_name"), F.lit(float(temperature)).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))


EXTRACTION_SYSTEM = "Read one source span and give the knowledge it states as a JSON object whose only key is knowledge_units, a list of at least one unit with title and text. Leave provenance out: it is attached by the caller. Plural fields are lists."


def unfenced(reply: Column) -> Column:
    """A reply without the fence of three backticks around it."""
    text = strip(reply)
    return F.when(text.startswith("```"), strip(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```$", ""))).otherwise(text)


def after_marker(reply: Column) -> Column:
    """What stands after the first fence marked json, else after the first fence, up to the next fence; a reply without fence is itself."""
    part = lambda mark: strip(F.get(F.split(F.get(F.split(reply, mark), F.lit(1)), "```"), F.lit(0)))
    return F.when(reply.contains("```json"), part("```json")).when(reply.contains("```"), part("```")).otherwise(reply)


def _unblank(field: str) -> Column:
    """An optional field of an extracted unit: null, or not blank."""
    return F.when(F.col(f"u.{field}").isNotNull(), required(F.col(f"u.{field}"), field, F.col("span_id")))


def _unblank_items(field: str) -> Column:
    return F.transform(F.coalesce(F.col(f"u.{field}"), F.array().cast("array<string>")), lambda x: required(x, f"item of {field}"))


def extracted_units(replies: DataFrame, document_id: str) -> DataFrame:
    """Units of provider replies, one row (span fields, reply JSON) a span; provenance comes from the span, never the reply.

    A reply is an object with the one key ``knowledge_units`` and a non-empty list;
    fences of three backticks around it are dropped. Another reply, a unit with a blank
    title, text, family or section, and one with a blank list item are errors."""
    unit = "struct<kind:string,title:string,text:string,family:string,section:string,conditions:array<string>,required_actions:array<string>,forbidden_actions:array<string>,procedure_steps:array<string>,exceptions:array<string>,terms:array<string>,related_unit_ids:array<string>,confidence:double>"
    found = F.from_json(unfenced(F.col("reply")), f"knowledge_units array<{unit}>").knowledge_units
    proper = (F.json_object_keys(unfenced(F.col("reply"))) == F.array(F.lit("knowledge_units"))) & (F.size(found) > 0) & ~F.exists(found, lambda x: x.isNull())
    wrong = F.raise_error(F.concat(F.lit("not one non-empty list of knowledge_units: reply of span "), "span_id")).cast(f"array<{unit}>")
    rows = replies.select("*", F.explode(F.when(F.coalesce(proper, F.lit(False)), found).otherwise(wrong)).alias("u"))
    section = F.nullif(F.array_join("section_path", " > "), F.lit(""))
    pages = F.when(F.col("page_start").isNull(), None).when(F.coalesce("page_end", "page_start") == F.col("page_start"), F.concat(F.lit("page "), "page_start")).otherwise(F.concat(F.lit("pages "), "page_start", F.lit("-"), "page_end"))
    citation = F.struct(
        F.lit(document_id).alias("document_id"), "span_id", F.col("page_start").alias("page_number"), section.alias("section"),
        F.concat_ws("; ", F.concat(F.lit("ordinal "), "ordinal"), pages, F.concat(F.lit("section "), section)).alias("locator"), F.col("text").alias("quote"), F.sha2("text", 256).alias("quote_hash"), F.coalesce("u.confidence", F.lit(1.0)).alias("confidence"),
    )
    identity = F.to_json(F.struct(F.lit(document_id).alias("document_id"), F.coalesce("u.kind", F.lit("concept")).alias("kind"), "span_id", F.col("u.text").alias("text"), F.col("u.title").alias("title")))
    lists = [c for c in schemas.LISTS]
    return rows.select(
        F.concat(F.lit("ku-"), F.substring(F.sha2(identity, 256), 1, 20)).alias("unit_id"), F.coalesce("u.kind", F.lit("concept")).alias("kind"), required(F.col("u.title"), "title", F.col("span_id")).alias("title"), required(F.col("u.text"), "text", F.col("span_id")).alias("text"),
        _unblank("family").alias("family"), _unblank("section").alias("section"), F.array(citation).alias("citations"), *[_unblank_items(c).alias(c) for c in lists],
        F.coalesce("u.confidence", F.lit(1.0)).alias("confidence"), F.lit("unreviewed").alias("review_status"), F.lit(None).cast("string").alias("metadata"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
    )


def wrap_batches(rows: DataFrame, order: str, size: int = 3, target: int | None = None) -> DataFrame:
    """Rows numbered into batches of ``size`` along ``order``.

    With a ``target`` of rows the table is gone through again and again, whole, until so
    many rows are out: each pass begins a batch of its own, as its ``pass`` tells."""
    from tessera.operators.segments import numbered

    once = numbered(rows, order)
    if target is None:
        return once.withColumn("batch", F.floor((F.col("row_number") - 1) / size))
    n = once.count()
    if not n:
        return once.withColumns({"pass": F.lit(0), "batch": F.lit(0).cast("long")}).where("false")
    passes = -(-target // n)
    many = once.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, passes - 1))))).where(F.col("pass") * n + F.col("row_number") <= target)
    return many.withColumn("batch", F.col("pass") * -(-n // size) + F.floor((F.col("row_number") - 1) / size))


def by_page_and_rule(rules: DataFrame) -> DataFrame:
    """Rules by page, a missing one first as page 0, then by id."""
    return rules.orderBy(F.coalesce("page_number", F.lit(0)), "rule_id")


def stamped(df: DataFrame, name: str = "generated_at") -> DataFrame:
    """``df`` with the time of the run as ISO text."""
    return df.withColumn(name, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def sample_one(tasks: DataFrame, seed: str | int) -> DataFrame:
    """One task chosen by a seeded hash of its id: least digest, no sort."""
    at = F.sha2(F.concat(F.lit(str(seed)), F.char(F.lit(0)), "task_id"), 256)
    return tasks.agg(F.min_by(F.struct("*"), at).alias("t")).select("t.*")
