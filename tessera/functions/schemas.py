"""Fixed record layouts. ``schema_version`` is a constant of every record."""

from __future__ import annotations

SCHEMA_VERSION = "0.1"

CITATION = "struct<document_id:string,span_id:string,page_number:int,section:string,locator:string,quote:string,quote_hash:string,confidence:double>"
LISTS = ("conditions", "required_actions", "forbidden_actions", "procedure_steps", "exceptions", "terms", "related_unit_ids")

UNIT = (
    "unit_id string, kind string, title string, text string, family string, section string, "
    f"citations array<{CITATION}>, " + ", ".join(f"{c} array<string>" for c in LISTS) + ", confidence double, review_status string, metadata string, schema_version string"
)
ANSWER_FIELDS = ("applicable_rules", "situation_type", "required_actions", "forbidden_actions", "procedure_order", "final_answer")
ANSWER = "struct<applicable_rules:array<string>,situation_type:string,required_actions:array<string>,forbidden_actions:array<string>,procedure_order:array<string>,final_answer:string>"
ANSWER_KEY = f"struct<applicable_unit_ids:array<string>,required_actions:array<string>,forbidden_actions:array<string>,procedure_order:array<string>,terms:array<string>,reference_answer:string,citations:array<{CITATION}>>"
COMPONENT = "struct<component_id:string,weight:double,score:double,weighted_score:double,evidence:array<string>,notes:string>"
SPAN = "document_id string, span_id string, ordinal int, text string, text_sha256 string, page_start int, page_end int, section_path array<string>"
DOCUMENT = "document_id string, title string, edition string, source_uri string, media_type string, sha256 string, rights struct<status:string,license:string,redistributable:boolean,notes:string>"

KINDS = ("rule", "procedure", "definition", "concept", "table", "example")
RIGHTS = ("unknown", "cleared", "restricted")
REVIEWS = ("unreviewed", "reviewed", "rejected")
FAMILIES = ("standard_operation", "edge_case", "conflict_resolution", "exception_handling", "violation_check", "adversarial_distractor")
ALL_FAMILIES = (*FAMILIES, "applied_scenario")
SPLITS = ("train", "dev", "test")
SEVERITIES = ("low", "medium", "high", "critical")
