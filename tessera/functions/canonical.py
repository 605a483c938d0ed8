"""Byte-canonical JSON: sorted keys, compact separators, UTF-8, no NaN."""

from __future__ import annotations

import datetime
import decimal
import enum
import hashlib
import json
import pathlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def jsonable(value):
    """Plain JSON values; sets are sorted by their canonical form."""
    if isinstance(value, enum.Enum):
        return jsonable(value.value)
    if isinstance(value, Row):
        return jsonable(value.asDict())
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((jsonable(v) for v in value), key=canonical)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, pathlib.PurePath):
        return value.as_posix()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if hasattr(value, "tolist"):
        return jsonable(value.tolist())
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    return value


def canonical(value) -> str:
    return json.dumps(jsonable(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def canonical_column(*columns: str) -> Column:
    """Canonical JSON of an object of these columns (nested values included)."""

    def encode(rows: pa.Array) -> pa.Array:
        return pa.array([canonical(r) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(encode, StringType())(F.struct(*columns))


def record_json(record: Column) -> Column:
    """UTF-8 JSON of a struct with sorted keys and spaced separators, as lines of trainer records are."""

    def encode(rows: pa.Array) -> pa.Array:
        return pa.array([json.dumps(jsonable(r), sort_keys=True, ensure_ascii=False) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(encode, StringType())(record)


def json_text(text: Column) -> Column:
    """A text as a JSON string, other characters than ASCII as they are; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def training_json(record: Column) -> Column:
    """ASCII JSON of a struct with sorted keys and spaced separators, as chat trainers store answers."""

    def encode(rows: pa.Array) -> pa.Array:
        return pa.array([json.dumps(jsonable(r), sort_keys=True) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(encode, StringType())(record)
