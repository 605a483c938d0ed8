"""Sinks with content hashes: canonical JSON lines, trainer records, gzip, split folders.

Tables go to Parquet, and large artefacts to folders of parts that executors write and
hash (``write_parts``). Artefacts that are single files by contract are made on executors
too, but streamed through the driver one partition at a time (``toLocalIterator``)."""

from __future__ import annotations

import gzip
import hashlib
import os
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical, canonical_column
from tessera.functions.schemas import SPLITS


@dataclass(frozen=True)
class Artifact:
    path: str
    sha256: str
    media_type: str
    record_count: int

    def as_dict(self) -> dict:
        return asdict(self)


def confined(root: str, relative: str) -> str:
    """The path below ``root``; absolute paths and ones that leave it are refused."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, relative))
    if os.path.isabs(relative) or (full != base and not full.startswith(base + os.sep)):
        raise ValueError(f"path leaves its root: {relative}")
    return full


def _store(root: str, relative: str, lines: Iterable[bytes], media: str, compress: bool = False) -> Artifact:
    path = confined(root, relative)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part, digest, n = f"{path}.part", hashlib.sha256(), 0
    with open(part, "wb") as raw:

        class Tee:
            def write(self, data):
                digest.update(data)
                return raw.write(data)

            def flush(self):
                raw.flush()

        out = gzip.GzipFile(filename="", mode="wb", compresslevel=9, fileobj=Tee(), mtime=0) if compress else Tee()
        for line in lines:
            out.write(line)
            n += 1
        if compress:
            out.close()
        raw.flush()
        os.fsync(raw.fileno())
    os.replace(part, path)
    return Artifact(relative, digest.hexdigest(), media, n)


def write_json(root: str, relative: str, value) -> Artifact:
    return _store(root, relative, [(canonical(value) + "\n").encode()], "application/json")


def write_lines(df: DataFrame, root: str, relative: str, order: str | None = None, compress: bool = False, text: str | None = None) -> Artifact:
    """Canonical JSON lines of ``df``, ordered by a column; ``text`` names a column that holds ready lines."""
    if order is not None:
        df = df.orderBy(order)
    lines = df.select((F.col(text) if text else canonical_column(*df.columns)).alias("line"))
    return _store(root, relative, ((r["line"] + "\n").encode() for r in lines.toLocalIterator(prefetchPartitions=True)), "application/gzip" if compress else "application/x-ndjson", compress)


def write_parts(df: DataFrame, folder: str, order: str | None = None, text: str | None = None, parts: int | None = None) -> dict:
    """Canonical JSON lines of ``df`` as a folder of parts, in order from part to part; ``folder`` may be on any file system.

    Parts are written and hashed on executors. What comes here is a line a part: its
    name, hash, size and records; the folder's hash is over those, in order."""
    spark = df.sparkSession
    if order is not None:
        df = (df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)).sortWithinPartitions(order)
    df.select((F.col(text) if text else canonical_column(*df.columns)).alias("value")).write.mode("error").text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    lines = F.length(F.col("content")) - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))
    rows = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), lines.cast("long").alias("record_count")).orderBy("path").collect()
    found = [r.asDict() for r in rows]
    return {"parts": found, "record_count": sum(r["record_count"] for r in found), "sha256": hashlib.sha256("".join(f"{r['path'].split('-')[1]}:{r['sha256']}\n" for r in found).encode()).hexdigest()}


def write_splits(tasks: DataFrame, root: str, order: str = "task_id") -> list[Artifact]:
    """``splits/{train,dev,test}.jsonl``; a split without tasks gets an empty file."""
    return [write_lines(tasks.where(F.col("split") == s), root, f"splits/{s}.jsonl", order) for s in SPLITS]


def check(root: str, ref: dict) -> dict:
    """The artefact's reference with its size; raises on a missing file, another hash or another count."""
    path = confined(root, ref["path"])
    digest, lines, size = hashlib.sha256(), 0, 0
    opener = gzip.open if ref["path"].endswith(".gz") else open
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
            size += len(chunk)
    with opener(path, "rb") as f:
        lines = sum(1 for line in f if line.strip())
    if digest.hexdigest() != ref["sha256"]:
        raise ValueError(f"{ref['path']}: content differs from its hash")
    if ref["media_type"] != "application/json" and lines != ref["record_count"]:
        raise ValueError(f"{ref['path']}: {lines} records instead of {ref['record_count']}")
    return {**ref, "size_bytes": size}


def append_lines(df: DataFrame, folder: str) -> None:
    """Add records to a resumable folder of JSON lines."""
    df.write.mode("append").json(folder)
