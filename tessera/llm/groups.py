"""Comparing the members of buckets of any size without one task holding a bucket.

``blocked`` cuts a bucket of more than ``limit`` members into chunks by a hash and
gives every pair of chunks a group of its own, so a group has at most about twice
``limit`` rows however many the bucket has; buckets within the limit are one group.
``spanning`` joins what is near within a group by as few edges as there are members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2048


def blocked(members: DataFrame, size: Column, member: str, limit: int = LIMIT) -> DataFrame:
    """``members`` with block_i, block_j and block_side: the chunks whose pairs a group compares, and a row's own.

    ``size``: the number of its bucket's members. A row of a bucket of c chunks is given c times."""
    chunks = F.greatest(F.lit(1), F.ceil(size / limit)).cast("int")
    own = F.pmod(F.xxhash64(member), chunks.cast("long")).cast("int")
    rows = members.withColumn("block_side", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumns({"block_i": F.least("block_side", "other"), "block_j": F.greatest("block_side", "other")}).drop("other")


def spanning(m: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], side: np.ndarray | None = None, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the members 0..m-1 under ``near(rows, columns) -> bool matrix``.

    Breadth first, each round against the members not reached yet: a tight group costs
    one row. With ``side`` (0 or 1) only members of different sides are compared."""
    left = np.arange(m)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            now, queue = queue[:step], queue[step:]
            close = near(now, left)
            if side is not None:
                close &= side[now][:, None] != side[left][None, :]
            hit = close.any(axis=0)
            if hit.any():
                a.append(now[close[:, hit].argmax(axis=0)])
                b.append(left[hit])
                queue = np.concatenate([queue, left[hit]])
                left = left[~hit]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups from rows sorted by their first ``keys`` columns (longs or ints without nulls).

    Small batches are put together, and a group that spans batches is never cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = starts_of(whole, keys)
        last = int(new[-1])
        if last:
            yield whole.slice(0, last)
        held, n = [whole.slice(last)], whole.num_rows - last
        if not last:
            rows = max(rows, 2 * n)  # a group larger than the batch: look again only when it has doubled
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def starts_of(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Places where a new group begins."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in range(keys):
        column = np.asarray(batch.column(k))
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)
