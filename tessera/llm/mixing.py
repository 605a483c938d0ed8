"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, form blocks of ``BLOCK`` rows.
With a target weight of c/Q, block j (from 0) of a source is released at slot
floor(j*Q/c) and due by slot ceil((j+1)*Q/c); earliest deadline first picks one
block a slot. On one processor with weights summing to 1 this meets every
deadline, so after any t slots a source has had t*c/Q blocks give or take less
than one. The schedule repeats every Q slots: one period is made on the driver
(Q is a constant), and block j of a source stands at slot
(j div c)*Q + offset[source, j mod c]. Nothing on the driver grows with the data
but the list of sources, which is a bounded catalogue; n sources take up to
n * max(n, PERIOD) slots there.

``targets`` maps source -> weight. Without it, weights are n^ALPHA of the
sources' document counts, counted over all rows (tempered sampling).

At the first slot whose source has no block left, the sources without blocks drop
out and the others go on: their weights are scaled up to 1 again, and a schedule
of its own starts at that slot (a segment; ``segments``), with the same deviation
of less than one block from the segment's weights. So every document has its
place. There are at most as many segments as sources, each with one period. Only
with ``targets``, which are weights to hold, the mix ends at that slot, and later
blocks get a null position. A source's last block may be short. Defined cases: a null source is a source of its own; rows with the
same id tie, and are told apart by their text's hash, then by nothing (equal
rows are interchangeable); a table without ``source`` is one source; an empty table gives an empty result; a source that
``targets`` leaves out, or gives 0, has no position, and one that has no rows is
left out of the weights; extra columns are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from heapq import heappop, heappush
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.kernel import fresh, written

BLOCK = 4
ALPHA = 0.7
PERIOD = 1000
BUCKETS = 1024
BROADCAST_ROWS = 1 << 18


def integer_weights(weights: dict, period: int = PERIOD) -> dict:
    """Positive weights scaled to integers that sum to ``period`` (largest remainder, at least 1 each).

    More sources than slots lengthen the period to one slot a source."""
    live = {k: Fraction(v) for k, v in weights.items() if v and v > 0}
    if not live:
        return {}
    period = max(period, len(live))
    total, order = sum(live.values()), sorted(live, key=lambda k: (k is not None, k or ""))
    exact = {k: live[k] * period / total for k in order}
    out = {k: max(1, floor(exact[k])) for k in order}
    place = {k: i for i, k in enumerate(order)}
    while (gap := period - sum(out.values())) != 0:
        step = 1 if gap > 0 else -1
        ranked = sorted((k for k in order if out[k] + step >= 1), key=lambda k: (-step * (exact[k] - out[k]), place[k]))
        for k in ranked[: abs(gap)]:
            out[k] += step
    return out


def edf_period(shares: dict) -> list:
    """Source of each slot in one period: earliest deadline first among released blocks."""
    q = sum(shares.values())
    names, done, plan = list(shares), dict.fromkeys(shares, 0), []
    waiting, ready = [(0, i) for i in range(len(names))], []  # heaps by release and by deadline
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, i = heappop(waiting)
            k = names[i]
            heappush(ready, (-(-(done[k] + 1) * q // shares[k]), i))
        _, i = heappop(ready)
        k = names[i]
        done[k] += 1
        plan.append(k)
        if done[k] < shares[k]:
            heappush(waiting, (done[k] * q // shares[k], i))
    return plan


def mixture_end(shares: dict, plan: list, blocks: dict) -> int:
    """First slot that finds its source empty."""
    q, offsets = len(plan), {}
    for t, k in enumerate(plan):
        offsets.setdefault(k, []).append(t)
    return min(((blocks.get(k, 0) // c) * q + offsets[k][blocks.get(k, 0) % c] for k, c in shares.items()), default=0)


def segments(weights: dict, blocks: dict, period: int = PERIOD, go_on: bool = True) -> list[tuple[int, dict, list, dict, dict]]:
    """(first slot, shares, plan, blocks before, blocks within) of each stretch in which the same sources have blocks left.

    Without ``go_on`` the first stretch is the only one."""
    out, start, done = [], 0, dict.fromkeys(blocks, 0)
    live = {k: v for k, v in weights.items() if v and v > 0 and blocks.get(k, 0)}
    while live:
        shares = integer_weights(live, period)
        plan = edf_period(shares)
        end = mixture_end(shares, plan, {k: blocks[k] - done[k] for k in live})
        turns, rest = divmod(end, len(plan))
        part = Counter(plan[:rest])
        within = {k: turns * c + part[k] for k, c in shares.items()}
        out.append((start, shares, plan[:end], {k: done[k] for k in live}, within))
        start += end
        for k in live:
            done[k] += within[k]
        live = {k: v for k, v in live.items() if done[k] < blocks[k]} if go_on else {}
    return out


def mix(docs: DataFrame, targets: dict | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with mix_block and mix_position (row order of the mix, null without a place in it) added."""
    return _mix(docs, targets, block, period, alpha, buckets)[0]


def _mix(docs: DataFrame, targets: dict | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``mix``, and a bound that all positions are under.

    A source's rows are numbered without a sort over the whole source: rows are
    counted by (source, hash bucket), the counts summed up, and only the rows of
    one bucket are sorted together."""
    spark, taken = docs.sparkSession, list(docs.columns)
    new = {}
    for n in ("mix_block", "mix_position", "mix_s", "mix_h", "mix_b", "mix_r", "mix_before", "mix_k", "mix_slot", "mix_g", "mix_c", "mix_q", "mix_from", "mix_to", "mix_start"):
        new[n] = fresh(n, taken)
        taken.append(new[n])
    s, h, b, r, before, k, slot = (new[n] for n in ("mix_s", "mix_h", "mix_b", "mix_r", "mix_before", "mix_k", "mix_slot"))
    g, c, q, low, high, start = (new[n] for n in ("mix_g", "mix_c", "mix_q", "mix_from", "mix_to", "mix_start"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.withColumn(s, F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).withColumn(h, F.md5(key.cast("binary")))
    rows = rows.withColumn(b, F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    counts = written(rows.groupBy(s, b).agg(F.count("*").alias(r)), "mix-counts")
    totals = {x[s]: x["n"] for x in counts.groupBy(s).agg(F.sum(r).alias("n")).collect()}
    if targets is None:
        wanted = {x: n**alpha for x, n in totals.items()}
    else:
        wanted = {name: v for x, v in targets.items() if (name := "null" if x is None else f"={x}") in totals}
    parts = segments(wanted, {x: -(-n // block) for x, n in totals.items()}, period, targets is None)
    starts = counts.withColumn(before, F.sum(r).over(Window.partitionBy(s).orderBy(b)) - F.col(r)).select(s, b, before)
    stretches, table = [], []
    for i, (first, shares, plan, past, within) in enumerate(parts):
        stretches += [(x, i, n, sum(shares.values()), past[x], past[x] + within[x], first) for x, n in shares.items() if within[x]]
        seen: dict = {}
        for t, x in enumerate(plan):
            table.append((i, x, seen.get(x, 0), t))
            seen[x] = seen.get(x, 0) + 1
    held = spark.createDataFrame(stretches, f"`{s}` string, `{g}` int, `{c}` long, `{q}` long, `{low}` long, `{high}` long, `{start}` long")
    slots = spark.createDataFrame(table, f"`{g}` int, `{s}` string, `{k}` long, `{slot}` long")
    tie = [h, F.col("doc_id"), F.xxhash64("text")]
    # starts: sources x buckets rows, held: sources x segments, slots: one period a segment; with very many sources they are shuffled
    starts, held, slots = (_small(x, n) for x, n in ((starts, len(totals) * buckets), (held, len(stretches)), (slots, len(table))))
    placed = rows.join(starts, [s, b]).withColumn(r, F.row_number().over(Window.partitionBy(s, b).orderBy(*tie)) - 1 + F.col(before)).withColumn(new["mix_block"], F.floor(F.col(r) / block))
    held = held.withColumnRenamed(s, other := fresh("mix_other", taken))
    placed = placed.join(held, (F.col(s) == F.col(other)) & (F.col(new["mix_block"]) >= F.col(low)) & (F.col(new["mix_block"]) < F.col(high)), "left")
    nth = F.col(new["mix_block"]) - F.col(low)
    placed = placed.withColumn(k, nth % F.col(c)).join(slots, [g, s, k], "left")
    at = F.col(start) + F.floor(nth / F.col(c)) * F.col(q) + F.col(slot)
    position = at * block + F.col(r) % block
    placed = placed.withColumn(new["mix_position"], position.cast("long")).select(*[F.col(f"`{x}`") for x in docs.columns], new["mix_block"], new["mix_position"])
    return placed, sum(-(-n // block) for n in totals.values()) * block


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix_query(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mix_block, mix_position) of every document; text only breaks ties."""
    out = mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text")))
    return out.select("doc_id", "source", "mix_block", "mix_position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, in its order, with the columns of ``docs``.

    Written as Parquet, the files hold that order; ``numbered`` reads it off them."""
    position = fresh("mix_position", docs.columns)
    placed, end = _mix(docs)
    return in_order(placed, position, end).select(*[F.col(f"`{x}`") for x in docs.columns])


def in_order(df: DataFrame, position: str, end: int) -> DataFrame:
    """``df`` in the order of its column ``position``, whose values are nearly dense and under ``end``."""
    part = fresh("mix_part", df.columns)
    # places are dense, so equal runs of them make the partitions: no sampling, which would make the table twice
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.floor(F.col(position) * partitions / F.lit(max(end, 1))).cast("int")
    return df.withColumn(part, run).repartitionById(partitions, part).sortWithinPartitions(position).drop(part)


def numbered(docs: DataFrame, place: str) -> tuple[DataFrame, int]:
    """``docs`` with each row's place from 0 (a new column) in the order in which the table is stored, and their number.

    That order is the one of the files' part numbers, then of the rows in a file; a scan
    does not keep it, since it takes large files first. What is no plain table of files is
    written as one. Rows are only counted by file; the driver holds a number a file."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "numbered")
    spark, columns = docs.sparkSession, list(docs.columns)
    file, row, before = (fresh(n, [*columns, place]) for n in ("place_file", "place_row", "place_before"))
    stored = docs.metadataColumn("_metadata")
    counts = docs.groupBy(stored.getField("file_path").alias(file)).agg(F.count("*").alias(row)).collect()
    starts, end = [], 0
    for path, n in sorted(((x[file], x[row]) for x in counts), key=lambda x: _part_number(x[0])):
        starts.append((path, end))
        end += n
    held = _small(spark.createDataFrame(starts, f"`{file}` string, `{before}` long"), len(starts))
    rows = docs.select("*", stored.getField("file_path").alias(file), stored.getField("row_index").alias(row)).join(held, file)
    return rows.select(*[F.col(f"`{x}`") for x in columns], (F.col(before) + F.col(row)).alias(place)), end


def _part_number(path: str) -> tuple[str, int, str]:
    """A file's folder, number and name; numbers of over five digits stand behind the others."""
    folder, _, name = path.rpartition("/")
    number = re.match(r"part-(\d+)", name)
    return folder, int(number[1]) if number else -1, name
