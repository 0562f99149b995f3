"""Ranks, passes and as-of joins over sorted ranges, so that the rows of one key are dealt over all tasks.

Rows are dealt by ranges of (keys, order) and sorted within them. A key of many rows spans neighbouring ranges, and what a range must know
of those beside it, a count, a last kept time or a first frame, is one small row for each range and key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Tables of no more rows than this are broadcast (some 20 MB).
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast of a table that a count shows to be small, else the table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` dealt by ranges of the order and sorted within them, with ``_part``, the number of the range, and ``_at``, the place in it."""
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"_of_{c}"])
    return out


def beside(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on columns that may be null; of ``right`` only what it adds stays."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in columns})
    return left.join(small(named), _same(left, named, columns), "left").drop(*(f"_of_{c}" for c in columns))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with the place of each row in its key by the order, from 1, and the number of the key's rows as ``total``.

    Places are counted within ranges, and the counts of the ranges before are added, so no task holds a whole key. Equal rows of the order are
    neighbours in any order; null is a key. An empty table stays empty. Give it few columns: the rows are written once.
    """
    rows = ranges(df, *keys, *order)
    counts = cut(rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_first") + 1)
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    out = beside(rows, offsets.drop("_first", "_n"), [*keys, "_part"])
    return out.withColumn(rank, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 2, above: int = 6) -> DataFrame:
    """The first row of each key and every k-th after it, where the key has more than ``above`` rows; else all of them."""
    out = ranked(df, keys, order, "_rank", "_total")
    return out.filter((F.col("_total") <= above) | ((F.col("_rank") - 1) % k == 0)).drop("_rank", "_total")


def even_thin(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """n of each key's more rows, at the places round(i (m - 1) / (n - 1)), half to even; for n = 1 the first."""
    out = ranked(df, [key], [time], "_rank", "_total")
    last = F.col("_total") - 1
    picked = F.array(*(F.bround(i * last / (n - 1), 0).cast("long") for i in range(n))) if n > 1 else F.array(F.lit(0).cast("long"))
    return out.filter((F.col("_total") <= n) | F.array_contains(picked, F.col("_rank") - 1)).drop("_rank", "_total")


# --- gap thinning ------------------------------------------------------------------------------------------------


class Chains:
    """All ways in which a run of ascending times can be thinned, by what was kept before it.

    A time is kept if it is more than the gap after the last kept one. What was kept before the run decides which of its times is the
    first kept, and that time the rest; ways that have kept the same time last go on as one. Only times within a
    gap of the first one can be first.
    """

    def __init__(self, gap: float) -> None:
        self.gap, self.first, self.open = gap, None, True
        self.starts: list[float] = []
        self.ways: deque[tuple[float, list[int]]] = deque()  # last kept time, ascending, and the starts that have led to it

    def add(self, time: float) -> None:
        kept: list[int] = []
        while self.ways and time - self.ways[0][0] > self.gap:
            more = self.ways.popleft()[1]
            kept, more = (kept, more) if len(kept) >= len(more) else (more, kept)
            kept.extend(more)
        if self.first is None:
            self.first = time
        if self.open and (not self.starts or time > self.starts[-1]):
            kept.append(len(self.starts))
            self.starts.append(time)
        self.open = self.open and time - self.first <= self.gap
        if kept:
            self.ways.append((time, kept))

    def steps(self) -> tuple[list[float], list[float]]:
        """The first kept times, ascending, and the last kept time that each leads to; of neighbours with equal ends the latest."""
        ends = [0.0] * len(self.starts)
        for last, of in self.ways:
            for i in of:
                ends[i] = last
        keep = [i for i in range(len(ends)) if i + 1 == len(ends) or ends[i] != ends[i + 1]]
        return [self.starts[i] for i in keep], [ends[i] for i in keep]


def carried(carry: float | None, starts: Sequence[float], ends: Sequence[float], gap: float) -> float | None:
    """What is kept last after a run, given what was kept before it."""
    for start, end in zip(starts, ends, strict=True):
        if carry is None or start - carry > gap:
            return end
    return carry


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int, pa.Array]]:
    """Runs of rows of one key: first row, row after the last one, the key."""
    if not batch.num_rows:
        return []
    column = batch.column("_key")
    codes = column.dictionary_encode().indices.fill_null(-1).to_pylist()
    at = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1]), len(codes)]
    return [(low, high, column.slice(low, 1)) for low, high in zip(at, at[1:])]


def _summarised(gap: float):
    """Of each range, the ways of its first key and, from nothing kept before, the last kept time of its last key."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, ways, key, last = None, Chains(gap), None, None
        for batch in rows:
            times = batch.column("_time").to_pylist()
            for low, high, now in _runs(batch):
                opening = now if opening is None else opening
                if now.equals(opening):
                    for t in times[low:high]:
                        ways.add(t)
                    continue
                last = last if key is not None and now.equals(key) else None
                key = now
                for t in times[low:high] if high == len(times) else ():  # a run that ends before isn't the range's last
                    last = t if last is None or t - last > gap else last
        part = TaskContext.get().partitionId()
        found = [(opening, *ways.steps())] if opening is not None else []
        found += [(key, [last], [last])] if key is not None and last is not None else []
        for k, starts, ends in found:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), k, pa.array([starts], pa.list_(pa.float64())), pa.array([ends], pa.list_(pa.float64()))], ["part", "_key", "starts", "ends"])

    return run


def _chained(gap: float):
    """What is carried into each range of a key that begins in one before."""

    def run(table: pa.Table) -> pa.Table:
        carry, parts, carries = None, [], []
        for row in table.sort_by("part").to_pylist():
            if carry is not None:
                parts.append(row["part"])
                carries.append(carry)
            carry = carried(carry, row["starts"], row["ends"], gap)
        return pa.table({"part": pa.array(parts, pa.int64()), "carry": pa.array(carries, pa.float64())})

    return run


def _kept(gap: float, carry: dict[int, float]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, carry.get(TaskContext.get().partitionId())
        for batch in rows:
            times, keep = batch.column("_time").to_pylist(), []
            for low, high, now in _runs(batch):
                last = last if key is None or now.equals(key) else None
                key = now
                for t in times[low:high]:
                    stays = last is None or t - last > gap
                    keep.append(stays)
                    last = t if stays else last
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select([c for c in kept.schema.names if c not in ("_key", "_time")])

    return run


def gap_dedup(df: DataFrame, key: str, time: str, gap: float = 0.75) -> DataFrame:
    """The rows of each key whose time is more than the gap after the last one that stayed; the first one stays.

    A pass over sorted ranges carries no more than the last kept time. For a key that spans several ranges, each range is first solved
    for every time that can have been kept last before it; these ways are few, as they run together, and chaining them tells each
    range what it starts from: one number a range. Of equal times one stays, null is a key, and rows whose time is null or NaN
    don't stay. An empty table stays empty.
    """
    rows = df.withColumns({"_key": F.col(key), "_time": F.col(time).cast("double")}).filter("_time is not null and not isnan(_time)")
    rows = ranges(rows, "_key", "_time").drop("_part", "_at")
    kind = rows.schema["_key"].dataType.simpleString()
    steps = rows.select("_key", "_time").mapInArrow(_summarised(gap), f"part long, _key {kind}, starts array<double>, ends array<double>")
    chain = steps.groupBy("_key").applyInArrow(_chained(gap), "part long, carry double").collect()  # no more rows than there are ranges
    return rows.mapInArrow(_kept(gap, {r["part"]: r["carry"] for r in chain}), df.schema)


# --- as-of -------------------------------------------------------------------------------------------------------


def at_or_after(requests: DataFrame, frames: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """For each request the first frame of its key at or after its time: key, time, frame_time, value; null where there is none.

    Requests and frames are dealt by ranges of key and time. A request finds its frame in its own range, or else takes the first frame of
    the nearest later range of its key that has one: a minimum for each range and key, and the next of these. Of frames at the same time the
    one of smallest value counts. Null is a key; requests and frames without a time meet nothing.
    """
    of = dict(frames.dtypes)
    asked = requests.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(of[value]).alias("_v"))
    given = frames.filter(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_v"))
    rows = ranges(asked.unionByName(given), "_k", "_t", F.desc("_kind"), "_v").drop("_at")
    frame = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    heads = cut(rows.groupBy("_k", "_part").agg(F.min(frame).alias("_head")))
    later = Window.partitionBy("_k").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.select("_k", "_part", F.first("_head", True).over(later).alias("_next")).filter("_next is not null")
    # backwards in time: what was seen last is the nearest at or after; frames come before requests of the same time
    back = Window.partitionBy("_k", "_part").orderBy(F.desc("_t"), "_kind", F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_own", F.last(frame, True).over(back)).filter("_kind = 1")
    out = beside(found, heads, ["_k", "_part"]).withColumn("_frame", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_next")))
    return out.select(F.col("_k").alias(key), F.col("_t").alias(time), F.col("_frame.t").alias("frame_time"), F.col("_frame.v").alias(value))
