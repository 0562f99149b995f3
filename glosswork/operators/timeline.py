"""Sample times of clips: uniform, anchored, at cuts; thinning of short arrays. ``ordered`` thins tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration(seconds: Column, default: float = 60.0) -> Column:
    return F.when(seconds > 0, seconds).otherwise(F.lit(default))


def uniform(seconds: Column, n: int, digits: int = 3) -> Column:
    """n times at equal steps of seconds / (n + 1), at least 0.1 apart; half-even rounding."""
    step = F.greatest(seconds / (n + 1), F.lit(0.1))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.bround(i * step, digits))


def anchored(seconds: Column, n: int) -> Column:
    """n times from 2 % to 98 %, at least 0.1; one time is uniform."""
    if n == 1:
        return uniform(seconds, 1)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.bround(F.greatest(F.lit(0.1), seconds * (0.02 + 0.96 * (i - 1) / (n - 1))), 3))


def cuts(signal: DataFrame, key: str, time: str, value: str, threshold: float, most: int) -> DataFrame:
    """The first ``most`` times of each key at which the signal differs from the one before by more than the threshold."""
    order = Window.partitionBy(key).orderBy(time)
    jumps = signal.withColumn("_change", F.abs(F.col(value) - F.lag(value).over(order))).filter(F.col("_change") > threshold)
    return jumps.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select(key, F.col(time).alias("t"))


def hybrid(cut_times: Column, seconds: Column, n: int) -> Column:
    """Up to max(1, n // 2) cuts, then uniform times for the rest, n at most."""
    some = F.slice(cut_times, 1, max(1, n // 2))
    return F.slice(F.concat(some, *(() if n < 1 else (_uniform_of(seconds, n - F.size(some), n),))), 1, n)


def _uniform_of(seconds: Column, count: Column, most: int) -> Column:
    step = F.greatest(seconds / (count + 1), F.lit(0.1))
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: i <= count), lambda i: F.bround(i * step, 3))


def after_cut(cut_time: Column, seconds: Column, offset: float = 0.3, margin: float = 0.5) -> Column:
    return F.least(cut_time + offset, seconds - margin)


def gap_dedup(times: Column, gap: float = 0.75) -> Column:
    """A sorted time stays if it is more than the gap after the last one that stayed."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(times), empty, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) > gap), F.array_append(kept, t)).otherwise(kept))


def even_thin(times: Column, n: int) -> Column:
    """n of more times, at the indexes round(i (m - 1) / (n - 1)), half to even; for n = 1 the first."""
    if n == 1:
        return F.slice(times, 1, 1)
    m = F.size(times)
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(times, F.bround(i * (m - 1) / (n - 1), 0).cast("int")))
    return F.when(m > n, picked).otherwise(times)
