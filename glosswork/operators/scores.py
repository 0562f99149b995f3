"""Means of judge verdicts under explicit policies for missing values, run boards, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranked


def zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def means() -> list[Column]:
    """n, accuracy, style and final of score rows; a missing value counts as 0, no rows give zeros."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return [F.count("*").alias("n"), mean(zero("accuracy")).alias("accuracy"), mean(zero("style_match")).alias("style"), mean((zero("accuracy") + zero("style_match")) / 2).alias("final")]


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(*means())


def scoreboard(scores: DataFrame, run: str) -> DataFrame:
    """One row per run, best final first, ties by run."""
    return scores.groupBy(run).agg(*means()).orderBy(F.desc("final"), run)


def per_style(scores: DataFrame, style: str) -> DataFrame:
    """Means per style and over all rows (style "overall"): the micro mean, not the mean of style means."""
    return scores.rollup(style).agg(F.grouping(style).alias("_all"), *means()).select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(style)).alias(style), "n", "accuracy", "style", "final")


def panel_mean(verdicts: DataFrame, caption: str, score: str) -> DataFrame:
    """Mean over the judges of each caption without NaN; captions without a valid verdict go."""
    return verdicts.groupBy(caption).agg(F.avg(F.when(~F.isnan(score), F.col(score))).alias("mean")).filter("mean is not null")


def claim_precision(claims: DataFrame, caption: str, correct: Column, contradicted: Column, cap: float = 0.4) -> DataFrame:
    """Share of correct claims per caption, at most ``cap`` where one is contradicted; correct claims and contradictions."""
    own = claims.groupBy(caption).agg(F.avg(correct.cast("double")).alias("share"), F.max(contradicted.cast("int")).alias("bad"), F.sum(correct.cast("long")).alias("correct"), F.sum(contradicted.cast("long")).alias("contradictions"))
    return own.withColumn("precision", F.when(F.col("bad") == 1, F.least("share", F.lit(cap))).otherwise(F.col("share"))).drop("bad")


def gate(checks: DataFrame) -> DataFrame:
    """checks(check, passed, message) and a row "gate" that passes if all do."""
    return checks.unionByName(checks.agg(F.lit("gate").alias("check"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.concat(F.count_if(~F.col("passed")).cast("string"), F.lit(" failed")).alias("message")))


def leaders(entries: DataFrame, score: str, name: str, own: Column, most: int = 3) -> DataFrame:
    """The ``most`` best entries, the smaller name of equals first, and one's own wherever they stand, with ``place`` and ``own``.

    Places are counted over ranges of the score, so no task sorts all entries.
    """
    return ranked(entries, [], [F.desc(score), name], "place").withColumn("own", F.coalesce(own, F.lit(False))).filter((F.col("place") <= most) | F.col("own"))
