"""Training rows from scenes: a teacher's replies taken scene by scene, validation, and rows, drops and failures from one run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.shared import scratch
from .infer import Model, generate


@dataclass(frozen=True)
class Taught:
    """Training rows that passed, those that validation dropped, scenes that failed with their error, and the numbers of scenes and of failed ones."""

    rows: DataFrame
    dropped: DataFrame
    failures: DataFrame
    counts: dict[str, int]


def teach(scenes: DataFrame, model: Model, valid: Column, styles: Sequence[str] = rules.STYLES, **kw) -> Taught:
    """One call per scene (its ``prompt``) for captions of all styles as a JSON object.

    A scene is kept or fails as a whole: a failed call, a reply that is no object and one that lacks a style, or leaves it blank, give a row of
    failures (the scene's columns and ``error``) and no training rows. Of the other scenes each style is a row (the scene's columns,
    ``style``, ``caption``), kept if ``valid``. The replies are written once; rows, drops and failures are read from that table, and the counts
    are taken while it is written. Styles that weren't asked for are ignored. An empty table gives empty tables.
    """
    replies = generate(scenes, model, **kw)
    found = F.from_json("text", "map<string,string>")
    wanted = F.array(*map(F.lit, styles))
    lacking = F.filter(wanted, lambda s: F.trim(F.coalesce(F.try_element_at("_captions", s), F.lit(""))) == "")
    error = F.when(~F.col("ok"), F.coalesce("error", F.lit("blank"))).when(F.col("_captions").isNull(), "not an object").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ",")))
    outcome = replies.withColumn("_captions", found).withColumn("_error", error).select(*scenes.columns, "_captions", "_error")
    offered = F.transform(wanted, lambda s: F.struct(s.alias("style"), F.try_element_at("_captions", s).alias("caption")))
    seen, path = Observation(), scratch(scenes.sparkSession)
    outcome.observe(seen, F.count("*").alias("scenes"), F.count("_error").alias("failed")).write.parquet(path)
    outcome = scenes.sparkSession.read.parquet(path)
    rows = outcome.filter("_error is null").select(*scenes.columns, F.explode(offered).alias("_row"))
    rows = rows.select(*scenes.columns, "_row.style", "_row.caption").withColumn("_valid", F.coalesce(valid, F.lit(False)))
    failures = outcome.filter("_error is not null").select(*scenes.columns, F.col("_error").alias("error"))
    return Taught(rows.filter("_valid").drop("_valid"), rows.filter("not _valid").drop("_valid"), failures, dict(seen.get))


def write_valid(rows: DataFrame, valid: Column, path: str) -> dict[str, int]:
    """Write the valid rows as JSON lines; how many were kept and dropped is counted in the same pass."""
    seen = Observation()
    ok = F.coalesce(valid, F.lit(False))
    rows.observe(seen, F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped")).filter(ok).write.mode("overwrite").json(path)
    return dict(seen.get)
