"""The whole run: seeds, generated candidates, choice by evidence, repair, normalising, validation, overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.checks import style_passes
from ..functions.facts import Facts, static_fallback
from ..functions.text import final_caption
from ..sources.shared import stored
from . import captions as cap
from . import dataset as ds
from . import select as sel
from .infer import Model, generate
from .ordered import small
from .topics import with_fallback


def seeded(tasks: DataFrame, styles: Sequence[str] = rules.STYLES) -> DataFrame:
    """Every task with a caption of each style, before any work: task_id, style, caption."""
    return ds.cross_styles(tasks.select("task_id").distinct(), styles).withColumn("caption", static_fallback(F.col("style")))


def candidates(scenes: DataFrame, model: Model, topics: DataFrame, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, **lists) -> DataFrame:
    """scenes(task_id, style, scene, facts, prompt) as rows with ``caption``, ``set_no``, ``score`` and ``n_issues``.

    Set 0 is the model's caption, where its call succeeded; set 1 the fallback, where it has no issues.
    """
    rows = generate(with_fallback(scenes, ["scene"], topics), model, asked=scenes)  # last, so that nothing that is counted or joined on the way calls it again
    sets = F.array(F.struct(F.lit(0).alias("set_no"), F.when(F.col("ok"), final_caption(F.col("text"))).alias("caption")), F.struct(F.lit(1).alias("set_no"), F.col("fallback").alias("caption")))
    each = rows.select(*scenes.columns, F.explode(sets).alias("_set")).select(*scenes.columns, "_set.set_no", "_set.caption").filter("trim(caption) <> ''")
    return scored(each, clear, stop, **lists).filter("set_no = 0 or n_issues = 0")


def scored(rows: DataFrame, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, **lists) -> DataFrame:
    """rows(style, facts, caption) with their evidence score and the number of issues."""
    graded = rows.withColumn("_graded", Facts(rows).graded(F.col("style"), F.col("caption"), clear, stop))
    score = F.when(style_passes(F.col("style"), F.col("caption"), **lists), F.col("_graded.value")).otherwise(F.lit(-10.0))
    return graded.withColumns({"score": score, "n_issues": F.col("_graded.n_issues")}).drop("_graded")


def repaired(best: DataFrame, repair: Model, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, **lists) -> DataFrame:
    """Captions with issues after one repair each: the model's if it scores as well, then a built one if it scores better."""
    f = Facts(best)
    prompt = ds.repair_prompt(F.col("caption"), f.issues(F.col("style"), F.col("caption"), clear, stop), f.evidence_terms(stop))
    asked = generate(best.filter("n_issues > 0").withColumn("prompt", prompt), repair)
    offered = asked.withColumn("offer", F.coalesce(F.when(F.col("ok"), final_caption(F.col("text"))), F.col("caption")))
    offered = offered.withColumn("_terms", f.evidence_terms(stop))
    score = lambda c: Facts(offered).evidence_score(F.col("style"), c, clear, stop, F.col("_terms"), **lists)
    built = Facts(offered).evidence_caption(F.col("style"), F.col("offer"))
    graded = offered.withColumns({"_offered": score(F.col("offer")), "_built": score(built)})
    taken = sel.repair_taken(F.col("score"), F.col("_offered"), F.col("_built"))
    out = graded.withColumn("caption", F.when(taken == "deterministic", built).when(taken == "model", F.col("offer")).otherwise(F.col("caption")))
    return best.filter("n_issues = 0").unionByName(out.select(best.columns))


def caption_run(tasks: DataFrame, scenes: DataFrame, model: Model, topics: DataFrame, repair: Model | None = None, styles: Sequence[str] = rules.STYLES, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, **lists) -> DataFrame:
    """Every task with captions of all styles: task_id, captions (a map), ``generated``, how many of them aren't seeds, and ``reason``, null as all are valid.

    Every task is seeded first, so calls that fail, scenes without words and tasks without scenes leave no gap. Of the candidates of a task and style
    the first scene's caption is taken at once if it has no issues, else the one of highest evidence score. It is repaired, where a
    repair model is given, normalised with its own facts, and laid over the seed. A map that validation rejects gives way to the seeds.
    ``scene`` is a number that orders the scenes of a task and style and names a scene.
    """
    key, words = ["task_id", "style"], {"clear": clear, "stop": stop}
    named = [*key, "scene"]
    wide = [c for c in scenes.columns if c not in named]  # facts and prompts are read again for the few scenes that win
    offered = stored(candidates(scenes, model, topics, **words, **lists).drop(*wide))
    slim = offered.select(*key, "scene", "set_no", "score", "n_issues").withColumn("order", F.struct("scene", "set_no"))
    won = sel.accept_early(slim, key, (F.col("n_issues") == 0) & (F.col("set_no") == 0), "score", "order").select(*key, "scene", "set_no")
    best = scenes.join(small(offered.join(small(won), [*named, "set_no"])), named)
    best = stored(repaired(best, repair, **words, **lists)) if repair else best
    grounded = with_fallback(best, ["scene"], topics, "_fallback")
    final = cap.normalise(grounded, Facts(grounded), F.col("_fallback"), **lists).select(*key, F.col("final").alias("_final"))
    laid = seeded(tasks, styles).join(final, key, "left")
    fixed = F.map_from_entries(F.collect_list(F.struct("style", "caption")))
    maps = laid.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("style", F.coalesce("_final", "caption")))).alias("captions"), fixed.alias("_seeds"), F.count("_final").alias("generated"))
    judged = cap.validate_results(maps, styles)
    rejected = F.col("reason").isNotNull()
    safe = judged.select("task_id", F.when(rejected, F.col("_seeds")).otherwise(F.col("captions")).alias("captions"), F.when(rejected, 0).otherwise(F.col("generated")).cast("long").alias("generated"))
    return cap.validate_results(safe, styles)
