"""Tasks, results and captions as tables: validation, reshaping, normalising, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.checks import fewer_words, has_terms, looks_english, low_jargon, low_terms, low_within, style_passes, style_reason, words
from ..functions.facts import Facts, static_fallback
from ..functions.text import clean, let, without_hedges
from ..sources.io import write_rows


def _array(items: Sequence[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def validate_tasks(tasks: DataFrame, required: Sequence[str] = rules.STYLES) -> DataFrame:
    """Tasks with the required styles and the given ones after them, and ``reason``: null for a valid task."""
    unknown = F.array_except(F.coalesce("styles", F.array().cast("array<string>")), _array(required))
    reason = F.when(F.col("task_id").isNull(), "task_id").when(~F.coalesce(F.rlike("video_url", F.lit("^https?://[^/]+")), F.lit(False)), "video_url").when(F.size(unknown) > 0, F.concat(F.lit("styles: "), F.array_join(F.array_sort(unknown), ",")))
    return tasks.withColumn("reason", reason).withColumn("styles", F.array_union(_array(required), F.coalesce("styles", F.array().cast("array<string>"))))


def validate_results(results: DataFrame, required: Sequence[str] = rules.STYLES) -> DataFrame:
    """``reason`` names the offending styles of a captions map; null for a valid one."""
    keys = F.map_keys("captions")
    unknown, missing = F.array_except(keys, _array(required)), F.array_except(_array(required), keys)
    blank = F.map_keys(F.map_filter("captions", lambda _, v: F.coalesce(F.trim(v), F.lit("")) == ""))
    named = lambda what, c: F.concat(F.lit(f"{what}: "), F.array_join(F.array_sort(c), ","))
    return results.withColumn("reason", F.when(F.size(unknown) > 0, named("unknown", unknown)).when(F.size(missing) > 0, named("missing", missing)).when(F.size(blank) > 0, named("blank", blank)))


def write_results(results: DataFrame, path: str, kind: str = "json", required: Sequence[str] = rules.STYLES, shown: int = 3) -> None:
    """Replace the results of a path, if all are valid; else ValueError names the first offenders, and what is there stays."""
    bad = validate_results(results, required).filter("reason is not null").orderBy("task_id").select("task_id", "reason").limit(shown).collect()
    if bad:
        raise ValueError("; ".join(f"{r['task_id']}: {r['reason']}" for r in bad))
    write_rows(results, path, kind)


def explode_captions(results: DataFrame) -> DataFrame:
    return results.select("task_id", F.explode("captions").alias("style", "caption"))


def assemble_captions(captions: DataFrame, fill: str = "", required: Sequence[str] = rules.STYLES) -> DataFrame:
    """One row per task with all required styles in order; a style's last caption by ``position`` counts."""
    last = captions.groupBy("task_id", "style").agg(F.max_by("caption", "position").alias("caption"))
    maps = last.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("style", "caption"))).alias("found"))
    each = [x for s in required for x in (F.lit(s), F.coalesce(F.try_element_at("found", F.lit(s)), F.lit(fill)))]
    return maps.select("task_id", F.create_map(*each).alias("captions"))


def normalise(captions: DataFrame, facts: Facts | None = None, fallback: Column | None = None, cleaned: str | None = None, **lists) -> DataFrame:
    """Adds ``final``, ``reason`` and ``action`` to rows with style and caption, and the cleaned caption where ``cleaned`` names it.

    In order: cleaning; the word floor of a style, where there are facts; hedges taken out if that makes the
    caption pass; exclamation marks to full stops if they are the only fault; else a fallback from the
    facts, or the given one; if that breaks a rule as well, the fixed one. The floor is judged before any repair.
    """
    style = F.col("style")
    text = clean(F.coalesce("caption", F.lit("")))
    floor = reduce(lambda c, s: c.when(style == s, rules.FLOORS[s]), rules.FLOORS, F.when(F.lit(False), 1)).otherwise(1) if facts else F.lit(1)
    step = captions.withColumn("_clean", text).withColumn("_short", F.size(words(F.col("_clean"))) < floor)
    # a text is judged once; a repaired one only where the text before broke a rule
    step = step.withColumn("_first", style_reason(style, F.col("_clean"), **lists))
    bare = without_hedges(F.col("_clean"))
    step = step.withColumn("_bare", F.when((F.col("_first") != "ok") & (F.col("_clean") != ""), bare))
    step = step.withColumn("_freed", F.coalesce((F.col("_bare") != F.col("_clean")) & style_passes(style, F.col("_bare"), **lists), F.lit(False)))
    step = step.withColumn("_one", F.when(F.col("_freed"), F.col("_bare")).otherwise(F.col("_clean"))).withColumn("_why", F.when(F.col("_freed"), "ok").otherwise(F.col("_first")))
    calm = F.regexp_replace("_one", "!+", ".")
    step = step.withColumn("_calm", F.when(F.col("_why") == "exclamation", calm)).withColumn("_calmed", F.col("_calm").isNotNull() & style_passes(style, F.col("_calm"), **lists))
    step = step.withColumn("_two", F.when(F.col("_calmed"), F.col("_calm")).otherwise(F.col("_one")))
    step = step.withColumn("reason", F.when(F.col("_clean") == "", "empty").when(F.col("_short"), "too_short").when(F.col("_calmed"), "ok").otherwise(F.col("_why")))
    grounded = fallback if fallback is not None else facts.fallback(style) if facts else static_fallback(style)
    step = step.withColumn("_grounded", F.when(F.col("reason") != "ok", grounded))
    replaced = F.when(style_passes(style, F.col("_grounded"), **lists), F.col("_grounded")).otherwise(static_fallback(style))
    kept = F.col("reason") == "ok"
    action = F.when(~kept, "fallback").when(F.col("_two") != F.col("_clean"), "repaired").otherwise("kept")
    out = step.withColumn("final", F.when(kept, F.col("_two")).otherwise(replaced)).withColumn("action", action)
    return out.select(*captions.columns, "final", "reason", "action", *([F.col("_clean").alias(cleaned)] if cleaned else []))


def self_check(captions: DataFrame, cap: int = rules.CAPTION_CAP, banned: Sequence[str] = rules.TECH_WORDS, person: Sequence[str] = rules.PERSON_WORDS, low: Column | None = None) -> Column:
    """Codes of structural faults of one caption; ``low`` is the caption in lower case, where a column holds it already."""
    text, style = F.coalesce(F.col("caption"), F.lit("")), F.col("style")
    says = lambda terms: has_terms(text, terms) if low is None else low_terms(low, terms)
    return F.array_compact(
        F.array(
            F.when(F.trim(text) == "", "empty"),
            F.when((F.octet_length(text) > 4 * cap) | (F.char_length(text) > cap), "too_long"),  # a character has four bytes at most
            F.when((F.trim(text) != "") & ~looks_english(text), "not_english"),
            F.when(style.isin("formal", "sarcastic") & F.contains(text, F.lit("!")), "exclamation"),
            F.when((style == "formal") & says(person), "first_second_person"),
            F.when(style.isin("sarcastic", "humorous_non_tech") & says(banned), "tech_jargon"),
        )
    )


def quality_check(tells: Sequence[str], low_taste: Sequence[str], generic: str, banned: Sequence[str] = rules.TECH_WORDS, least: tuple[int, int] = (10, 7), low: Column | None = None) -> Column:
    """Codes of stylistic faults; terms match as substrings here, within words too. ``low`` as in ``self_check``."""
    text, style = F.coalesce(F.col("caption"), F.lit("")), F.col("style")

    def codes(low: Column) -> Column:
        lacks = ~low_jargon(low, [*banned, *rules.TECH_REFERENCES])
        return F.array_compact(
            F.array(
                F.when(low_within(low, tells), "ai_tell"),
                F.when(low_within(low, low_taste), "low_taste"),
                F.when(F.rlike(low, F.lit(generic)), "generic"),
                F.when((style != "humorous_tech") & low_jargon(low, banned), "style_bleed"),
                F.when((style == "humorous_tech") & lacks, "missing_reference"),
                F.when(F.when(style == "formal", fewer_words(text, least[0])).otherwise(fewer_words(text, least[1])), "too_thin"),
            )
        )

    return let(F.lower(text), codes) if low is None else codes(low)


def issues(captions: DataFrame, codes: Column, check: str) -> DataFrame:
    """One row per issue: task_id, style, check, code."""
    return captions.select("task_id", "style", F.lit(check).alias("check"), F.explode(codes).alias("code"))
