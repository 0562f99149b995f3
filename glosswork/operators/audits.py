"""Audits of captions as one table of issues, and the gate, the report and the weakest rows that are read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import fewer_words
from ..functions.text import let
from ..sources.shared import stored
from .ordered import small
from .scores import gate, summary


LOW = "_low"


def with_dictionaries(captions: DataFrame, terms: DataFrame | None = None, anchors: DataFrame | None = None, task: str = "task_id") -> DataFrame:
    """``captions`` with what their task's dictionaries say: ``_terms`` that nothing supports and groups of ``_anchors``; null for a task without.

    ``terms(task, term)`` and ``anchors(task, choices)`` are dictionaries, with few entries for each task.
    """
    out = captions
    for table, column, name in ((terms, "term", "_terms"), (anchors, "choices", "_anchors")):
        if table is None:
            kind = "array<string>" if name == "_terms" else "array<array<string>>"
            out = out.withColumn(name, F.lit(None).cast(kind))
            continue
        entries = table.groupBy(F.col(task).alias("_of")).agg(F.collect_list(column).alias(name))
        out = out.join(small(entries), F.col(task) == F.col("_of"), "left").drop("_of")
    return out


def _bare(word: Column) -> Column:
    return F.btrim(word, F.lit(".,!?;:()[]{}\"'`"))


def detail_tokens(low: Column) -> Column:
    """Words of a lower-cased text, parted by spaces and slashes, without punctuation at their ends."""
    parts = F.filter(F.split(F.replace(low, F.lit("/"), F.lit(" ")), " "), lambda w: w != "")
    return F.transform(parts, _bare)


def shared_anchors(caption: Column, low: Column | None = None) -> Column:
    """How many of the task's anchor groups share a word with the caption, or with ``low``, the caption in lower case; -1 for a task without groups.

    Groups with a choice between two spaces do, groups without a choice anywhere in the text don't; only for others the text is cut into words.
    """

    def between_spaces(low: Column, choice: Column) -> Column:
        plain = (choice != "") & (_bare(choice) == choice) & ~F.contains(choice, F.lit(" ")) & ~F.contains(choice, F.lit("/"))
        return plain & F.contains(low, choice) & F.contains(low, F.concat(F.lit(" "), choice, F.lit(" ")))

    def met(low: Column) -> Column:
        sure = F.transform("_anchors", lambda g: F.coalesce(F.exists(g, lambda c: between_spaces(low, c)), F.lit(False)))
        return let(sure, lambda known: F.size(F.filter(known, lambda k: k)) + let(unsure(low, known), lambda groups: among(low, groups)))

    def unsure(low: Column, known: Column) -> Column:
        return F.filter("_anchors", lambda g, i: ~F.get(known, i) & F.exists(g, lambda c: F.contains(low, c)))

    def among(low: Column, groups: Column) -> Column:
        found = let(detail_tokens(low), lambda tokens: F.size(F.filter(groups, lambda g: F.arrays_overlap(g, tokens))))
        return F.when(F.size(groups) == 0, F.lit(0)).otherwise(found)

    return F.when(F.col("_anchors").isNull(), F.lit(-1)).otherwise(let(F.lower(caption), met) if low is None else met(low)).cast("long")


def detail_check(least_words: dict[str, int], least_anchors: dict[str, int], otherwise: tuple[int, int], low: Column | None = None) -> Column:
    """too_thin below the style's words, few_anchors below its anchor groups; a task without groups passes."""
    text, style = F.coalesce(F.col("caption"), F.lit("")), F.col("style")
    of = lambda values, other, use: F.coalesce(*(F.when(style == s, use(n)) for s, n in values.items()), use(other))
    thin = of(least_words, otherwise[0], lambda n: fewer_words(text, n))
    few = let(shared_anchors(text, low), lambda shared: (shared >= 0) & (shared < of(least_anchors, otherwise[1], F.lit)))
    return F.array_compact(F.array(F.when(thin, "too_thin"), F.when(few, "few_anchors")))


def grounding_check(low: Column | None = None) -> Column:
    """The task's unsupported terms that the caption holds, within words too."""
    held = lambda low: F.filter("_terms", lambda t: F.contains(low, t))
    found = let(F.lower(F.coalesce(F.col("caption"), F.lit(""))), held) if low is None else held(low)
    named = F.transform(found, lambda t: F.concat(F.lit("unsupported: "), t))
    return F.when(F.col("_terms").isNull(), F.array().cast("array<string>")).otherwise(named)


def issue_table(captions: DataFrame, checks: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per issue: keys, style, check, code. All checks run in one pass, and the table is written once for all that read it.

    Checks may read ``LOW``, a column of the caption in lower case that is made once for all of them.
    """
    named = lambda name, codes: F.transform(codes, lambda c: F.struct(F.lit(name).alias("check"), c.alias("code")))
    found = [named(name, codes) for name, codes in checks.items()]
    captions = captions.withColumn(LOW, F.lower(F.coalesce("caption", F.lit(""))))
    return stored(captions.select(*keys, "style", F.explode(F.concat(*found)).alias("_issue")).select(*keys, "style", "_issue.check", "_issue.code"))


def quality_gate(issues: DataFrame, checks: Sequence[str], scores: DataFrame, least: float = 0.93) -> DataFrame:
    """Rows (check, passed, message): each check passes without issues, judge_score from the mean final on, and gate if all do.

    Without scores judge_score doesn't pass.
    """
    names = issues.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    counts = names.join(issues.groupBy("check").agg(F.count("*").alias("n")), "check", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    audits = counts.select("check", (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" issues")).alias("message"))
    score = F.concat(F.lit("final "), F.floor(F.col("final") * 1000).cast("string"), F.lit(" of 1000, "), F.col("n").cast("string"), F.lit(" rows"))
    judged = summary(scores).select(F.lit("judge_score").alias("check"), ((F.col("n") > 0) & (F.col("final") >= least)).alias("passed"), score.alias("message"))
    return gate(stored(audits.unionByName(judged)))  # read twice


def report(issues: DataFrame, order: Sequence[str], most: int = 12) -> DataFrame:
    """The first issues by the order, each with the number of all issues."""
    return issues.orderBy(*order).limit(most).crossJoin(issues.agg(F.count("*").alias("total")))  # one row


def weakest(scores: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The rows of lowest mean of accuracy and style, the smaller key of equals first."""
    final = (F.coalesce("accuracy", F.lit(0.0)) + F.coalesce("style_match", F.lit(0.0))) / 2
    return scores.withColumn("final", final).orderBy("final", key).limit(most)
