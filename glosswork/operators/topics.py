"""Fallback captions by topic: rules as a table, found by the words of the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.facts import Facts
from .ordered import beside, small

RULES = "style string, rank int, words array<string>, template string"


def topic_rules(spark: SparkSession, topics: Sequence[tuple[str, int, Sequence[str], str]] = rules.TOPIC_FALLBACKS) -> DataFrame:
    """Rules as a table: of the rules of a style that a text's words meet, the one of lowest rank counts."""
    return spark.createDataFrame([(s, r, list(w), t) for s, r, w, t in topics], RULES)


def met_templates(rows: DataFrame, keys: Sequence[str], topics: DataFrame, facts: str = "facts") -> DataFrame:
    """Per key and style the template of the first rule that has a word of the facts; no row where there is none.

    An inverted index leads from a word to its rules, so the work grows with the words of the facts, not with their number times that of the
    rules. Whole words are met: "located" isn't a cat. Only hits are shuffled, while the index is small.
    """
    index = topics.select("style", "rank", "template", F.explode("words").alias("_word")).distinct()
    words = F.array_distinct(F.regexp_extract_all(Facts(rows, facts).all_text(), F.lit("([a-z]+)"), F.lit(1)))
    hits = rows.select(*keys, "style", F.explode(words).alias("_word")).join(small(index), ["style", "_word"])
    return hits.groupBy(*keys, "style").agg(F.min_by("template", F.struct("rank", "template")).alias("_template"))


def with_fallback(rows: DataFrame, keys: Sequence[str], topics: DataFrame, name: str = "fallback", facts: str = "facts") -> DataFrame:
    """``rows`` (style and facts) with a fallback caption: by topic where there is a summary and a rule is met, else from the facts, else fixed.

    In a template ``{scene}`` stands for the summary and ``{phrase}`` for the first words of the facts. ``keys`` name a row; rows that share
    them share their facts' topic.
    """
    f = Facts(rows, facts)
    met = beside(rows, met_templates(rows, keys, topics, facts), [*keys, "style"])
    filled = F.replace(F.replace(F.col("_template"), F.lit("{scene}"), F.lower(f.scene())), F.lit("{phrase}"), f.first_words(20))
    return met.withColumn(name, F.coalesce(F.when(f.scene() != "", filled), f.fallback(F.col("style")))).drop("_template")
