"""Benchmark decontamination: documents that hold windows of benchmark items (prefix-filtered set join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, row_key, without_rows

#: Tables of no more rows than this are broadcast (some 20 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: What parts words; splitting takes half the time of extracting the words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: str) -> Column:
    """The words of a text, with an empty string before them, after them or both where the text has other characters there."""
    return F.split(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), _BETWEEN)


def _number(split: str) -> Column:
    """The number of words among what _split gives."""
    size = F.size(split)
    return size - (F.element_at(split, 1) == "").cast("int") - ((F.element_at(split, -1) == "") & (size > 1)).cast("int")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """The windows of ``size`` consecutive words of each item, or all its words where it has fewer: item_id, window, words."""
    held = items.filter("item_id is not null").select("item_id", F.filter(_split("text"), lambda w: w != "").alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    each = held.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), F.lit(size)).alias("words"))
    return each.select("item_id", F.array_join("words", " ").alias("window"), "words").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is a set of one-word shingles, of which a document must hold all. So one necessary
    prefix token is enough: its rarest word, by the count of the words in all documents. Where
    a document has that word, the window can only start at one place (positional bound), which must leave
    room for it on both sides (length bound); there its words are compared. A word is hit once, however many
    windows cover it.

    A null or empty text has no words and no hits. Items without words or without item_id have no windows. Items
    may share windows and ids. Repeated rows keep a row each, also with equal or null doc_id. With no
    items or no documents nothing is hit. Further columns are ignored.
    """
    return _contamination(docs, items, size).drop("row")


def _contamination(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """What contamination gives, with the key of each row."""
    wins = cut(windows(items, size))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))
    split = texts.select("doc_id", "row", _split("text").alias("all"))

    vocabulary = wins.select(F.explode("words").alias("word")).distinct()
    counts = split.select(F.explode("all").alias("word")).join(_small(vocabulary), "word").groupBy("word").count()
    tokens = wins.select("window", "words").distinct().select("window", "words", F.posexplode("words").alias("offset", "word"))
    rarest = tokens.join(counts, "word").groupBy("window").agg(F.min(F.struct("count", "word", "offset")).alias("token"), F.count("*").alias("length"), F.first(F.size("words")).alias("needed"))
    # a window of which a word is in no document can't occur
    prefix = cut(rarest.filter("length = needed").select("window", F.col("needed").alias("length"), F.col("token.word").alias("word"), F.col("token.offset").alias("offset")))

    if prefix.count() <= BROADCAST_ROWS:  # a space, which is no word, is put at each document's end and gives its number of words
        last = docs.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("length"), F.lit(" ").alias("word"), F.lit(0).alias("offset"))
        ended = split.select("doc_id", "row", F.concat("all", F.array(F.lit(" "))).alias("all"), _number("all").alias("n"))
        at = ended.select("doc_id", "row", "all", "n", F.posexplode("all").alias("pos", "word")).join(F.broadcast(prefix.unionByName(last)), "word")
        start = F.col("pos") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") < F.size("all"))
        same = F.array_join(F.slice("all", F.when(fits, start).otherwise(0) + 1, F.col("length")), " ") == F.col("window")
        met = cut(at.filter((F.col("word") == " ") | (fits & same)).select("doc_id", "row", F.when(F.col("word") == " ", F.col("n")).otherwise(start).alias("start"), "length", "window").distinct())
        hits, numbers = met.filter("window <> ''"), met.filter("window = ''").select("doc_id", "row", F.col("start").alias("n_words"))
    else:  # carry the words around each position, not the document
        at = split.select("doc_id", "row", "all", F.posexplode("all").alias("pos", "word"))
        low = F.greatest(F.col("pos") - size + 1, F.lit(0))
        at = at.select("doc_id", "row", "pos", "word", low.alias("low"), F.size("all").alias("n"), F.slice("all", low + 1, F.lit(2 * size - 1)).alias("near")).join(prefix, "word")
        start = F.col("pos") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
        same = F.array_join(F.slice("near", F.when(fits, start - F.col("low")).otherwise(0) + 1, F.col("length")), " ") == F.col("window")
        hits = cut(at.filter(fits & same).select("doc_id", "row", start.alias("start"), "length", "window").distinct())
        numbers = split.select("doc_id", "row", _number("all").alias("n_words")).distinct()

    before = Window.partitionBy("doc_id", "row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "row", "start", (F.col("start") + F.col("length")).alias("stop"), "length").distinct()
    fresh = spans.withColumn("covered", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = fresh.groupBy("doc_id", "row").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "covered"), F.lit(0))).cast("long").alias("n_hit"))
    found = hits.select("doc_id", "row", "window").join(wins.select("window", F.col("item_id").cast("string").alias("item_id")), "window").select("doc_id", "row", "item_id").distinct()
    named = found.groupBy("doc_id", "row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))

    numbers = numbers.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "n_words")
    for more in (hit, named):
        found = more.select(F.col("doc_id").alias("_id"), F.col("row").alias("_of"), *more.columns[2:])
        numbers = numbers.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")), "left").drop("_id", "_of")
    out = texts.select("doc_id", "row").join(numbers, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("of")))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with the columns of ``docs``."""
    return without_rows(docs, _contamination(docs, items, size).filter("contaminated").select("doc_id", F.col("row").alias("key")))
