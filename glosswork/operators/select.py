"""Joins and windows that choose: candidates, attempts, overlays, memos, dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .ordered import at_or_after, beside  # noqa: F401  the as-of join is one of this module's choices too

#: Tables of no more rows than this are broadcast (some 20 MB).
BROADCAST_ROWS = 200_000
#: Signatures that one nested loop compares with all rows.
SCANNED = 10_000


def first_by(df: DataFrame, keys: Sequence[str], *order: Column, most: int = 1) -> DataFrame:
    """The first rows of each key by the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def best_candidate(scored: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The candidate of highest score of each key, the earlier one of equals."""
    return first_by(scored, keys, F.desc(score), F.col(order))


def accept_early(scored: DataFrame, keys: Sequence[str], clean: Column, score: str, order: str) -> DataFrame:
    """The first candidate of each key if it is ``clean``, else the one of highest score, the earlier one of equals."""
    first = scored.groupBy(*keys).agg(F.min(order).alias("_first"))
    at_once = (F.col(order) == F.col("_first")) & clean
    return first_by(scored.join(first, list(keys)), keys, at_once.desc(), F.desc(score), F.col(order)).drop("_first")


def repair_taken(own: Column, model: Column, built: Column) -> Column:
    """Which text stays, by score: the model's repair if it is as good as the own one, a built one if it is better than that."""
    return F.when(built > F.greatest(own, model), "deterministic").when(model >= own, "model").otherwise("original")


def first_success(tasks: DataFrame, attempts: DataFrame, keys: Sequence[str], default: Column, value: str) -> DataFrame:
    """Every task with the value of its first good attempt by (provider_rank, model_rank), else the default."""
    best = attempts.filter("ok").groupBy(*keys).agg(F.min_by(F.struct("provider", F.col(value).alias("value")), F.struct("provider_rank", "model_rank")).alias("best"))
    return tasks.join(best, list(keys), "left").select(*tasks.columns, F.coalesce("best.provider", F.lit("fallback")).alias("provider"), F.coalesce("best.value", default).alias(value))


def last_by(df: DataFrame, keys: Sequence[str], *arrival: str) -> DataFrame:
    """The last record of each key; aggregated on the map side, so a hot key needs no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def overlay(seed: DataFrame, done: DataFrame, keys: Sequence[str], arrival: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Seed rows with the columns of their last done row, or the defaults."""
    latest = last_by(done, keys, *arrival)
    joined = seed.join(latest, list(keys), "left")
    return joined.select(*seed.columns, *(F.coalesce(F.col(c), d).alias(c) for c, d in columns.items()))


def memo(df: DataFrame, key: Column, compute, needs: Sequence[str] | None = None) -> DataFrame:
    """``compute`` runs once for each distinct key, its columns are joined back to all rows of the key. It gets memo_key and ``needs``, or all columns."""
    keyed = df.withColumn("memo_key", key)
    once = keyed if needs is None else keyed.select("memo_key", *needs)
    return keyed.join(compute(once.dropDuplicates(["memo_key"])), "memo_key")


def transcript(turns: DataFrame, key: str, order: str, text: str, cap: int = 1200) -> DataFrame:
    """Per key the first ``cap`` characters of its texts, in order, parted by spaces and without spaces at the ends: key, value.

    Every text adds a character at least, so from the first that isn't blank on no more than ``cap`` + 1 of them are kept by any task.
    A key with blank texts only has ''; null texts don't count.
    """
    said = turns.filter(F.col(text).isNotNull()).select(key, F.struct(order, text).alias("_said"))
    first = said.groupBy(key).agg(F.min(F.when(F.trim(F.col(f"_said.{text}")) != "", F.col("_said"))).alias("_first"))
    spoken = beside(said, first, [key]).filter("_said >= _first").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_said"))).filter(F.col("_n") <= cap + 1)
    joined = spoken.groupBy(key).agg(F.array_sort(F.collect_list("_said")).alias("_all")).select(key, F.left(F.trim(F.array_join(F.transform("_all", lambda x: x[text]), " ")), F.lit(cap)).alias("_value"))
    return beside(first.select(key), joined, [key]).select(key, F.coalesce("_value", F.lit("")).alias("value"))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def terms_within(captions: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """Rows (task_id, term) of terms that a task's captions contain; ``terms`` is equi-joined on task first."""
    return captions.join(terms, "task_id").filter(F.contains(F.lower(text), F.col("term")))


def _between(text: str) -> Column:
    """The distinct words that stand between two spaces of a text."""
    parts = F.split(text, " ")
    return F.array_distinct(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""))


def signature_hits(df: DataFrame, signatures: DataFrame, text: str) -> DataFrame:
    """Rows whose text contains one of any number of signatures.

    A word between two spaces of a signature must be a whole word of the text. So each signature is joined by the
    rarest of its words and then verified. Signatures without such a word are compared with all rows, SCANNED at a time.
    """
    known = signatures.select(F.lower("signature").alias("_s")).filter("_s is not null").distinct().withColumn("_ws", _between("_s"))
    low = df.select(F.lower(text).alias("_t")).filter("_t is not null")
    long, short = known.filter(F.size("_ws") > 0), known.filter(F.size("_ws") == 0).select("_s")
    small = long.count() <= BROADCAST_ROWS
    side = F.broadcast if small else lambda x: x
    tokens = long.select("_s", F.explode("_ws").alias("_w"))
    words = F.explode(F.array_distinct(F.split("_t", " "))).alias("_w")
    counts = low.select(words).join(side(tokens.select("_w").distinct()), "_w").groupBy("_w").count()
    rarest = side(tokens.join(counts, "_w").groupBy("_s").agg(F.min_by("_w", F.struct("count", "_w")).alias("_w")))
    if small:
        met = low.select("_t", words).join(rarest, "_w")
    else:  # carry a digest beside the words, not the text
        keyed = low.withColumn("_k", F.sha2("_t", 256))
        met = keyed.select("_k", words).join(rarest, "_w").select("_k", "_s").distinct().join(keyed, "_k")
    hits = met.filter(F.contains("_t", F.col("_s"))).select(F.sha2("_t", 256).alias("_k")).distinct()
    parts = -(-short.count() // SCANNED)
    for i in range(parts):
        part = F.broadcast(short.filter(F.pmod(F.xxhash64("_s"), F.lit(parts)) == i))  # some SCANNED signatures
        hits = hits.unionByName(low.join(part, F.contains("_t", F.col("_s")), "left_semi").select(F.sha2("_t", 256).alias("_k")))
    return df.join(hits.distinct(), F.sha2(F.lower(text), 256) == F.col("_k"), "left_semi")


def guarded(chosen: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A chosen text stays if it equals a candidate of the same keys but for outer spaces, else the first set's text is taken."""
    known = candidates.select(*keys, F.trim("text").alias("_t")).distinct().withColumn("_known", F.lit(True))
    first = candidates.groupBy(*keys).agg(F.min_by("text", "set_no").alias("_first"))
    joined = chosen.withColumn("_t", F.trim("text")).join(known, [*keys, "_t"], "left").join(first, list(keys), "left")
    return joined.select(*keys, F.when(F.col("_known"), F.col("text")).otherwise(F.col("_first")).alias("text"), F.coalesce("_known", F.lit(False)).alias("accepted"))


def selected_sets(sets: DataFrame, tries: DataFrame, task: str, styles: Sequence[str] = rules.STYLES) -> DataFrame:
    """The captions of each task after a selection among its candidate sets: task, style, text, chosen.

    ``sets(task, set_no, captions)`` map styles to texts; null and empty maps are of writers that failed. ``tries(task, attempt, picked)`` are the selector's
    replies, null where it failed; the first that is there counts. Its text for a style stays (``chosen``) if, but for outer spaces, a set of the task has it for that
    style. All else, and all of a task that has one set only or no reply, comes from the task's first set, '' where that lacks the style. A task
    without sets gives no rows. Texts are met by digest, so the sets of a task are never gathered in one place.
    """
    made = sets.filter(F.size("captions") > 0)
    first = made.groupBy(task).agg(F.min_by("captions", "set_no").alias("_first"), F.count("*").alias("_sets"))
    replies = tries.filter("picked is not null").groupBy(task).agg(F.min_by("picked", "attempt").alias("_picked"))
    of = lambda captions: F.coalesce(F.try_element_at(captions, F.col("style")), F.lit(""))
    wanted = first.join(replies, task, "left").select("*", F.explode(F.array(*map(F.lit, styles))).alias("style"))
    wanted = wanted.withColumn("_choice", F.when(F.col("_sets") > 1, of("_picked"))).select(task, "style", of("_first").alias("_first"), "_choice", F.sha2(F.trim("_choice"), 256).alias("_digest"))
    known = made.select(task, F.explode("captions").alias("style", "_text")).select(task, "style", F.sha2(F.trim("_text"), 256).alias("_digest")).distinct()
    joined = wanted.join(known.withColumn("_known", F.lit(True)), [task, "style", "_digest"], "left")
    chosen = F.coalesce(F.col("_known") & (F.col("_choice") != ""), F.lit(False))
    return joined.select(task, "style", F.when(chosen, F.col("_choice")).otherwise(F.col("_first")).alias("text"), chosen.alias("chosen"))


def siblings(captions: DataFrame, key: str, order: str, label: str, text: str) -> DataFrame:
    """Each row with the "- label: text" lines of all rows of its key that aren't blank."""
    line = F.when(F.trim(text) != "", F.concat(F.lit("- "), F.col(label), F.lit(": "), F.col(text)))
    blocks = captions.filter(line.isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x.line), "\n").alias("context"))
    return captions.join(blocks, key, "left")


def consensus(details: DataFrame, specific: Column, least: int = 2) -> DataFrame:
    """Details of a task with the number of distinct models; trusted from ``least`` on, else kept only if generic."""
    one = details.groupBy("task_id", "detail").agg(F.count_distinct("model").alias("models"))
    status = F.when(F.col("models") >= least, "trusted").when(specific, "dropped").otherwise("kept")
    return one.withColumn("status", status)
