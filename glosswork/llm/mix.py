"""Mixing sources to target weights by subset-sum fitting over exact token lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_key

#: Tables of no more rows than this are broadcast (some 10 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: What the dynamic programme fits exactly; a budget above it is first filled by shares of each length.
EXACT = 20_000
#: Documents of one source and length that are ranked in one window.
RANKED = 4_096


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, so that they add up to ``budget`` or closely below.

    A budget of EXACT or less is fitted by a bounded-knapsack programme over all lengths and counts, so that no
    other choice comes nearer from below. Of a larger one, every length first gives the same share of its documents, up to half of EXACT below
    the budget; single documents in the order of their lost fraction, then the longest that still fit, bring the rest below EXACT; the
    programme fits that rest over the lengths that are left.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    if budget <= 0:
        return take
    share = counts * (max(0, budget - EXACT // 2) / total if budget > EXACT else 0.0)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-(share - take), kind="stable"):
        if rest <= EXACT:
            break
        if lengths[i] <= rest and take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= EXACT:
            break
        more = min(int(counts[i] - take[i]), rest // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    while rest < 0:  # a share that floating point has rounded up
        i = int(np.flatnonzero(take > 0)[0])
        take[i] -= 1
        rest += int(lengths[i])
    rest = min(rest, int((lengths * (counts - take)).sum()))
    usable = [i for i in np.argsort(lengths, kind="stable") if lengths[i] <= rest and take[i] < counts[i]]
    reached, mask = 1, (1 << (rest + 1)) - 1
    came: dict[int, tuple[int, int]] = {}  # a sum: the length and the number of it by which it was first reached
    for i in usable:
        left, piece = min(int(counts[i] - take[i]), rest // int(lengths[i])), 1
        while left > 0 and not reached >> rest & 1:
            piece = min(piece, left)
            step = piece * int(lengths[i])
            fresh = (reached << step) & mask & ~reached
            reached |= fresh
            while fresh:
                low = fresh & -fresh
                came[low.bit_length() - 1] = (i, piece)
                fresh ^= low
            left -= piece
            piece *= 2
    at = reached.bit_length() - 1
    while at:
        i, piece = came[at]
        take[i] += piece
        at -= piece * int(lengths[i])
    return take


def _fit_source(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hist = pa.Table.from_batches(list(rows))
    order = np.argsort(hist["size"].to_numpy(), kind="stable")
    sizes, counts = hist["size"].to_numpy()[order], hist["n"].to_numpy()[order]
    base, budget = int(hist["base"][0].as_py()), int(hist["budget"][0].as_py())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), key[0].as_py())), pa.array(sizes), pa.array(counts), pa.array(np.full(len(sizes), base)), pa.array(fit(sizes, counts, budget))], ["sid", "size", "n", "base", "extra"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: float = 3.0) -> DataFrame:
    """From rows (source, size), per source: sid (rank by code point, null last), source, source_size, target.

    The weights repeat over the ranks and share all sizes. Where a share is above ``repeats`` times the source's size
    it stops there, and the excess is shared anew among the others; that ends with one level at which every
    target is min(repeats * source_size, level * weight). The level is found by a few sums over the sources.
    """
    spark = sizes.sparkSession
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").isNull(), "source"))
    ranked = totals.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1]))
    ranked = spark.createDataFrame(ranked, "sid long, source string, source_size long")
    ranked = cut(ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * float(repeats)
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weight if weight else 0.0
    while True:
        full = cap <= F.col("weight") * level
        held, open_weight = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        higher = (total - held) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    return ranked.select("sid", "source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, seed: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, row.

    size is the number of words of the whole text. Each source is taken as often as it wholly fits its target, at
    most ``repeats`` times, and the rest of the target is filled with some of its documents once more: how many of
    each exact length comes from ``fit`` over the source's length counts; which ones, from the order of a seeded
    hash. copies is how often a document is taken, taken the words this makes; row is a key of (doc_id, source, text).

    Length counts are summed before a source goes to one task, so that task holds one row per distinct length. Groups
    of equal source and length are ranked within parts of some RANKED rows of them. Null and empty texts have
    size 0 and are never taken more than whole passes ask. A null source is a source, ranked last. Equal
    rows may be taken a different number of times; which of them it is makes no difference. Reruns agree.
    """
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), row_key("doc_id", "source", "text").alias("row"))
    slim = cut(slim)
    targets = source_targets(slim, weights, repeats)
    base = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))
    targets = targets.withColumn("base", F.when(F.col("source_size") > 0, base).otherwise(0).cast("long"))
    targets = cut(targets.withColumn("budget", F.when(F.col("base") < repeats, F.round(F.col("target") - F.col("base") * F.col("source_size"))).otherwise(0).cast("long")))
    few = targets.count() <= BROADCAST_ROWS
    side = F.broadcast(targets) if few else targets
    rows = slim.join(side, slim.source.eqNullSafe(side.source)).drop(side.source)

    hist = rows.filter("size > 0").groupBy("sid", "size", "base", "budget").agg(F.count("*").alias("n"))
    fitted = cut(hist.groupBy("sid").applyInArrow(_fit_source, "sid long, size long, n long, base long, extra long"))
    parts = F.expr(f"case when n <= {RANKED} then 1 else cast(ceil(n / {RANKED // 2}) as bigint) end")
    order = F.xxhash64(F.lit(seed), "row")
    ranked = rows.drop("base", "budget").join(_small(fitted.filter("extra > 0 and extra < n").select("sid", "size", "extra", parts.alias("parts"))), ["sid", "size"])
    ranked = ranked.withColumn("order", order).withColumn("part", F.expr("pmod(order, parts)"))
    upto = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("sid", "size", "extra", "part").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    counts = counts.select("sid", "size", "part", "before")
    place = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("order", "row")) + F.col("before")
    chosen = ranked.join(counts, ["sid", "size", "part"]).withColumn("more", (place <= F.col("extra")).cast("long"))
    keep = ["doc_id", "source", "size", "source_size", "target", "row"]
    whole = rows.join(_small(fitted.filter("extra = 0 or extra = n").select("sid", "size", F.when(F.col("extra") > 0, 1).otherwise(0).cast("long").alias("more"))), ["sid", "size"])
    none = rows.filter("size = 0").withColumn("more", F.lit(0).cast("long"))
    sized = chosen.join(side.select("sid", "base"), "sid").select(*keep, "base", "more").unionByName(whole.select(*keep, "base", "more")).unionByName(none.select(*keep, "base", "more"))
    copies = F.col("base") + F.col("more")
    return sized.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, seed: int = 20) -> DataFrame:
    """``docs`` with every row as often as the mixture takes it. Rows without words, null texts among them, stay as they are, once.

    Rows that agree in doc_id, source and text but not in other columns share what the mixture takes of them evenly; of what is left over, those
    first in the order of a hash of all columns get one more each. Reruns agree. An empty table stays empty.
    """
    plan = mixture(docs, weights, repeats, seed).filter("size > 0").groupBy("doc_id", "row").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    plan = cut(plan.filter("__copies > 0").select(F.col("doc_id").alias("__id"), F.col("row").alias("__key"), "__copies", "__rows"))
    keyed = docs.withColumn("__row", row_key("doc_id", "source", "text"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    words = F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(WORD)), F.lit(False))
    alone = F.when(~words, F.lit(1).cast("long")).when(F.col("__rows") == 1, F.col("__copies"))
    taken = keyed.join(_small(plan), same, "left").withColumn("__times", alone).filter("__times > 0")
    out = taken.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(docs.columns)
    several = plan.filter("__rows > 1")
    return out if several.isEmpty() else out.unionByName(_shared(keyed.join(_small(several), same), docs.columns))


def _shared(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of keys that several rows have, as often as their shares of the keys' copies say.

    Equal rows are counted first. What differs within a key is numbered in parts of some RANKED, and copies of one row are made in runs of that many.
    """
    keyed = rows.withColumn("__of", F.concat_ws(" ", F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.col("__key").cast("string")))
    kinds = keyed.groupBy(*columns, "__of", "__copies", "__rows").agg(F.count("*").alias("__n"))
    kinds = cut(kinds.withColumn("__order", F.xxhash64(F.to_json(F.struct(*columns)))))
    slim = kinds.select("__of", "__n", "__order", "__copies", "__rows")
    parts = slim.groupBy("__of").agg(F.ceil(F.count("*") / RANKED).alias("__parts"))
    slim = slim.join(parts, "__of").withColumn("__part", F.expr("pmod(__order, __parts)"))
    upto = Window.partitionBy("__of").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = slim.groupBy("__of", "__part").agg(F.sum("__n").alias("m")).select("__of", "__part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("__skipped"))
    inside = Window.partitionBy("__of", "__part").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("__upto", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(before, ["__of", "__part"])
    more = "greatest(0L, least(__n, __copies - (__copies div __rows) * __rows - __skipped - __upto))"
    shares = slim.select("__of", "__order", F.expr(f"(__copies div __rows) * __n + {more}").alias("__times")).filter("__times > 0")
    runs = kinds.join(shares, ["__of", "__order"]).withColumn("__run", F.explode(F.expr(f"sequence(0L, (__times - 1) div {RANKED})"))).repartition("__of", "__run")
    return runs.withColumn("__nth", F.explode(F.expr(f"sequence(1L, least({RANKED}L, __times - __run * {RANKED}))"))).select(columns)
