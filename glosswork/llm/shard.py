"""Sharding by extendible hashing: a directory of hash prefixes of which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Directories of no more rows than this are broadcast (some 20 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the address of a row, bits that a round looks at beyond the expected depth, ordinals made at a time.
BITS, MORE, RUN = 120, 6, 100_000


def _address(text: Column) -> Column:
    """120 bits of the MD5 digest as a string of 0 and 1."""
    hexed = F.md5(text)
    return F.concat(*(F.lpad(F.bin(F.conv(F.substring(hexed, start, 15), 16, 10).cast("long")), 60, "0") for start in (1, 16)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key() -> Column:
    return _address(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def assign(docs: DataFrame, limit: int, rows_too: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, shard, depth, shard_bytes, shard_rows; with ``rows_too`` also row, a hash of doc_id and text.

    bytes are those of the text in UTF-8. The shard is a prefix of the row's address, the MD5 of doc_id and text. The
    directory starts as one bucket (the empty prefix); a bucket of more than ``limit`` bytes splits on the next bit.
    A row that alone exceeds the limit ends in a bucket of its own, the only kind above the limit.

    Repeated rows would share an address and never part: equal rows are counted, and all but
    one of them get the address of an ordinal, so a key with any share of the rows splits like others.
    Null doc_id and null text count as the strings "null" and "". An empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("bytes"), _key().alias("key"))
    counted = slim.groupBy("key", "doc_id", "bytes").agg(F.count("*").alias("copies"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {RUN}"))))
    each = runs.withColumn("ordinal", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1)))
    rows = cut(each.select("doc_id", "bytes", F.when(F.col("ordinal") == 0, F.col("key")).otherwise(_address(F.concat("key", F.lit("#"), F.col("ordinal").cast("string")))).alias("key"), *([F.xxhash64("key").alias("row")] if rows_too else [])))

    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + MORE)
    placed, open_rows = None, rows
    while True:
        leaves = cut(open_rows.groupBy(F.substring("key", 1, high).alias("leaf")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")))
        levels = leaves.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("shard", F.expr("substring(leaf, 1, depth)"))
        fits = F.col("shard_bytes") <= limit
        buckets = levels.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")).filter(fits | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
        directory = cut(levels.join(buckets, ["depth", "shard"]).groupBy("leaf").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("bucket")))
        here = open_rows.withColumn("leaf", F.substring("key", 1, high))
        found = here.join(_small(directory), "leaf").select("doc_id", "bytes", "bucket.shard", "bucket.depth", "bucket.shard_bytes", "bucket.shard_rows", *(["row"] if rows_too else []))
        placed = found if placed is None else placed.unionByName(found)
        oversized = leaves.join(directory, "leaf", "left_anti").select("leaf")
        if high == BITS or oversized.isEmpty():
            return placed
        open_rows = cut(here.join(_small(oversized), "leaf").drop("leaf"))
        low, high = high + 1, min(BITS, high + 2 * MORE)


def share(docs: DataFrame, parts: int) -> int:
    """The limit of bytes of which ``docs`` holds ``parts``: the texts' bytes over parts, rounded up, one at least."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long"))).first()[0] or 0
    return max(1, -(-total // parts))


def write_shards(docs: DataFrame, limit: int, path: str, column: str = "shard") -> None:
    """Write ``docs`` as Parquet, one folder for each shard, named by ``column``, which ``docs`` may not have.

    Equal rows each have a shard of their own; of rows that share doc_id and text but differ in other columns, every one is written.
    """
    if column in docs.columns:
        raise ValueError(f"{column}: a column of the documents; name another one")
    placed = assign(docs, limit, True).select("row", F.concat(F.lit("s"), "shard").alias(column))
    nth = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = docs.withColumn("__row", F.xxhash64(_key()))
    repeated = cut(placed.groupBy("row").count().filter("count > 1").select(F.col("row").alias("__row")))
    single = keyed.join(placed.withColumnRenamed("row", "__row"), "__row") if repeated.isEmpty() else keyed.join(repeated, "__row", "left_anti").join(placed.withColumnRenamed("row", "__row"), "__row")
    out = single.drop("__row")
    if not repeated.isEmpty():  # number both sides and pair the numbers
        rows = keyed.join(repeated, "__row", "left_semi").withColumn("__nth", nth("__row", "__row"))
        places = placed.withColumnRenamed("row", "__row").join(repeated, "__row", "left_semi").withColumn("__nth", nth("__row", column))
        out = out.unionByName(rows.join(places, ["__row", "__nth"]).drop("__row", "__nth"))
    out.repartition(column).write.partitionBy(column).mode("overwrite").parquet(path)
