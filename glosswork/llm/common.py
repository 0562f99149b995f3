"""Small helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import spread

#: A word is a run of anything but ASCII white space (java.util.regex).
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII letters, digits and anything outside ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label tables of no more rows than this are broadcast (some 10 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Texts are hashed in pieces of about so many bytes, which bounds the memory of a task.
PIECE_BYTES = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is several times faster, and right where no other letters are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def row_key(*columns: str) -> Column:
    """A 64-bit hash of the columns; rows that are equal in them share it, nulls included."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns))


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only local sessions may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again."""
    checkpoint_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def without_rows(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id, null or not, and row_key(doc_id, text) aren't in ``gone(doc_id, key)``, which is broadcast while it is small (some 20 MB)."""
    gone = cut(gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone")).distinct())
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone"))
    return keyed.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, same, "left_anti").select(docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``(node, component)`` a node, component its smallest node.

    Rounds of smallest neighbouring label and pointer jumping, all of them joins; only the count of
    changed labels comes to the driver. Hot nodes meet in partial aggregates and splittable joins. Labels are written as
    tables: a checkpoint keeps the constraints that the optimizer has found, and these multiply from round to round.
    Both directions of an edge come from one evaluation of ``edges``, as another one may name other edges or turn them round.
    """
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("way")
    both = stored(edges.filter("u <> v").select(ways).select("way.u", "way.v").distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    small = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda x: x
    while True:
        near = both.join(small(labels.withColumnRenamed("node", "v")), "v").select(F.col("u").alias("node"), "component", F.lit(None).cast("long").alias("own"))
        lower = near.unionByName(labels.withColumn("own", F.col("component"))).groupBy("node").agg(F.min("component").alias("mid"), F.max("own").alias("old"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("above"))
        step = stored(lower.join(small(up), "mid", "left").select("node", "old", F.least("mid", F.coalesce("above", "mid")).alias("component")))
        labels = step.select("node", "component")
        if step.filter("component <> old").isEmpty():
            return labels


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words of lower-cased bytes."""
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(b)))
    at = np.arange(starts[0], len(b)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    values = _BYTE[b[starts[0] :]] * powers[at]
    values[space[starts[0] :]] = 0
    return mix64(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lowered), and the index of the text each stands in."""
    hashes, owners = [], []
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = b" ".join(texts).lower()
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        h, starts = _hash_piece(data[at:end])
        hashes.append(h)
        owners.append(np.searchsorted(ends, starts + at, "right"))
        at = end
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the texts' word shingles, sorted by text and hash, and the index of each one's text.

    A text of fewer words than ``width``, but not none, has its whole sequence as one shingle.
    """
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    factors = mix64(np.arange(101, 101 + width, dtype=np.uint64)) | np.uint64(1)
    whole = max(0, len(words) - width + 1)
    rolled = np.zeros(whole, np.uint64)
    for j in range(width):
        rolled += words[j : j + whole] * factors[j]
    inside = owner[:whole] == owner[width - 1 : width - 1 + whole] if whole else np.empty(0, bool)
    sets, of = [mix64(rolled[inside])], [owner[:whole][inside]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            h = np.full(len(short), k * 0x1F3B5, np.uint64)
            for j in range(k):
                h += words[begin[short] + j] * factors[j]
            sets.append(mix64(h))
            of.append(short)
    h, o = np.concatenate(sets), np.concatenate(of)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of the column's texts of about ``most`` bytes, each with the index of its first row; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        if held and size + len(data) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in rows if b.num_rows)
