"""Substring dedup by hashing lines, paragraphs and the clauses of lines, over the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches, row_key

#: Part of a line up to a mark that white space follows, or up to the end of the line.
_CLAUSE = re.compile(r"(?=\S)[^\n,;:.!?]*(?:[,;:.!?](?!\s)[^\n,;:.!?]*)*[,;:.!?]?")

#: d1 and d2 are 96 bits of a digest: two of 2 billion unlike units share them with a chance of some 1e-11.
#: span holds the first offset and the one after the last, place the words before the unit and twice its own, plus one for a whole line: 32 bits each.
_UNITS = "doc_id long, key long, span long, place long, d1 long, d2 int"


def runs(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """First and last index of the clauses of ``least`` words, and from each shorter one the least neighbours after it, and before it, that make so many.

    Any stretch of neighbours that has ``least`` words is covered by those that lie in it, wherever it starts and ends.
    """
    out = set()
    for i, n in enumerate(sizes):
        total, j = n, i
        while total < least and j + 1 < len(sizes):
            j += 1
            total += sizes[j]
        if total >= least:
            out.add((i, j))
        total, j = n, i
        while total < least and j:
            j -= 1
            total += sizes[j]
        if total >= least:
            out.add((j, i))
    return sorted(out)


def wholes(text: str, firsts: list[int], lasts: list[int], places: list[int], least: int) -> list[tuple[int, int]]:
    """First and last index of the clauses of each line of ``least`` words or more, and of each paragraph that has shorter lines as well."""
    out, lines, paragraphs = [], [], []
    for i, first in enumerate(firsts):
        gap = text[lasts[i - 1] : first].count("\n") if i else 2
        if gap:
            lines.append([i, i])
        else:
            lines[-1][1] = i
        if gap > 1:
            paragraphs.append([])
        if gap:
            paragraphs[-1].append(lines[-1])
    long = lambda i, j: places[j + 1] - places[i] >= least
    for own in paragraphs:
        kept = [(i, j) for i, j in own if long(i, j)]
        out += kept
        if len(kept) < len(own) and len(own) > 1 and long(own[0][0], own[-1][1]):
            out.append((own[0][0], own[-1][1]))
    return out


def _units(least: int, line: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "span", "place", "d1", "d2"]

        def made(ids, keys, begins, stops, ats, words, digests):
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            span, place = (pa.array(np.array(high, np.int64) << 32 | np.array(low, np.int64)) for high, low in ((begins, stops), (ats, words)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), span, place, pa.array(d[:, 0]), pa.array(d[:, 1].astype(np.int32))], names)

        ids, keys, begins, stops, ats, words, digests = [], [], [], [], [], [], []
        for b in batches(rows):
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                firsts, lasts, units, places = [], [], [], [0]
                for m in _CLAUSE.finditer(text.as_py() or ""):
                    split = m.group().lower().split()
                    firsts.append(m.start())
                    lasts.append(m.start() + len(m.group().rstrip()))
                    units.append(" ".join(split))
                    places.append(places[-1] + len(split))
                whole = set(wholes(text.as_py() or "", firsts, lasts, places, line))
                for i, j in sorted({*runs([q - p for p, q in pairwise(places)], least), *whole}):
                    unit = units[i] if i == j else " ".join(units[i : j + 1])
                    ids.append(doc_id)
                    keys.append(key)
                    begins.append(firsts[i])
                    stops.append(lasts[j])
                    ats.append(places[i])
                    words.append((places[j + 1] - places[i]) * 2 + ((i, j) in whole))
                    digests.append(xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass")))
                    if len(ids) > 20_000:
                        yield made(ids, keys, begins, stops, ats, words, digests)
                        ids, keys, begins, stops, ats, words, digests = [], [], [], [], [], [], []
        if ids:
            yield made(ids, keys, begins, stops, ats, words, digests)

    return run


def repeated_units(docs: DataFrame, least: int = 6, shortest: int = 30, line: int = 10) -> DataFrame:
    """The spans to remove: doc_id, begin, stop, words, kept_doc_id, kept_begin.

    Units are whole lines of ``line`` words or more, and paragraphs (lines without an empty one between them) of so many words that have shorter
    lines. Lines are also cut into clauses at .,;:!? before white space: clauses of ``least`` words, and the least
    runs of neighbouring clauses, also across lines, in which each shorter one has so many, are units too, as shared passages start and end
    within lines. Equal units (lower-cased, with
    single spaces) are one group. The occurrence of smallest (doc_id, begin) stays. Other lines and paragraphs go; other clauses go where they follow each
    other without a gap over ``shortest`` words or more, so that a stock phrase stays where it is. Units that follow
    or overlap each other in the same way where they are kept are named as one span. begin and stop are offsets in code
    points of the original text. Units inside other units are not named on their own.

    Null and empty texts have no units. A null doc_id ranks after all others and is named as null. A document is a doc_id
    and a text: rows that share both are one, rows that share only the id are several, ranked by a
    hash of the text. Further columns are ignored, whatever their names.
    """
    return _spans(docs, least, shortest, line).drop("key")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key: 0 where no other text has the doc_id, else, and without a doc_id, a hash of both. Zeros cost nothing in a shuffle."""
    rows = docs.withColumn("__hash", row_key("doc_id", "text"))
    shared = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("__hash").alias("low"), F.max("__hash").alias("high")).filter("low <> high").select("__id")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    key = F.when(F.col("doc_id").isNull() | F.col("__id").isNotNull(), F.col("__hash")).otherwise(F.lit(0).cast("long"))
    return rows.join(shared, F.col("doc_id") == F.col("__id"), "left").select(*docs.columns, key.alias("__key"))


def _spans(docs: DataFrame, least: int, shortest: int, line: int) -> DataFrame:
    """What repeated_units gives, with the key of each row."""
    slim = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = slim.withColumnRenamed("__key", "key")
    units = texts.mapInArrow(_units(least, line), _UNITS)
    high, low = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", F.shiftleft(F.shiftright("span", 32), 32).bitwiseOR(F.shiftright("place", 32)).alias("first"))
    groups = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).filter("n > 1").drop("n")
    kept_begin, kept_at = high("kept.first"), low("kept.first")
    again = units.join(groups, ["d1", "d2"]).filter(~((F.col("key") == F.col("kept.key")) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (high("span") == kept_begin)))
    end, whole = high("place") + F.shiftright(low("place"), 1), low("place") % 2 == 1
    gone = again.select("doc_id", "key", high("span").alias("begin"), low("span").alias("stop"), high("place").alias("at"), end.alias("end"), whole.alias("whole"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.key").alias("kept_key"), kept_begin.alias("kept_begin"), (kept_at - high("place")).alias("shift"))
    row = Window.partitionBy("doc_id", "key")
    order = row.orderBy("begin", F.desc("stop"), "kept_doc_id", "kept_key", "kept_begin", "at")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    # units inside others don't count for a stretch; this drops repeated rows, too
    outside = lambda df: df.withColumn("reach", F.max("stop").over(before)).withColumn("outer", F.col("reach").isNull() | (F.col("stop") > F.col("reach")))
    follows = F.col("at") <= F.last(F.when(F.col("outer"), F.col("end")), True).over(before)
    stretch = outside(gone).filter("outer or whole").withColumn("stretch", F.count_if(F.col("outer") & ~F.coalesce(follows, F.lit(False))).over(upto))
    same = Window.partitionBy("doc_id", "key", "stretch")
    total = F.max(F.when(F.col("outer"), F.col("end"))).over(same) - F.min(F.when(F.col("outer"), F.col("at"))).over(same)
    long = outside(stretch.withColumn("total", total).filter((F.col("outer") & (F.col("total") >= shortest)) | F.col("whole"))).filter("outer")
    follows = F.col("at") <= F.lag("end").over(order)
    goes_on = follows & (F.col("shift") == F.lag("shift").over(order)) & F.col("kept_doc_id").eqNullSafe(F.lag("kept_doc_id").over(order)) & (F.col("kept_key") == F.lag("kept_key").over(order))
    spans = long.withColumn("span", F.count_if(~F.coalesce(goes_on, F.lit(False))).over(upto))
    merged = spans.groupBy("doc_id", "key", "span").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), (F.max("end") - F.min("at")).alias("words"), F.min("kept_doc_id").alias("kept_doc_id"), F.min("kept_begin").alias("kept_begin"))
    return merged.select("doc_id", "key", "begin", "stop", "words", "kept_doc_id", "kept_begin")


def _without(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
            if text is not None and spans:
                parts, at = [], 0
                for begin, stop in sorted((s["begin"], s["stop"]) for s in spans):
                    parts.append(text[at : max(at, begin)])
                    at = max(at, stop)
                text = "".join(parts) + text[at:]
            out.append(text)
        yield b.drop_columns(["__spans"]).set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def deduplicated(docs: DataFrame, least: int = 6, shortest: int = 30, line: int = 10) -> DataFrame:
    """``docs`` with the repeated spans taken out of their texts, by row: rows that share a doc_id, null or not, keep what is their own.

    Null and empty texts stay as they are; of equal rows each loses the same. doc_ids are numbers, or strings of digits. An empty table stays empty.
    """
    spans = _spans(docs, least, shortest, line).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__of")).agg(F.collect_list(F.struct("begin", "stop")).alias("__spans"))
    keyed = _keyed(docs)
    same = (F.col("__key") == F.col("__of")) & keyed["doc_id"].cast("long").eqNullSafe(F.col("__id"))
    return keyed.join(spans, same, "left").select(*docs.columns, "__spans").mapInArrow(_without, docs.schema)
