"""Divergence of the sources of a language, from weighted term counts over collapsed duplicate texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut

#: A term is a run of ASCII letters and anything outside ASCII, in UTF-8.
TERM = rb"[A-Za-z\x80-\xff]+"
#: Counts are summed within a task until so many terms, or so many bytes of them, are held.
HELD, HELD_BYTES = 400_000, 64 << 20
#: Bits for the documents of a sum that holds occurrences and documents.
SHIFT = 40
#: Tables of no more rows than this are broadcast (some 20 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Probabilities are in parts of this many.
SCALE = 1_000_000_000


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the terms of texts: each text is read once and counts for each of its sources as often as it stands there."""
    found: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)  # a term's occurrences, shifted, and documents
    held = size = 0

    def made():
        for (lang, source), sums in found.items():
            counts = list(sums.values())
            n, docs = pa.array([c >> SHIFT for c in counts], pa.int64()), pa.array([c & (1 << SHIFT) - 1 for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array(list(sums), pa.binary()).cast(pa.string()), n, docs], ["lang", "source", "term", "n", "docs"])

    for b in batches(rows):
        for lang, sources, text in zip(b.column("lang").to_pylist(), b.column("sources").to_pylist(), b.column("text"), strict=True):
            terms = Counter(re.findall(TERM, text.as_buffer().to_pybytes().lower()))
            for source in sources:
                sums, copies = found[lang, source["source"]], source["copies"]
                before = len(sums)
                for term, n in terms.items():
                    sums[term] = sums.get(term, 0) + ((n << SHIFT) + 1) * copies
                held += len(sums) - before
                size += sum(map(len, terms)) if len(sums) > before else 0
                if held > HELD or size > HELD_BYTES:
                    yield from made()
                    found.clear()
                    held = size = 0
    yield from made()


def collapsed(docs: DataFrame) -> DataFrame:
    """One row per distinct text of a language: lang, text and its sources with the number of copies in each.

    Copies are counted by digest. Only texts that several rows have are dealt, after one row of them is kept in each task, so a text that a
    third of the rows share moves once a task; the others stay where they are, while the digests of the several fit a
    broadcast. sources holds no more entries than the language has sources.
    """
    rows = _keyed(docs, "text").withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    several = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"), F.sum("copies").alias("all")).filter("all > 1").drop("all")
    several = cut(several.select("lang", "digest", "sources", F.size("sources").alias("entries")))
    small = (several.agg(F.sum("entries")).first()[0] or 0) <= BROADCAST_ROWS
    side = F.broadcast(several.drop("entries")) if small else several.drop("entries")
    one = rows.join(side.drop("sources"), ["lang", "digest"], "left_anti").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("copies"))).alias("sources"))
    many = rows.join(side, ["lang", "digest"]).select("lang", "digest", "text", "sources").dropDuplicates(["lang", "digest"]).select("lang", "text", "sources")
    return one.unionByName(many)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """lang, source and more columns as strings, null as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", *more)))


def _p(n: str, total: str, terms: str) -> str:
    """SQL for the smoothed probability, exact at any count."""
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))"


def _f(p: str, q: str) -> str:
    """SQL for floor((p - q)**2 / (p + q))."""
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far a source is from the others of its language, and by which terms.

    A language keeps the V terms (A-Z lower-cased) of ``least_docs`` of its documents or more; each source of it, and the language, gives
    every kept term p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)), N its occurrences of kept terms. With f = floor((p - q)**2 / (p + q)),
    ``pair`` rows hold for each other source of the language the sum of f over all kept terms, and ``term`` rows the ``top``
    terms that the source has, and likelier than the language, with f. rank counts from 1, value descending, then item in UTF-8 order.

    Equal texts of a language are tokenized once, with their copies as weights. Pairs of sources meet only in terms that both
    have: what terms of one source, or of none, add to a sum comes from the histogram of each source's counts.

    Null text, lang and source are ''; repeated rows count each; further columns are ignored. A language of one source has no pair rows,
    one without kept terms has pairs of value 0; an empty table gives no rows.
    """
    counted = collapsed(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # dealt by term alone: the sums by source and the documents of the language need no further shuffle
    by_source = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = Window.partitionBy("lang", "term")
    kept = by_source.withColumns({"lang_n": F.sum("n").over(held), "lang_docs": F.sum("docs").over(held)}).filter(F.col("lang_docs") >= least_docs)
    terms = cut(kept.select("lang", "source", "term", "n", "lang_n"))

    occurring = _keyed(docs).distinct()
    sizes = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total"))))
    filled = groups.filter("v > 0").withColumn("p0", F.expr(_p("0L", "total", "v")))
    side = _small(filled)
    dense = cut(terms.join(side, ["lang", "source"]).select("lang", "source", "term", "n", "p0", F.expr(_p("n", "total", "v")).alias("p"), F.expr(_p("lang_n", "lang_total", "v")).alias("q")))

    # what the counts of one source add against a source that has none of its terms
    levels = dense.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("terms"))
    other = filled.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    alone = levels.join(_small(other), "lang").filter("source <> other")
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"terms * ({_f('p', 'q0')} - {_f('p0', 'q0')})")).alias("part"))
    # what terms of both add beyond that
    one = dense.select("lang", "term", "source", "p", "p0")
    two = dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    both = one.join(two, ["lang", "term"]).filter("source < other")
    both = both.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"{_f('p', 'r')} - {_f('p', 'r0')} - {_f('p0', 'r')} + {_f('p0', 'r0')}")).alias("part"))
    # what all terms would add if neither source had any
    pairs = groups.join(_small(groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))), "lang").filter("source <> other")
    none = pairs.select("lang", "source", "other", F.expr(f"if(v = 0, 0, v * {_f(f'({_p('0L', 'total', 'v')})', f'({_p('0L', 'other_total', 'v')})')})").alias("part"))
    swap = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "part")
    summed = none.unionByName(alone).unionByName(swap(alone)).unionByName(both).unionByName(swap(both)).groupBy("lang", "source", "other").agg(F.sum("part").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.col("value").cast("long").alias("value"))
    term = dense.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).cast("long").alias("value"))
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pair, term)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
