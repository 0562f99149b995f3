"""Near-duplicate documents by MinHash: documents are posted under the coordinates of their signatures, and collisions counted.

A signature has COORDINATES values. Sets of similarity s agree in a coordinate with probability s, so that sets of 0.85 agree
in fewer than MATCHES of them once in 9 * 10**8 pairs; links of higher similarity are lost yet more rarely. Pairs that agree in MATCHES or more are
candidates, whose whole sets are compared.

A coordinate and its value make a token. A document orders its tokens from the rarest to the most frequent; two documents
with MATCHES common tokens share one of the first COORDINATES - MATCHES + 1 of either, so only these are posted, and of them
only tokens that another document has. Inside a posting list, documents are sorted by the size of their sets, so that the merge skips
those whose sizes rule a link out, and a pair is counted once, under the first token that it shares. Tokens of more than SMALL documents
don't give pairs: their documents become a group, named by the smallest of them, which is solved as in the n-gram join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, mix64, row_key
from .setjoin import _fits, _read, linked, named_rows

#: Least similarity of linked sets, in hundredths.
PERCENT = 85
#: Values of a signature, and in how many of them candidates agree at least.
COORDINATES, MATCHES = 32, 13
#: A token of no more documents than this gives pairs; one of more makes a group.
SMALL = 12
#: Pairs whose collisions are counted at a time.
COUNTED = 20_000

_SALTS = mix64(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of COORDINATES tokens for each set; ``h`` holds the hashes of the sets one after the other, none of them empty."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sizes), COORDINATES), np.int64)
    for k, salt in enumerate(_SALTS):
        least = np.minimum.reduceat(mix64(h ^ salt), starts)
        out[:, k] = (mix64(least + np.uint64(k)) >> np.uint64(16)).astype(np.int64)
    return out


def _signed(width: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for first, k, h, _, n, d1, d2 in _read(b.column("text"), width):
                has = np.flatnonzero(n)
                tokens = signatures(h, n[has]) if len(has) else np.empty((0, COORDINATES), np.int64)
                ends = np.zeros(k + 1, np.int32)
                ends[1:] = np.cumsum(n > 0) * COORDINATES
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, k), b.column("key").slice(first, k), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], ["doc_id", "key", "n", "d1", "d2", "tokens"])

    return run


def _collide(percent: int):
    """Candidate pairs of a partition that is sorted by token, then by the size of the documents' sets."""

    def counted(token, member, n, rank, coordinate, flat, i, j) -> pa.RecordBatch:
        """Of the pairs of rows, those with enough collisions of which this token is the first."""
        grid = np.zeros((len(token), COORDINATES), np.int64)
        place = np.full((len(token), COORDINATES), COORDINATES, np.int8)
        grid[rank[0], coordinate], place[rank[0], coordinate] = flat, rank[1]
        same = (grid[i] == grid[j]) & (grid[i] > 0)
        first = np.where(same, place[i], COORDINATES).argmin(axis=1)
        keep = (same.sum(axis=1) >= MATCHES) & (grid[i, first] == token[i])
        a, b = member[i[keep]], member[j[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The pairs of whole posting lists."""
        token, member, n = (table[c].to_numpy() for c in ("token", "member", "n"))
        lists = table["tokens"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat, coordinate = lists.flatten().to_numpy(), table["coordinates"].combine_chunks().flatten().to_numpy()
        rank = np.repeat(np.arange(len(token)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        stop = np.repeat(np.append(at[1:], len(token)), np.diff(np.append(at, len(token))))
        for k in range(1, SMALL):  # the k-th next row of the list; where it is too large, all later ones are
            i = np.flatnonzero(np.arange(len(token)) + k < stop)
            i = i[_fits(n[i], n[i + k], percent) & (member[i] != member[i + k])]
            for s in range(0, len(i), COUNTED):
                part = i[s : s + COUNTED]
                yield counted(token, member, n, rank, coordinate, flat, part, part + k)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last token, at most SMALL, and those of a batch
        for b in batches(rows):
            table = pa.Table.from_batches([*held, b])
            token = table["token"].to_numpy()
            n = int(np.searchsorted(token, token[-1]))
            if n:
                yield from whole(table.slice(0, n))
            held = table.slice(n).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held))

    return run


def _candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) and groups (f, member) of classes(d1, n, tokens)."""
    tokens = classes.select(F.col("d1").alias("member"), "n", F.posexplode("tokens").alias("coordinate", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("member").alias("lead")).filter("df > 1")
    hits = tokens.join(shared, "token").groupBy("member", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token", "coordinate", "lead"))).alias("hits"))  # COORDINATES at most
    able = cut(hits.filter(F.size("hits") >= MATCHES))
    prefix = F.explode(F.slice("hits", F.lit(1), F.size("hits") - MATCHES + 1)).alias("hit")
    posts = able.select("member", "n", F.col("hits.token").alias("tokens"), F.transform("hits.coordinate", lambda c: c.cast("byte")).alias("coordinates"), prefix)
    posts = posts.select("hit.token", "hit.df", "hit.lead", "member", "n", "tokens", "coordinates")
    lists = posts.filter(F.col("df") <= SMALL).select("token", "member", "n", "tokens", "coordinates").repartition("token").sortWithinPartitions("token", "n", "member")
    pairs = cut(lists.mapInArrow(_collide(percent), "a long, b long"))
    large = posts.filter(F.col("df") > SMALL).select(F.col("lead").alias("f"), "member")
    return pairs, cut(large.union(large.select("f", "f")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id reachable by links, and kept (doc_id = component_id).

    Two documents link if the Jaccard similarity of their sets of word shingles is ``percent`` hundredths or more, computed in integers on
    the whole sets. Below PERCENT more links are lost than the module's figure says.
    Null and empty texts, and texts without words, have an empty set: n_shingles 0, linked with nothing, kept. Texts of fewer words than
    ``width`` have their whole sequence as one shingle. Repeated rows keep a row each, so all rows of a kept doc_id are kept; rows that share
    a doc_id are one node of the graph. A null doc_id gets the smallest non-null doc_id that it reaches, else null, and is never
    kept. doc_ids are numbers, or strings of digits. Further columns are ignored; an empty table gives no rows.

    Documents of equal sets are one class and posted once, so exact copies never meet each other.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(texts.withColumn("key", row_key("doc_id", "text")).mapInArrow(_signed(width), "doc_id long, key long, n long, d1 long, d2 long, tokens array<long>"))
    lone = F.lit(2**62) + F.col("d1").bitwiseAND(F.lit(2**61 - 1))  # stands for a class that has no doc_id
    classes = base.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
    classes = cut(classes.withColumn("node", F.coalesce("low", lone)))
    pairs, groups = _candidates(classes.select("d1", "n", "tokens"), percent)
    light = classes.drop("tokens")
    found = named_rows(base.drop("tokens"), light, linked(texts, light, pairs, groups, width, percent))
    component = F.when(F.col("component").isNull(), F.col("doc_id")).when(F.col("component") < 2**62, F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
