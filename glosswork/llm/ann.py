"""Nearest neighbours by multiprobe p-stable hashing, with exact distances for all candidates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, mix64

#: Largest block of vectors and of queries that one task call compares.
MEMBERS, QUERIES = 8_192, 2_048
#: What the index is fitted on: so many queries with their true neighbours among all vectors, and so many vectors.
SAMPLE_QUERIES, SAMPLE_VECTORS = 96, 4_096
#: Share of the true neighbours of the sample queries that the fitted index must find.
TARGET = 0.93
#: Perturbed buckets per table that an index knows at most, and vectors that a bucket should hold on average at least.
MOST_STEPS, BUCKET = 10_000, 24
#: Numbers of functions and widths that the fit tries.
FUNCTIONS, WIDTHS = (3, 4, 5, 6, 7, 8, 10, 12), (1.5, 2.0, 2.8)

_FINITE = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), -1)


def _steps(functions: int) -> np.ndarray:
    """Perturbations by one cell up or down, of as many functions at a time as MOST_STEPS allows."""
    out, most = [np.zeros(functions, np.int64)], 0
    for most in range(1, functions + 1):
        more = []
        for at in itertools.combinations(range(functions), most):
            for signs in itertools.product((-1, 1), repeat=most):
                step = np.zeros(functions, np.int64)
                step[list(at)] = signs
                more.append(step)
        if len(out) + len(more) > MOST_STEPS:
            break
        out += more
    return np.array(out)


class Hashes:
    """Tables of p-stable hash functions floor((a . x + b) / width), on vectors of unit length.

    An inner product is turned into a distance: a vector is divided by the largest norm and gets one more
    coordinate that makes it a unit vector; a query is scaled to unit length and gets zero there. ``width`` is
    in units of the spread of a projection, which ``spread`` gives.
    """

    def __init__(self, dims: int, norm: float, tables: int, functions: int, width: float, seed: int, spread: float = 1.0):
        each = [np.random.default_rng((seed, t)) for t in range(tables)]  # the first tables are the same, however many follow
        self.norm, self.tables, self.functions, self.width = norm, tables, functions, width * spread
        self.a = np.concatenate([rng.standard_normal((dims + 1, functions)) for rng in each], axis=1)
        self.b = np.concatenate([rng.uniform(0, self.width, functions) for rng in each])
        self.mixing = mix64(np.arange(1, functions + 1, dtype=np.uint64)) | np.uint64(1)
        self.steps = _steps(functions)

    def cells(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        norms = np.linalg.norm(x, axis=1)
        if query:
            x, last = x / norms[:, None], np.zeros(len(x))
        else:
            x, last = x / self.norm, np.sqrt(np.maximum(0, 1 - (norms / self.norm) ** 2))
        at = (np.column_stack((x, last)) @ self.a + self.b) / self.width
        cells = np.floor(at)
        return cells.astype(np.int64).reshape(len(x), self.tables, -1), ((at - cells) * self.width).reshape(len(x), self.tables, -1)

    def _name(self, cells: np.ndarray) -> np.ndarray:
        return mix64((cells.astype(np.uint64) * self.mixing).sum(axis=-1)).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self._name(self.cells(x, False)[0])

    def order(self, inside: np.ndarray) -> np.ndarray:
        """The steps of each query and table in the order of their estimated success: the sum of squared distances to the bounds that are crossed."""
        down, up = (self.steps == -1).astype(float).T, (self.steps == 1).astype(float).T
        return np.argsort(inside**2 @ down + (self.width - inside) ** 2 @ up, axis=2, kind="stable")

    def probes(self, x: np.ndarray, number: int) -> np.ndarray:
        """The first ``number`` buckets of each query and table."""
        cells, inside = self.cells(x, True)
        return self._name(cells[:, :, None, :] + self.steps[self.order(inside)[:, :, :number]])


def _ranks(hashes: Hashes, order: np.ndarray, cells: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For queries, tables and vectors: the place of the vector's bucket among the query's probes; the number of steps if it isn't one."""
    k = hashes.functions
    code = lambda s: ((s + 1) * 3 ** np.arange(k)).sum(axis=-1)
    known, where = code(hashes.steps), np.full(3**k, -1, np.int32)
    where[known] = np.arange(len(known))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[2])[None, None, :], axis=2)
    out = np.full((len(cells), hashes.tables, others.shape[1]), len(known), np.int64)
    for q in range(len(cells)):
        for t in range(hashes.tables):
            step = others[q, :, t] - cells[q, t]
            near = np.flatnonzero((np.abs(step) <= 1).all(axis=1))
            at = where[code(step[near])]
            out[q, t, near[at >= 0]] = place[q, t, at[at >= 0]]
    return out


@dataclass(frozen=True)
class Fit:
    """A chosen index: its tables, functions, width and probes, and what they gave on the sample."""

    tables: int
    functions: int
    width: float
    spread: float
    probes: int
    recall: float
    compared: float


def choose(vectors: np.ndarray, queries: np.ndarray, truth: np.ndarray, valid: np.ndarray, n: int, norm: float, tables: int, seed: int) -> Fit:
    """The tables, ``tables`` at most, functions, width and probes that compare the smallest share of all pairs while they find TARGET of the neighbours.

    ``vectors`` is a sample of the n vectors, ``truth`` holds the true neighbours of each of ``queries`` among all of them where
    ``valid``. Where no choice reaches the target, the one that finds most is taken.
    """
    dims = vectors.shape[1]
    best: Fit | None = None
    spread = float(np.median(np.std(np.column_stack((vectors / norm, np.sqrt(np.maximum(0, 1 - (np.linalg.norm(vectors, axis=1) / norm) ** 2)))) @ np.random.default_rng(seed).standard_normal((dims + 1, 64)), axis=0))) or 1.0
    for functions, width in itertools.product(FUNCTIONS, WIDTHS):
        hashes = Hashes(dims, norm, tables, functions, width, seed, spread)
        cells, inside = hashes.cells(queries, True)
        own = hashes.cells(vectors, False)[0]
        sizes = np.unique(own[:, 0], axis=0, return_counts=True)[1]
        held = (sizes.astype(float) ** 2).sum() / len(own) * n / len(own)  # vectors in the bucket of a vector
        if functions > FUNCTIONS[0] and held < BUCKET:
            continue
        order = hashes.order(inside)
        found = _ranks(hashes, order, cells, hashes.cells(truth.reshape(-1, dims), False)[0].reshape(*truth.shape[:2], tables, functions))
        pairs = _ranks(hashes, order, cells, np.broadcast_to(own, (len(queries), *own.shape)))
        for t in range(1, tables + 1):
            first = found[:, :t].min(axis=1)[valid]
            for probes in sorted({min(len(hashes.steps), math.ceil(1.25**i)) for i in range(42)}):
                recall, compared = float((first < probes).mean()), float((pairs[:, :t] < probes).mean() * t)
                fit = Fit(t, functions, width, spread, probes, recall, compared)
                if best is None or ((-min(recall, TARGET), compared) < (-min(best.recall, TARGET), best.compared)):
                    best = fit
                if recall >= TARGET:
                    break
    return best


def _index(hashes: Hashes, groups: int, kind):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            names = hashes.buckets(_matrix(b.column("vector"), kind).astype(np.float64))
            for t in range(hashes.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(names[:, t] % groups), pa.array(names[:, t]), b.column("vec_id"), b.column("vector")], ["tbl", "grp", "bucket", "vec_id", "vector"])

    return run


def _probe(hashes: Hashes, number: int, groups: int, kind):
    """A row for each group of buckets that a query visits, with the buckets."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches(rows):
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                names = hashes.probes(_matrix(b.column("vector"), kind).astype(np.float64), number)
                n, tables, probes = names.shape
                flat = names.reshape(n * tables, probes)
                flat = np.take_along_axis(flat, np.argsort(flat % groups, axis=1, kind="stable"), axis=1)
                group = flat % groups
                first = np.ones(flat.shape, bool)
                first[:, 1:] = group[:, 1:] != group[:, :-1]
                of = np.flatnonzero(first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(of, flat.size).astype(np.int32)), pa.array(flat.ravel()))
                row = of // probes
                take = pa.array(row // tables)
                yield pa.RecordBatch.from_arrays([pa.array((row % tables).astype(np.int32)), pa.array(group.ravel()[of]), lists, b.column("vec_id").take(take), b.column("vector").take(take)], ["tbl", "grp", "buckets", "query_id", "vector"])

    return run


def _packed(kind):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            vectors = [np.array(x, kind).tobytes() for x in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(vectors, pa.binary())], ["vec_id", "vector"])

    return run


def _top(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates of one query, summed in one order, whatever the block."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0
    near = np.flatnonzero((scores >= least - slack) & (scores > -np.inf))
    exact = (x[near] * q).sum(axis=1)
    first = np.lexsort((ids[near], -exact))[:k]
    return ids[near][first], exact[first]


def _nearest(k: int, kind):
    def run(key: tuple[pa.Scalar, ...], members: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if members.num_rows and queries.num_rows:
            bucket = members["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            x, ids, bucket = _matrix(members["vector"], kind).astype(np.float64)[order], members["vec_id"].to_numpy()[order], bucket[order]
            names, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts[1:], len(bucket))
            q, of = _matrix(queries["vector"], kind).astype(np.float64), queries["query_id"].to_numpy()
            visited = queries["buckets"].combine_chunks()
            offsets = visited.offsets.to_numpy()
            asked = visited.values.to_numpy()
            place = np.minimum(np.searchsorted(names, asked), len(names) - 1)
            known = names[place] == asked
            for at in range(0, len(q), 128):
                low, high = offsets[at], offsets[min(at + 128, len(q))]
                row = np.repeat(np.arange(min(128, len(q) - at)), np.diff(offsets[at : at + 129]))[known[low:high]]
                here = place[low:high][known[low:high]]
                order = np.argsort(here, kind="stable")
                row, here = row[order], here[order]
                scores = np.full((min(128, len(q) - at), len(x)), -np.inf)
                for rows in np.split(np.arange(len(here)), np.flatnonzero(np.diff(here)) + 1):
                    if len(rows):  # the queries that visit one bucket
                        s = slice(starts[here[rows[0]]], ends[here[rows[0]]])
                        scores[row[rows], s] = q[at + row[rows]] @ x[s].T
                scores[of[at : at + 128, None] == ids[None, :]] = -np.inf
                for j, own in enumerate(scores):
                    best, exact = _top(own, q[at + j], x, ids, k)
                    out.append((np.full(len(best), of[at + j]), best, exact))
        merged = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": merged[0], "vec_id": merged[1], "score": merged[2]})

    return run


def _compare(members: DataFrame, queries: DataFrame, k: int, kind) -> DataFrame:
    """The k best of each query among the buckets that it visits in each group. Groups are split into blocks by their counted sizes."""
    keys = ["tbl", "grp"]
    sizes = members.groupBy(keys).agg(F.count("*").alias("m")).join(queries.groupBy(keys).agg(F.count("*").alias("q")), keys)
    sizes = sizes.select(*keys, F.expr(f"cast(ceil(m / {MEMBERS}) as int)").alias("mparts"), F.expr(f"cast(ceil(q / {QUERIES}) as int)").alias("qparts"))
    blocks = [*keys, "mpart", "qpart"]
    left = members.join(sizes, keys).withColumn("mpart", F.pmod(F.xxhash64("vec_id"), F.col("mparts")).cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    right = queries.join(sizes, keys).withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.col("qparts")).cast("int")).withColumn("mpart", F.explode(F.sequence(F.lit(0), F.col("mparts") - 1)))
    grouped = left.select(*blocks, "bucket", "vec_id", "vector").groupBy(blocks).cogroup(right.select(*blocks, "buckets", "query_id", "vector").groupBy(blocks))
    return grouped.applyInArrow(_nearest(k, kind), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(asked: list, k: int, kind):
    """The k best of a partition for a few given queries, with their vectors."""
    q, of = np.array([np.frombuffer(r["vector"], kind) for r in asked], np.float64), np.array([r["vec_id"] for r in asked])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            x, ids = _matrix(b.column("vector"), kind).astype(np.float64), b.column("vec_id").to_numpy()
            scores = q @ x.T
            scores[of[:, None] == ids[None, :]] = -np.inf
            for j, row in enumerate(scores):
                near = np.argsort(-row)[:k]
                near = near[row[near] > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), j, np.int32)), pa.array(row[near]), b.column("vec_id").take(pa.array(near)), b.column("vector").take(pa.array(near))], ["query", "score", "vec_id", "vector"])

    return run


def fitted(packed: DataFrame, every: int, k: int, n: int, norm: float, tables: int, seed: int, kind) -> Fit:
    """Fit an index on a bounded sample: vectors and queries of smallest hash, and the true neighbours of these queries among all vectors."""
    first = lambda df, most: df.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(most).collect()
    asked = first(packed.filter(F.col("vec_id") % every == 0), SAMPLE_QUERIES)
    some = np.array([np.frombuffer(r["vector"], kind) for r in first(packed, SAMPLE_VECTORS)], np.float64)
    if not asked:
        return Fit(1, FUNCTIONS[0], WIDTHS[0], 1.0, 1, 0.0, 0.0)
    found = packed.mapInArrow(_scan(asked, k, kind), "query int, score double, vec_id long, vector binary")
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query", "rank", "vector").collect()
    truth, valid = np.zeros((len(asked), k, some.shape[1])), np.zeros((len(asked), k), bool)
    for r in near:
        truth[r["query"], r["rank"] - 1], valid[r["query"], r["rank"] - 1] = np.frombuffer(r["vector"], kind), True
    if not valid.any():
        return Fit(1, FUNCTIONS[0], WIDTHS[0], 1.0, 1, 0.0, 0.0)
    truth[~valid] = some[0]
    return choose(some, np.array([np.frombuffer(r["vector"], kind) for r in asked], np.float64), truth, valid, n, norm, tables, seed)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 3, seed: int = 11) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k vectors of largest inner product for each row whose vec_id is divisible by ``every``.

    Every vector is indexed in each table. The number of tables, up to ``tables``, of functions, their width and the number of probes are fitted
    on SAMPLE_QUERIES queries with their true neighbours and SAMPLE_VECTORS vectors: of the choices that find TARGET of
    these neighbours, the one that compares the fewest pairs; a pair that meets in two tables counts twice, so one table, where no pair does, is
    taken unless more of them compare less. A query visits the buckets of each table that are likeliest to
    hold its neighbours. All vectors of a visited bucket are compared exactly, in double precision. Buckets travel in
    groups of about MEMBERS vectors, so that a query's vector is sent once for each group and not for each bucket. A query
    that finds fewer than k vectors, though there are more, is compared with all of them, in blocks. Order: score,
    then smaller vec_id.

    Vectors that are null or zero, or hold null or non-finite components, take no part, as queries or candidates; nor do
    those of another length than most (of the greater length, if even) or with a null vec_id. Rows that share a vec_id are
    candidates of each other no more than a row is of itself; of such a candidate the best row counts. An empty
    table gives no rows. Further columns are ignored, whatever their names.
    """
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    valid = vectors.filter(F.expr(f"vec_id is not null and {_FINITE}")).select(F.col("vec_id").cast("long"), "embedding")
    shape = valid.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0d, (a, x) -> a + double(x) * double(x), a -> sqrt(a))")).alias("norm"))
    most = shape.orderBy(F.desc("n"), F.desc("dims")).first()
    packed = valid.filter(F.size("embedding") == (most["dims"] if most else 0)).mapInArrow(_packed(kind), "vec_id long, vector binary")
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = fitted(packed, every, k, most["n"], most["norm"], tables, seed, kind)
    hashes = Hashes(most["dims"], most["norm"], fit.tables, fit.functions, fit.width, seed, fit.spread)
    groups = math.ceil(most["n"] / MEMBERS)
    asking = packed.filter(F.col("vec_id") % every == 0)
    members = packed.mapInArrow(_index(hashes, groups, kind), "tbl int, grp long, bucket long, vec_id long, vector binary")
    queries = asking.mapInArrow(_probe(hashes, fit.probes, groups, kind), "tbl int, grp long, buckets array<long>, query_id long, vector binary")
    found = cut(_best(_compare(members, queries, k, kind), k))
    there = packed.select("vec_id").distinct().count() - 1
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, there)).select("query_id")
    lacking = asking.withColumnRenamed("vec_id", "query_id").join(enough, "query_id", "left_anti") if there > 0 else None
    if lacking is None or lacking.isEmpty():
        return found
    none, one = F.lit(0).cast("long"), F.array(F.lit(0).cast("long"))
    rest = _best(_compare(packed.select(F.lit(-1).alias("tbl"), none.alias("grp"), none.alias("bucket"), "vec_id", "vector"), lacking.select(F.lit(-1).alias("tbl"), none.alias("grp"), one.alias("buckets"), "query_id", F.col("vector").alias("vector")), k, kind), k)  # a new name for the column, as both sides come from one table
    return found.join(enough, "query_id", "left_semi").unionByName(rest)
