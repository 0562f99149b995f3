"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut

#: Statistics of a document, in the order of the vector.
STATISTICS = ("bytes", "words", "word_bytes", "distinct_words", "top_word", "distinct_pairs", "lines", "distinct_lines", "line_bytes", "sentence_ends", "commas", "marks", "digits", "capitals", "beyond_ascii", "long_words", "marked_words", "compressed")
_MARKS = np.array([chr(i).isascii() and not chr(i).isalnum() and chr(i).isprintable() and chr(i) not in " .,'-\"" for i in range(256)])
_ENDS_MARKED = re.compile(rb"[^\sA-Za-z0-9.,;:'\"\x80-\xff](?=\s|$)")
#: Compression looks at the whole text in pieces of this size.
_PIECE = 1 << 18


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text: logarithms of counts, logits of shares."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, w, k = len(data), len(words), len(lines)
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    tally = Counter(words)
    share = lambda a, b: math.log((a + 0.5) / (b - a + 0.5)) if b >= a else 0.0
    squeezed = sum(len(zlib.compress(data[i : i + _PIECE], 1)) for i in range(0, n, _PIECE))
    return [
        math.log1p(n),
        math.log1p(w),
        math.log((n + 1) / (w + 1)),
        share(len(tally), w),
        share(max(tally.values(), default=0), w),
        share(len(set(zip(words, words[1:], strict=False))), max(w - 1, 0)),
        math.log1p(k),
        share(len(set(lines)), k),
        math.log((n + 1) / (k + 1)),
        share(int(counts[46] + counts[33] + counts[63]), n),
        share(int(counts[44]), n),
        share(int(counts[_MARKS].sum()), n),
        share(int(counts[48:58].sum()), n),
        share(int(counts[65:91].sum()), letters),
        share(int((counts[128:192]).sum()), n),
        share(sum(c for x, c in tally.items() if len(x) > 15), w),
        share(len(_ENDS_MARKED.findall(data)), w) if w else 0.0,
        math.log((squeezed + 20) / (n + 20)),
    ]


def _describe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        values = [statistics(x.as_py()) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "stats"])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is in the held-out fold: crc32 of the id as text leaves 1 modulo 3. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """One row (doc_id, label) per labelled document outside the held-out fold; equal votes count as 0."""
    known = labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg((F.avg(F.col(name).cast("double")) > 0.5).cast("int").alias("label"))


@dataclass(frozen=True)
class Discriminant:
    """A fitted model; ``factors`` are the inverse Cholesky factors of the class covariances."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    prior: float
    temper: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        log = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.prior + (log[1] - log[0]) * self.temper, -30, 30)))


def _moments(center: np.ndarray, scale: np.ndarray):
    """Sums of a partition by label: count, values and products."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(center)
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches(rows):
            x = np.array(b.column("stats").to_pylist())
            y = b.column("label").to_numpy()
            z = np.clip((x - center) / scale, -6, 6)
            for k in (0, 1):
                s = z[y == k]
                sums[k] += np.concatenate(([len(s)], s.sum(axis=0), (s.T @ s).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["label", "sums"])

    return run


def _summed(stats: DataFrame, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The moments of both classes; one row of fixed size per class and position comes to the driver."""
    parts = stats.mapInArrow(_moments(center, scale), "label int, sums array<double>")
    rows = parts.select("label", F.posexplode("sums").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x")).collect()
    d = len(center)
    out = np.zeros((2, 1 + d + d * d))
    for r in rows:
        out[r["label"], r["pos"]] = r["x"]
    return out


def fit(stats: DataFrame, shrinkage: float = 0.3, temper: float = 0.5) -> Discriminant | float:
    """Fit on rows (stats, label), all of them; with rows of fewer than two classes, a constant score.

    A class covariance is (1 - a) S + a D, where D is the diagonal of the pooled covariance, and a grows from
    ``shrinkage`` towards 1 where a class has few rows. ``temper`` flattens the log-density differences,
    since the statistics depend on each other in ways that two normal densities don't show.
    """
    d = len(STATISTICS)
    plain = _summed(stats, np.zeros(d), np.full(d, 1.0) * 1e6)  # no clipping at this scale
    n = plain[:, 0]
    if not n.all():
        return 0.5 if not n.any() else float((n[1] + 1) / (n.sum() + 2))
    center = plain[:, 1 : 1 + d].sum(axis=0) / n.sum() * 1e6
    second = np.diagonal(plain[:, 1 + d :].sum(axis=0).reshape(d, d)) / n.sum() * 1e12
    scale = np.sqrt(np.maximum(second - center**2, 1e-6))
    sums = _summed(stats, center, scale)
    means = sums[:, 1 : 1 + d] / n[:, None]
    covs = [sums[k, 1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.diagonal(sum(c * m for c, m in zip(covs, n, strict=True)) / n.sum()) + 1e-3)
    factors, logdets = [], []
    for c, m in zip(covs, n, strict=True):
        a = shrinkage + (1 - shrinkage) * d / (d + m)
        low = np.linalg.cholesky((1 - a) * c + a * pooled)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diagonal(low)).sum())
    return Discriminant(center, scale, means, np.array(factors), np.array(logdets), float(np.log(n[1] / n[0])) * temper, temper)


def _score(model: Discriminant | float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            if isinstance(model, float):
                score = np.full(b.num_rows, model)
            else:
                score = model.score(np.array(b.column("stats").to_pylist()).reshape(b.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: better), predicted.

    Statistics of the whole texts are made once; the model is fitted on those of all labelled documents outside the
    held-out fold, and sees nothing but the text. Null texts count as empty and get a score as well. Labels of
    documents that aren't there, null labels and null ids are left out; without labels of both kinds
    all scores are the share of the one kind, smoothed, or 0.5. Repeated rows keep a row each. doc_id is a number; further
    columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = cut(texts.mapInArrow(_describe, "doc_id long, stats array<double>"))
    model = fit(stats.join(training_labels(labels, "quality"), "doc_id").select("stats", "label"), shrinkage)
    scored = stats.withColumn("held_out", held_out()).mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: Discriminant | float, threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            if isinstance(model, float):
                keep = np.full(b.num_rows, model >= threshold)
            else:
                keep = model.score(np.array([statistics(x.as_py()) for x in b.column("text")])) >= threshold
            yield b.filter(pa.array(keep))

    return run


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns.

    The fit reads the labelled documents only; then every row is scored where it is, without a shuffle of the texts.
    """
    known = training_labels(labels, "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = cut(texts.mapInArrow(_describe, "doc_id long, stats array<double>").join(known, "doc_id").select("stats", "label"))
    return docs.mapInArrow(_keep(fit(stats), threshold), docs.schema)
