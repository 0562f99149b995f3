"""Toxicity classifier that a swap of identity terms should not move (counterfactual regularisation)."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, batches, cut, mix64
from .quality import held_out, training_labels

#: Groups of identity terms that stand for each other in a counterfactual, by language: the plain names of common groups, no slurs, no other languages.
IDENTITY_TABLE = {
    "en": (
        ("women", "men"),
        ("woman", "man"),
        ("female", "male"),
        ("gay", "lesbian", "straight", "bisexual", "transgender"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("immigrant", "native"),
        ("immigrants", "natives"),
        ("disabled", "deaf", "blind"),
        ("old", "young"),
    ),
    "de": (("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "atheisten"), ("ausländer", "inländer"), ("schwule", "lesben"), ("alte", "junge")),
    "fr": (("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "hindous", "athées"), ("immigrés", "autochtones"), ("vieux", "jeunes")),
    "es": (("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"), ("inmigrantes", "nativos"), ("viejos", "jóvenes")),
}
IDENTITY_TERMS = tuple(group for groups in IDENTITY_TABLE.values() for group in groups)
#: Of the labelled texts that name no group, one in so many gets a term.
PLACED = 4
#: Labelled documents of each class that the fit reads at most, and the features that it keeps at most.
MOST_ROWS, MOST_FEATURES = 8_000, 8_192
#: Parts of a class, by the hash of doc_id, that are ranked apart.
PARTS = 64
#: Features are hashes of so many bits: of all windows of WIDTH bytes within a word, and of windows of STARTS bytes
#: at its beginning. The space on either side of a word counts as a part of it.
BITS, WIDTH, STARTS = 20, 5, (7, 9, 11)


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> str:
    """The text with every identity term changed to the next one of its group."""
    following, pattern = _following(groups)
    return pattern.sub(lambda m: following[m.group().lower()], text)


@functools.cache
def _following(groups):
    following = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    return following, re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def placed(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, every: int = PLACED) -> str:
    """One text in ``every``, by its hash, with an identity term put before one of its words; the others as they are."""
    chance = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    words = text.split(" ")
    terms = [t for g in groups for t in g]
    if not terms or chance % every:
        return text
    at = chance // every % len(words)
    return " ".join((*words[:at], terms[chance // 2**32 % len(terms)], *words[at:]))


_PLAIN = np.array([i if (97 <= i <= 122 or 48 <= i <= 57 or i >= 128) else 32 for i in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Hashes of the lower-cased text's windows, repeats included."""
    widest = max(WIDTH, *STARTS)
    data = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    data = np.concatenate((data, np.full(widest, 32, np.uint8)))
    out = []
    for at in range(0, len(data) - widest + 1, PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES + widest - 1].astype(np.uint64)
        n = len(piece) - widest + 1
        space = piece == 32
        hashed = np.zeros(n, np.uint64)
        inner = np.ones(n, bool)  # whether all bytes but the first and the last are of one word
        for j in range(widest):
            hashed = hashed * np.uint64(0x100000001B3) + piece[j : j + n]
            if j + 1 == WIDTH:
                out.append(mix64(hashed[inner]))
            elif j + 1 in STARTS:
                out.append(mix64(hashed[inner & space[:n]] + np.uint64(j)))
            if j:
                inner = inner & ~space[j : j + n]
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def _extract(groups):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            own, other = [], []
            for x in b.column("text"):
                text = x.as_py() or ""
                changed = swapped(text, groups)
                if changed == text:  # names no group
                    text = placed(text, groups)
                    changed = swapped(text, groups)
                own.append(np.unique(features(text)).astype(np.int32))
                other.append(None if changed == text else np.unique(features(changed)).astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(own, kind), pa.array(other, kind)], ["label", "own", "other"])

    return run


def _selected(kept: np.ndarray):
    """The positions of the kept features, 4 bytes each, instead of all hashes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        found = lambda v: place[v.values.to_numpy()]
        only = lambda v: None if not v.is_valid else (p := found(v))[p >= 0].tobytes()
        for b in batches(rows):
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array([only(v) for v in b.column(c)], pa.binary()) for c in ("own", "other"))], ["label", "own", "other"])

    return run


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by feature hash
    bias: float


def _scored(text: str, weights: np.ndarray, bias: float) -> float:
    found = features(text)
    found = np.unique(found[weights[found] != 0])
    return float(1 / (1 + np.exp(-np.clip(bias + weights[found].sum(), -30, 30))))


def _descend(labels: np.ndarray, own: list, other: list, size: int, swap: float, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by accelerated gradient steps; ``swap`` weighs the squared change of the score under a swap."""

    def flat(rows):
        rows = [np.asarray([] if r is None else r, np.int64) for r in rows]
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.empty(0, np.int64)])

    n = len(labels)
    r, c = flat(own)
    has = np.array([i for i, x in enumerate(other) if x is not None], np.int64)
    r2, c2 = flat([other[i] for i in has])
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w, b = np.zeros(size), 0.0
    v, vb, t = w.copy(), b, 1.0
    # the trace bounds the curvature, of the loss and of the penalty
    curve = 0.25 * float((share * (np.bincount(r, minlength=n) + 1)).sum()) + ridge
    if len(has):
        curve += 2 * swap * float(np.mean([len(set(own[i]) ^ set(other[i])) for i in has]))
    step = 1.0 / curve
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(rounds):
        z = np.bincount(r, v[c], minlength=n) + vb
        p = sigmoid(z)
        g = share * (p - labels)
        dw, db = np.bincount(c, g[r], minlength=size) + ridge * v, g.sum()
        if len(has):
            z2 = np.bincount(r2, v[c2], minlength=len(has)) + vb
            change = (z[has] - z2) * 2 * swap / len(has)
            full = np.zeros(n)
            full[has] = change
            dw += np.bincount(c, full[r], minlength=size) - np.bincount(c2, change[r2], minlength=size)
        new, nb = v - step * dw, vb - step * db
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, name: str = "toxic", groups=IDENTITY_TERMS, swap: float = 1.0, ridge: float = 1e-5, rounds: int = 2000, most_rows: int = MOST_ROWS) -> Model | float:
    """Fit on at most ``most_rows`` labelled documents of each class, of each of PARTS parts of it those of smallest hash of doc_id.

    Features are counted over these documents in Spark. Kept are those in three toxic documents or more and at least
    four times as frequent there as in others, the most telling first, and those of the identity terms. Where a text names no group of people, one in
    PLACED gets a term, the same way in both classes, so that every table has counterfactuals. What comes to the driver is one short row
    of kept features per document. Without labels of both kinds the model is a constant.
    """
    # PARTS parts of each class by hash, of which each gives the same number at most
    order = F.xxhash64("doc_id")
    place = F.row_number().over(Window.partitionBy("label", F.pmod(order, F.lit(PARTS))).orderBy(order, "doc_id"))
    chosen = labels.withColumn("place", place).filter(F.col("place") <= max(1, most_rows // PARTS)).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_extract(groups), "label int, own array<int>, other array<int>"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return 0.5 if not n1 + n0 else (n1 + 1) / (n1 + n0 + 2)
    counts = rows.select("label", F.explode("own").alias("feature")).groupBy("feature").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("n") - F.col("toxic") + 0.5) / (n0 + 1))
    best = counts.filter((F.col("toxic") >= F.least(F.lit(3), F.lit(n1))) & (odds >= 4)).orderBy((F.log(odds) * F.sqrt("toxic")).desc(), "feature").limit(MOST_FEATURES)
    # the windows of the terms take part whatever their counts: what they may weigh is the penalty's matter
    terms = [int(x) for g in groups for t in g for x in features(t)]
    kept = np.array(sorted({*terms, *(r["feature"] for r in best.select("feature").collect())}), np.int64)
    data = rows.mapInArrow(_selected(kept), "label int, own binary, other binary").collect()
    data.sort(key=lambda r: (r["label"], bytes(r["own"]), r["other"] is not None, bytes(r["other"] or b"")))
    read = lambda x: None if x is None else np.frombuffer(x, np.int32)
    w, b = _descend(np.array([r["label"] for r in data], float), [read(r["own"]) for r in data], [read(r["other"]) for r in data], len(kept), swap, ridge, rounds)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Model(weights, b)


def _score(shared):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches(rows):
            score = [bias if weights is None else _scored(x.as_py() or "", weights, bias) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, groups=IDENTITY_TERMS, swap: float = 1.0, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted.

    Whole texts are scored. The model comes from labelled documents outside the held-out fold (see ``fit``). Where a
    labelled text names a group of people, or was given such a name for training, its copy with the terms swapped is scored as well in training and the
    squared change of the logit penalised, so that a term can't carry the score by itself.

    Null texts count as empty. Labels of documents that aren't there, null labels and null ids are left out; without labels
    of both kinds all scores are the smoothed share of the one kind, or 0.5. Repeated rows keep a row each. doc_id is a number;
    further columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, training_labels(labels, "toxic"), groups=groups, swap=swap, most_rows=most_rows)
    shared = docs.sparkSession.sparkContext.broadcast((None, model) if isinstance(model, float) else (model.weights, model.bias))  # 4 MB of plain arrays
    scored = texts.withColumn("held_out", held_out()).mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
