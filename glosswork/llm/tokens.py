"""Token counts of sections: documents are encoded once and whole, and tokens attributed by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

#: Fixed value: how the public byte-level BPE vocabulary of 50,257 tokens splits texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")

_loaded: dict = {}


def _encoder(ranks_path: str, pattern: str):
    """The encoder and the byte length of each token, once for each worker."""
    if ranks_path not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(x) for x in ranks]
        _loaded[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[ranks_path]


def attribute(starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a bound. bounds: ascending ends of the sections, the last one the text's."""
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, stops - 1, "right")
    if rule == "first":
        to = first
    elif rule == "last":
        to = last
    else:  # the section with most bytes of the token; the first of equals
        to = first.copy()
        for i in np.flatnonzero(first != last):
            edges = np.clip(np.concatenate(([starts[i]], bounds[first[i] : last[i]], [stops[i]])), starts[i], stops[i])
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(bounds)
    return np.bincount(to, minlength=n), np.bincount(to[first != last], minlength=n)


def _count(ranks_path: str, pattern: str, rule: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(ranks_path, pattern)
        ids, sections, chars, tokens, crossing = [], [], [], [], []

        def made():
            flat = lambda x: pa.array(np.concatenate(x))
            counts = [len(x) for x in sections]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts))), flat(sections), flat(chars), flat(tokens), flat(crossing)], ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

        for b in batches(rows):
            for doc_id, cell in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = cell.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                bounds = np.append(np.flatnonzero(data == 10) + 1, len(data))
                if len(bounds) > 1 and bounds[-2] == len(data):
                    bounds = bounds[:-1]  # the text ends with a line feed
                stops = np.cumsum(lengths[encoder.encode_to_numpy(text, disallowed_special=())])
                starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
                n, over = attribute(starts, stops, bounds, rule)
                points = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(1, np.int64)
                upto = points[bounds - 1] if len(data) else points
                ids.append(doc_id)
                sections.append(np.arange(len(bounds)))
                chars.append(np.diff(upto, prepend=0))
                tokens.append(n)
                crossing.append(over)
                if len(ids) == 2000:
                    yield made()
                    ids, sections, chars, tokens, crossing = [], [], [], [], []
        if ids:
            yield made()

    return run


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, rule: str = "first") -> DataFrame:
    """One row per section of each document: doc_id, section (from 0), n_chars, n_tokens, n_crossing.

    Sections are lines; a line feed belongs to the line that it ends. The whole text is encoded once. A token belongs to
    the section that holds its bytes; one that crosses a bound counts once, for the section of its first
    byte (``rule`` first), of its last byte (last) or of most of its bytes (most; the first of equals), and is
    counted in n_crossing there. So a document's sections add up to its tokens exactly.

    ``ranks_path`` is a tiktoken file of ranks that every executor can open. A null or empty text is one section
    without characters or tokens. Repeated rows and null doc_id keep rows of their own; further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count(ranks_path, pattern, rule), "doc_id long, section long, n_chars long, n_tokens long, n_crossing long")
