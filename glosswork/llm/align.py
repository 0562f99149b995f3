"""Alignment of two tokenizers: texts are cut where tokens of both end, and token pairs within a cut counted over all documents."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, stored
from .tokens import PATTERN

#: Texts are encoded in runs of about so many bytes.
RUN_BYTES = 1 << 18
#: A slice with more links than this is expanded over its distinct ids, with their products as counts.
WIDE = 4_096
#: Document counts of pairs are summed within a task until so many pairs are held.
HELD = 1 << 20
#: Counts of the most frequent pairs are broadcast, no more of them than this (16 bytes each); the others are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, codes binary, docs binary"
_loaded: dict = {}


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable characters themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_byte_level(path: str):
    """A function from texts to arrays of ids, and the bytes of each id.

    Where the file's ids follow the order of its merges, as they do in a trained byte-level BPE, they are ranks, and the faster of two
    encoders runs on them; both give the same ids. Otherwise the file's own encoder runs.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    at, vocab = _byte_level(), saved["model"]["vocab"]
    special = {x["content"]: x["id"] for x in saved.get("added_tokens") or [] if x["special"]}
    whole = vocab | special
    pieces = [b""] * (max(whole.values()) + 1)
    for piece, i in whole.items():
        pieces[i] = bytes(at[c] for c in piece) if piece not in special else piece.encode()
    merges = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in saved["model"]["merges"]]
    how = saved["pre_tokenizer"]
    if saved["normalizer"] is None and how["type"] == "ByteLevel" and how.get("use_regex", True) and not how["add_prefix_space"] and merges == sorted(set(merges)):
        ranks = {pieces[i]: i for piece, i in vocab.items() if piece not in special}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [fast.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts], pieces
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, np.int64) for e in slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], pieces


def load_pieces(path: str):
    """The same for a sentencepiece model, which itself puts the space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)], pieces


class _Side:
    """One tokenizer: ids of texts, bytes and lengths of ids."""

    def __init__(self, load, path: str) -> None:
        self.encode, self.pieces = load(path)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _sides(path_a: str, path_b: str) -> tuple[_Side, _Side, list[str]]:
    """Both tokenizers and the decimal ids with each of the three separators, made once for each worker."""
    if (path_a, path_b) not in _loaded:
        a, b = _Side(load_byte_level, path_a), _Side(load_pieces, path_b)
        _loaded[path_a, path_b] = a, b, [f"{i}{s}" for i in range(max(len(a.pieces), len(b.pieces))) for s in ",|;"]
    return _loaded[path_a, path_b]


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side lie before each offset at which tokens of both end, in order of the offsets."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(at_a.keys() & at_b.keys())
    before = [np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b)]
    return before[0], before[1]


def links(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs a * size_b + b of tokens that share a slice, ascending, and how often each occurs."""
    start_a, start_b = np.concatenate(([0], cut_a[:-1])), np.concatenate(([0], cut_b[:-1]))
    many_a, many_b = cut_a - start_a, cut_b - start_b
    per = many_a * many_b
    flat = np.flatnonzero(per <= WIDE)
    count = per[flat]
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    of = np.repeat(flat, count)
    i, j = start_a[of] + nth // many_b[of], start_b[of] + nth % many_b[of]
    codes, times = np.unique(ids_a[i] * size_b + ids_b[j], return_counts=True)
    wide = np.flatnonzero(per > WIDE)
    if not len(wide):
        return codes, times
    codes, times = [codes], [times]
    for g in wide:
        a, n = np.unique(ids_a[start_a[g] : cut_a[g]], return_counts=True)
        b, m = np.unique(ids_b[start_b[g] : cut_b[g]], return_counts=True)
        codes.append((a[:, None] * size_b + b).ravel())
        times.append((n[:, None] * m).ravel())
    return _summed(codes, times)


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(code, kind="stable")
    code, time = code[order], time[order]
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[at], np.add.reduceat(time, at)


def groups_text(ids_a, ids_b, cut_a, cut_b, names: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides, slice by slice."""
    of_a = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=0))
    of_b = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=0))
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[cut_a - 1], last_b[cut_b - 1] = 1, 2
    named = np.empty(len(ids_a) + len(ids_b), np.int64)
    named[np.arange(len(ids_a)) + np.concatenate(([0], cut_b[:-1]))[of_a]] = 3 * ids_a + last_a
    named[np.arange(len(ids_b)) + cut_a[of_b]] = 3 * ids_b + last_b
    return "".join(map(names.__getitem__, named.tolist()))[:-1]


def _aligned(path_a: str, path_b: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, names = _sides(path_a, path_b)
        size_b = len(b.pieces)
        row = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("codes", pa.binary()), ("docs", pa.binary())])

        def align(texts: list[str]) -> Iterator[tuple]:
            for text, ids_a, ids_b in zip(texts, a.encode(texts), b.encode(texts), strict=True):
                data = b" " + text.encode()
                if not text or a.bytes_of(ids_a) != data or b.bytes_of(ids_b) != data:
                    yield 0, 0, 0, 0, "", b"", b""
                    continue
                cut_a, cut_b = cuts(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
                codes, times = links(ids_a, ids_b, cut_a, cut_b, size_b)
                held.append((codes, np.ones(len(codes), np.int64)))
                digest = hashlib.sha256(groups_text(ids_a, ids_b, cut_a, cut_b, names).encode()).hexdigest()
                yield len(ids_a), len(ids_b), len(cut_a), int(times.sum()), digest, codes.astype(np.uint32).tobytes(), times.astype(np.int64 if times.max() >= 2**31 else np.int32).tobytes()

        def counted() -> Iterator[pa.RecordBatch]:
            if held:
                codes, docs = _summed(*map(list, zip(*held, strict=True)))
                held.clear()
                for k in range(0, len(codes), 1 << 16):
                    yield pa.RecordBatch.from_pylist([{"codes": codes[k : k + (1 << 16)].tobytes(), "docs": docs[k : k + (1 << 16)].tobytes()}], schema)

        def made(ids: list, texts: list[str], row: int) -> Iterator[pa.RecordBatch]:
            columns = list(zip(*align(texts), strict=True))
            numbers = [pa.array(c, pa.int64()) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.int64()), *numbers, pa.array(columns[4]), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.binary()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.binary())], schema=schema)

        ids, texts, size = [], [], 0
        for batch in batches(rows):
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = cell.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= RUN_BYTES or len(ids) == 2000:
                    yield from made(ids, texts, row)
                    row += len(ids)
                    ids, texts, size = [], [], 0
                    total = sum(len(c) for c, _ in held)
                    if total > HELD:
                        codes, docs = _summed(*map(list, zip(*held, strict=True)))
                        held[:] = [(codes, docs)]
                        if len(codes) > HELD // 2:
                            yield from counted()
        if ids:
            yield from made(ids, texts, row)
        yield from counted()

    return run


def _unpacked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        for codes, docs in zip(b.column("codes"), b.column("docs"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (codes, docs)], ["code", "n"])


def _known(frequent):
    """Sums over the pairs whose counts are broadcast."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = frequent.value
        for b in batches(rows):
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, (pairs, times) in enumerate(_pairs(b)):
                if len(pairs) and len(code):
                    at = np.minimum(np.searchsorted(code, pairs), len(code) - 1)
                    times = np.where(code[at] == pairs, times, 0)
                    n_best[i], total[i] = times[best[at]].sum(), (times * count[at]).sum()
            keep = [b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_best), pa.array(total), b.column("groups_sha256")], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _others(frequent):
    """The pairs of each row whose counts aren't broadcast."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = frequent.value[0]
        for b in batches(rows):
            for row, (pairs, times) in zip(b.column("row").to_numpy(), _pairs(b), strict=True):
                rest = ~np.isin(pairs, code, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rest.sum(), row)), pa.array(pairs[rest].astype(np.int64)), pa.array(times[rest].astype(np.int64))], ["row", "code", "times"])

    return run


def _pairs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and numbers of occurrences of each row of a batch."""
    for pairs, times in zip(b.column("pairs"), b.column("times"), strict=True):
        code = np.frombuffer(pairs.as_buffer(), np.uint32)
        data = times.as_buffer()
        yield code, np.frombuffer(data, np.int32 if data.size == 4 * len(code) else np.int64).astype(np.int64)


def _pair_counts(stored_rows: DataFrame, size_b: int) -> DataFrame:
    """Per id pair: code, n, the number of documents that hold it linked, and whether that is the highest of its A id."""
    sums = stored_rows.filter("codes is not null").select("codes", "docs").mapInArrow(_unpacked, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return stored(sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"code div {size_b}")))))  # a window holds no more rows than B has ids


def _frequent(counts: DataFrame, most: int):
    """The most frequent pairs, no more than ``most``, as ascending arrays, and from how many documents on they are there."""
    by_power = {r["power"]: r["many"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("many")).collect()}  # 64 rows at most
    least, held = max(by_power, default=0) + 1, 0
    while least > 0 and held + by_power.get(least - 1, 0) <= most:
        least -= 1
        held += by_power.get(least, 0)
    found = counts.filter(F.col("n") >= 2**least).select("code", "n", "best").toArrow().sort_by("code")
    return (found["code"].to_numpy(), found["n"].to_numpy(), found["best"].to_numpy()), 2**least


def alignment(docs: DataFrame, path_a: str, path_b: str, most: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE (tokenizers JSON) of a space and the text, B a sentencepiece model of the text; special tokens are plain text.
    The offsets at which tokens of both end are the common keys of two dictionaries from end to index; in order they cut both lists of ids
    into groups. Links are all pairs of an A and a B token of a group; n_links counts them, n_best those whose pair stands in as many documents
    as the most frequent pair of its A id does (ties included), count_sum adds up the documents of the pairs. groups_sha256 is the digest of
    ``a1,a2|b1;a3|b2,b3``.

    A null or empty text, or one that the tokens of a side don't give back byte by byte, has no tokens: zeros and ''. Texts are encoded once
    and whole. Repeated rows are documents of their own and keep a row each; a null doc_id stays null; further columns are ignored. An empty
    table gives no rows.

    Each document's distinct pairs are written beside its row, so nothing is encoded again. Their document counts are summed in tasks
    before they are shuffled. The counts of the most frequent pairs are broadcast, at most ``most``; the occurrences of
    the rarer ones are joined by a shuffle, where no pair is frequent.
    """
    size_b = len(load_pieces(path_b)[1])
    if len(load_byte_level(path_a)[1]) * size_b > 2**32:
        raise ValueError("the id pairs of these tokenizers don't fit 32 bits")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stored(texts.mapInArrow(_aligned(path_a, path_b), _ROWS))
    counts = _pair_counts(made, size_b)
    top, least = _frequent(counts, most)
    frequent = docs.sparkSession.sparkContext.broadcast(top)
    rows = made.filter("row is not null").drop("codes", "docs")
    out = rows.mapInArrow(_known(frequent), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    rare = counts.filter(F.col("n") < least)
    if least > 1 and not rare.isEmpty():
        other = rows.select("row", "pairs", "times").mapInArrow(_others(frequent), "row long, code long, times long").join(rare, "code")
        more = other.groupBy("row").agg(F.sum("times").alias("more_links"), F.sum(F.expr("times * n")).alias("more"), F.sum(F.expr("if(best, times, 0)")).alias("more_best"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.expr("n_best + coalesce(more_best, 0)"), "count_sum": F.expr("count_sum + coalesce(more, 0)")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
