"""Near-duplicate documents by an exact Jaccard join of word shingles (universe partition and pigeonhole).

A set of size l belongs to a size band. The band hashes the universe of shingles into m segments. Two sets
with Jaccard similarity of 0.8 or more differ in at most H = (|X| + |Y|) // 9 shingles, so of any
units of capacity that add up to H + 1, one holds: a segment of capacity 1 is equal in both, or a segment of
capacity 2 differs by one shingle at most. Every set is indexed under each of its band's segments, and some
segments also under every subset with one shingle deleted. A set probes its own band and the one below,
and spends just H + 1 units of capacity on the cheapest segments. The cost of a segment is the estimated
document frequency of its rarest shingle, from a count sketch over all documents.

Pairs that meet under a key are verified exactly on their whole shingle sets. A small bucket gives all its
pairs. Large buckets become groups, each named by one member. The sets of a group are first verified against a
hub, the one that differs least from a sample of the others. What this leaves in several components is compared in
blocks within tasks, by bitmaps and then exactly: only links between components come out, fewer than there are sets. So
no join makes more rows than a group has, and no link between components is lost.

Sets are held as 64-bit shingle hashes; classes of equal sets as a 128-bit sum over the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, components, cut, mix64, pieces, row_key, shingle_sets, stored, without_rows

#: Least similarity of linked sets, in hundredths.
PERCENT = 80
#: Counters of the document-frequency sketch (4 bytes each) and the parts in which it is summed.
SKETCH, PARTS = 1 << 18, 64
#: A bucket with so many index-probe combinations or fewer gives all its pairs.
SMALL_BUCKET = 64
#: Blocks of a group that are compared two at a time hold no more sets than this, and about so many bytes of them.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 32 << 20
#: Members of a group among which its hub is chosen.
SAMPLE = 32
#: Classes with more copies than this share of all rows (one in so many) are indexed by one of them.
HEAVY = 20_000
#: Stands for the null doc_id.
NO_ID = -(2**63)
#: Words of 64 bits in a set's parity bitmap: two bitmaps differ in no more bits than the sets in shingles.
BITMAP = 8
#: Tables of no more rows than this are broadcast (some 40 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Extra segments of a band beyond the pigeonhole's need: an eighth and two; a sixteenth take one-deletion keys.
EXTRA, DELETING = 8, 16

_ROWS = "key long, member long, meta long"


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    deleting: int


def bands(largest: int) -> list[Band]:
    """Size bands up to ``largest``; the partners of a set lie in its own band or the next one below or above."""
    out, low = [], 1
    while low <= largest:
        high = low * 5 // 4
        most = (high * 5 // 4 + high) // 9  # shingles by which a set of this band and a partner can differ
        segments = most + 1 + max(2, most // EXTRA)
        out.append(Band(low, high, segments, max(1, segments // DELETING)))
        low = high + 1
    return out


def _read(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, number of rows, hashes, owners, set sizes, both sums that name a class."""
    for first, texts in pieces(column):
        h, owner = shingle_sets(texts, width)
        n = np.bincount(owner, minlength=len(texts))
        sums = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.zeros(len(texts), np.uint64)
            has = np.flatnonzero(n)
            if len(has):
                total[has] = np.add.reduceat(mix64(h ^ np.uint64(salt)), np.concatenate(([0], np.cumsum(n[has])[:-1])))
            sums.append(total)
        yield first, len(texts), h, owner, n, sums[0], sums[1]


def _describe(width: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        empty = pa.nulls
        for b in batches(rows):
            for first, k, h, _, n, d1, d2 in _read(b.column("text"), width):
                sketch += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, k), b.column("key").slice(first, k), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), empty(k, pa.int32()), empty(k, pa.binary())], ["doc_id", "key", "n", "d1", "d2", "part", "counts"])
        parts = [x.tobytes() for x in np.split(np.minimum(sketch, 2**31).astype(np.uint32), PARTS)]
        yield pa.RecordBatch.from_arrays([*(empty(PARTS, pa.int64()) for _ in range(5)), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "key", "n", "d1", "d2", "part", "counts"])

    return run


def _sum_parts(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH // PARTS, np.int64)
    for b in rows:
        for x in b.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()])], ["part", "counts"])


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed sketch: ``SKETCH`` counters of 4 bytes, whatever the number of documents."""
    parts = described.filter("part is not null").select("part", "counts")
    salted = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("part", "salt").applyInArrow(_sum_parts, "part int, counts binary")
    rows = salted.groupBy("part").applyInArrow(_sum_parts, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(rows)]) if rows else np.zeros(SKETCH, np.uint32)


def _keys(h, owner, sizes, member, scheme: Band, need, own: bool, frequency) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, member, meta) of the sets with these shingles under a band's segments.

    ``need`` is the capacity that each set has to spend; ``own`` adds the index rows. meta holds
    the set's size, times four, with bit 1 for index rows and bit 0 for probing rows.
    """
    salt = np.uint64(scheme.low * 0x9E3779B97F4A7C15 & (2**64 - 1))
    segment = (mix64(h ^ salt) % np.uint64(scheme.segments)).astype(np.int64)
    order = np.lexsort((segment, owner))
    owner, segment, h = owner[order], segment[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(first)
    of, seg, k = owner[at], segment[at], np.diff(np.append(at, len(h)))
    part = mix64(h + salt)
    whole = np.add.reduceat(part, at)
    df = frequency[(h >> np.uint64(46)).astype(np.int64)].astype(np.float64)
    rarest = np.minimum.reduceat(df, at)
    group = np.repeat(np.arange(len(at)), k)
    second = df.copy()
    second[np.flatnonzero(df == rarest[group])[np.unique(group[df == rarest[group]], return_index=True)[1]]] = np.inf
    second = np.minimum.reduceat(second, at)

    # units of capacity: the whole segment, then one deletion more, then segments that the set leaves empty
    able = np.flatnonzero((seg < scheme.deleting) & (k >= 2))
    unit_of = np.concatenate((of, of[able]))
    unit = np.concatenate((np.arange(len(at)), able))
    deletes = np.concatenate((np.zeros(len(at), bool), np.ones(len(able), bool)))
    cost = np.concatenate((rarest + 1 / k, second[able] + (k * rarest)[able] + 1))
    rank = np.lexsort((cost, unit_of))
    unit_of, unit, deletes = unit_of[rank], unit[rank], deletes[rank]
    have = np.bincount(unit_of, minlength=len(sizes))
    place = np.arange(len(unit_of)) - (np.cumsum(have) - have)[unit_of]
    chosen = place < need[unit_of]
    probe = np.zeros(len(at), bool)
    probe[unit[chosen & ~deletes]] = True
    wide = np.zeros(len(at), bool)
    wide[unit[chosen & deletes]] = True

    salts = mix64(salt + np.arange(2 * scheme.segments, dtype=np.uint64))
    name = lambda sums, segs, deleted=False: mix64(sums ^ salts[segs + scheme.segments * deleted])
    out_key, out_of, out_bits = [], [], []

    def put(keys, owners, bits):
        out_key.append(keys)
        out_of.append(owners)
        out_bits.append(np.broadcast_to(bits, len(keys)))

    some = slice(None) if own else probe
    put(name(whole, seg)[some], of[some], (2 * own + probe)[some])
    put(name(whole, seg, True)[wide], of[wide], 1)
    each = wide[group]
    put(name(whole[group] - part, seg[group])[each], of[group][each], 1)
    if own:
        each = ((seg < scheme.deleting) & (k >= 3))[group]
        put(name(whole[group] - part, seg[group], True)[each], of[group][each], 2)
    # a set indexes the segments it leaves empty too, and probes them where nothing else is left
    filled = np.bincount(of, minlength=len(sizes))
    lacking = np.flatnonzero((filled < scheme.segments) & (sizes > 0) & (need > 0))
    if len(lacking):
        if own:
            grid = np.zeros((len(lacking), scheme.segments), bool)
            row = np.full(len(sizes), -1)
            row[lacking] = np.arange(len(lacking))
            mine = row[of] >= 0
            grid[row[of[mine]], seg[mine]] = True
            r, s = np.nonzero(~grid)
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            put(name(np.zeros(len(r), np.uint64), s), lacking[r], 2 + (nth < (need - have)[lacking][r]))
        else:
            for d in lacking[(need - have)[lacking] > 0]:
                free = np.setdiff1d(np.arange(scheme.segments), seg[of == d])[: need[d] - have[d]]
                put(name(np.zeros(len(free), np.uint64), free), np.full(len(free), d), 1)
    key, of_row, bits = (np.concatenate(x) for x in (out_key, out_of, out_bits))
    return key.view(np.int64), member[of_row].view(np.int64), sizes[of_row] * 4 + bits


def _repeated(ids: pa.Array, d1: np.ndarray, d2: np.ndarray, heavy: tuple[np.ndarray, np.ndarray, np.ndarray], seen: np.ndarray) -> np.ndarray:
    """The rows of classes with many copies that needn't be indexed: not of the class's smallest doc_id, or met in this task before."""
    out = np.zeros(len(d1), bool)
    if not len(heavy[0]):
        return out
    at = np.minimum(np.searchsorted(heavy[0], d1.view(np.int64)), len(heavy[0]) - 1)
    for i in np.flatnonzero((heavy[0][at] == d1.view(np.int64)) & (heavy[1][at] == d2.view(np.int64))):
        low = heavy[2][at[i]]
        out[i] = seen[at[i]] or (low != NO_ID and ids[i].as_py() != low)
        seen[at[i]] |= not out[i]
    return out


def _signatures(width: int, frequency, heavy):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = bands(64), np.zeros(len(heavy.value[0]), bool)
        for b in batches(rows):
            for first, k, h, owner, n, d1, d2 in _read(b.column("text"), width):
                n[_repeated(b.column("doc_id").slice(first, k), d1, d2, heavy.value, seen)] = 0
                if not n.any():
                    continue
                if n.max() > known[-1].high:
                    known = bands(int(n.max()))
                band = np.searchsorted([x.high for x in known], n)
                for k in np.unique(band[n > 0]):
                    for j, own in ((k, True), (k - 1, False)):
                        here = (band == k) & (n > 0)
                        if j < 0:
                            continue
                        if not own:
                            here &= (4 * n + 4) // 5 <= known[j].high
                        mine = here[owner]
                        if mine.any():
                            need = np.where(here, (n + np.minimum(n, known[j].high)) // 9 + 1, 0)
                            arrays = _keys(h[mine], owner[mine], n, d1, known[j], need, own, frequency.value)
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "member", "meta"])

    return run


def _fits(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of such sizes can have the similarity."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return 100 * low >= percent * high


def _meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a partition that is sorted by key, index rows first, then by member.

    Kind 0 are pairs to verify; kind 1 says that b is in the group of a. Of a bucket, no more than the index rows of
    a small bucket are held at a time.
    """
    held: list[np.ndarray] = []
    hub: tuple | None = None  # key and member of the first index row of a large bucket that goes on

    def table(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def star(member, top):
        new = np.ones(len(member), bool)
        new[1:] = member[1:] != member[:-1]
        yield table(1, np.full(new.sum(), top[1]), member[new])

    def done(key, member, meta):
        """Whole buckets."""
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1]) | ((meta[1:] ^ meta[:-1]) & 2 != 0)
        key, member, meta = key[new], member[new], meta[new]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(at, len(key)))
        many = size > 1
        index = np.add.reduceat((meta >> 1) & 1, at)
        probes = np.add.reduceat(meta & 1, at)
        many &= (index > 0) & (probes > 0)
        small = many & (index * probes <= SMALL_BUCKET)
        pairs = np.flatnonzero(small)
        if len(pairs):
            combos = index[pairs] * size[pairs]
            of = np.repeat(pairs, combos)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(combos) - combos, combos)
            i, j = at[of] + nth // size[of], at[of] + nth % size[of]
            n, m = meta[i] >> 2, meta[j] >> 2
            good = (meta[j] & 1 > 0) & (member[i] != member[j]) & _fits(n, m)
            i, j = i[good], j[good]
            yield table(0, np.minimum(member[i], member[j]), np.maximum(member[i], member[j]))
        for g in np.flatnonzero(many & ~small):
            s = slice(at[g], at[g] + size[g])
            yield from star(member[s], (key[at[g]], member[at[g]]))

    def whole():
        if held:
            data = np.concatenate(held, axis=1)
            held.clear()
            yield from done(*data)

    for b in batches(rows):
        data = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "member", "meta")])
        if hub is not None:
            n = int(np.searchsorted(data[0] != hub[0], True)) if data[0][0] == hub[0] else 0
            n = len(data[0]) if data[0][-1] == hub[0] else n
            if n:
                yield from star(data[1, :n], hub)
            data = data[:, n:]
            if not data.shape[1]:
                continue
            hub = None
        last = data[0][-1]
        n = int(np.searchsorted(data[0], last))
        if n or (held and held[-1][0][-1] != last):
            held.append(data[:, :n])
            yield from whole()
        held.append(data[:, n:])
        if sum(x.shape[1] for x in held) > 50_000:  # one bucket of that many rows: go on by its first index row
            all_rows = np.concatenate(held, axis=1)
            held.clear()
            if all_rows[2][0] & 2:
                hub = (last, all_rows[1][0])
                yield from star(all_rows[1], hub)
            else:  # no index row comes any more in this bucket
                held.append(all_rows[:, -1:])
    yield from whole()


def _sets(width: int):
    """The shingle sets of texts, for the rows whose set is that of the class they are joined to."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for first, k, h, owner, n, d1, d2 in _read(b.column("text"), width):
                data, ends = h.tobytes(), np.cumsum(n) * 8
                parity = np.bincount(owner * (64 * BITMAP) + (h % np.uint64(64 * BITMAP)).astype(np.int64), minlength=k * 64 * BITMAP) & 1
                bits = np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(k, BITMAP)
                own = pa.RecordBatch.from_arrays([b.column("member").slice(first, k), b.column("node").slice(first, k), pa.array([data[e - 8 * m : e] for e, m in zip(ends, n, strict=True)], pa.binary()), pa.array(list(bits), pa.list_(pa.int64()))], ["member", "node", "shingles", "bits"])
                same = (d1.view(np.int64) == b.column("member").slice(first, k).to_numpy()) & (d2.view(np.int64) == b.column("d2").slice(first, k).to_numpy())
                yield own.filter(pa.array(same))

    return run


def _named(width: int):
    """The class of each text, beside the text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for first, k, _, _, _, d1, d2 in _read(b.column("text"), width):
                yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), b.column("text").slice(first, k)], ["member", "d2", "text"])

    return run


def _verify(percent: int):
    """The pairs whose sets have the similarity."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("first"), b.column("second"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep)), b.column("v").filter(pa.array(keep))], ["u", "v"])

    return run


def _differing(p: str, q: str) -> str:
    """SQL for the number of bits in which two bitmaps differ."""
    return " + ".join(f"bit_count({p}[{i}] ^ {q}[{i}])" for i in range(BITMAP))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members whose shingle sets are similar, as nodes (u, v).

    Bitmaps and sizes are joined first; the sets themselves only for pairs that these don't rule out.
    """
    light = sets.select("member", "node", "bits", F.expr("octet_length(shingles) div 8").alias("n"))
    left = light.select(F.col("member").alias("a"), F.col("node").alias("u"), F.col("bits").alias("p"), "n")
    right = light.select(F.col("member").alias("b"), F.col("node").alias("v"), F.col("bits").alias("q"), F.col("n").alias("m"))
    near = pairs.select("a", "b").join(left, "a").join(right, "b").filter(F.expr(f"u <> v and ({_differing('p', 'q')}) * {100 + percent} <= (n + m) * {100 - percent}")).select("a", "b", "u", "v")
    first = sets.select(F.col("member").alias("a"), F.col("node").alias("u"), F.col("shingles").alias("first"))
    second = sets.select(F.col("member").alias("b"), F.col("node").alias("v"), F.col("shingles").alias("second"))
    return near.join(first, ["a", "u"]).join(second, ["b", "v"]).select("u", "v", "first", "second").mapInArrow(_verify(percent), "u long, v long")


def _apart(groups: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (f, member) of groups whose members are in different components, with node, component and bits."""
    label = sets.join(nodes, "node", "left").select("member", "node", F.coalesce("component", "node").alias("component"), "bits")
    rows = groups.join(label, "member")
    several = rows.groupBy("f").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("f")
    return stored(rows.join(several, "f"))


def _hubs(rows: DataFrame) -> DataFrame:
    """Per group, of a sample of its members the one that differs least from the others by the bitmaps: f, hub, hub_node."""
    order = Window.partitionBy("f").orderBy(F.xxhash64("member", "f"), "member", "node")
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE)
    one, two = few.select("f", "member", "node", F.col("bits").alias("p")), few.select("f", F.col("bits").alias("q"))
    total = one.join(two, "f").groupBy("f", "member", "node").agg(F.sum(F.expr(_differing("p", "q"))).alias("total"))
    best = total.groupBy("f").agg(F.min(F.struct("total", "member", "node")).alias("best"))
    return best.select("f", F.col("best.member").alias("hub"), F.col("best.node").alias("hub_node"))


def _to_hubs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the hub of each group and its other members."""
    hubs = _hubs(rows)
    return rows.select("f", "member").join(hubs, "f").filter("member <> hub").select(F.least("member", "hub").alias("a"), F.greatest("member", "hub").alias("b")).distinct()


def _compare(key: tuple[pa.Scalar, ...], block: pa.Table, percent: int) -> pa.Table:
    """Links between components of a block: of two components no more than one, so that there are fewer links than sets.

    The rows are sorted, since which links these are depends on their order, and a task that runs again may get them in another one.
    """
    order = np.lexsort((block["member"].to_numpy(), block["node"].to_numpy()))
    node, component, part = (block[c].to_numpy()[order] for c in ("node", "component", "part"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in block["shingles"].chunks for x in c]
    bits = np.array(block["bits"].combine_chunks().values, np.int64).view(np.uint64).reshape(len(sets), BITMAP)[order]
    sets = [sets[k] for k in order]
    size = np.array([len(x) for x in sets])
    apart = key[1] != key[2]
    found = []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        may = (component[rest] != component[i]) & _fits(size[rest], size[i : i + 1], percent)
        if apart:
            may &= part[rest] != part[i]
        at = np.flatnonzero(may) + i + 1
        at = at[(100 + percent) * np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (size[at] + size[i])]
        for j in at:
            if component[j] != component[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if (100 + percent) * common >= percent * (size[i] + size[j]):
                    found.append((node[i], node[j]))
                    component[component == component[j]] = component[i]
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _within(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the components of each group, from blocks of some BLOCK_BYTES of sets that are compared two at a time."""
    whole = rows.join(sets.select("member", "node", "shingles"), ["member", "node"])
    sizes = rows.join(sets.select("member", "node", F.octet_length("shingles").alias("bytes")), ["member", "node"]).groupBy("f").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    sizes = sizes.select("f", F.expr(f"cast(greatest(ceil(bytes / {BLOCK_BYTES}), ceil(n / {BLOCK_ROWS})) as int)").alias("parts"))
    dealt = whole.join(sizes, "f").withColumn("part", F.pmod(F.xxhash64("member", "node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("f", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "member", "node", "component", "part", "bits", "shingles")
    return blocks.groupBy("f", "i", "j").applyInArrow(lambda key, block: _compare(key, block, percent), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link if the Jaccard similarity of their word shingle sets is 0.8 or more, computed in integers.
    Null and empty texts, and texts without words, have an empty set: n_shingles 0, linked with nothing.
    Repeated rows keep a row each. A null doc_id gets the smallest non-null doc_id that it reaches,
    else null. Rows that share a doc_id are one node of the graph. Further columns are ignored.
    """
    found = _grouped(docs, width, False)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).when(F.col("component") < 2**62, F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _grouped(docs: DataFrame, width: int, by_text: bool) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n and component, null where it links with nothing.

    Nodes are doc_ids, or, where a text has none or ``by_text`` holds, 2**62 and more for texts of equal shingle sets.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("key"))
    described = cut(keyed.mapInArrow(_describe(width), "doc_id long, key long, n long, d1 long, d2 long, part int, counts binary"))
    frequency = spark.sparkContext.broadcast(_sketch(described))  # 1 MB
    base = described.filter("part is null").select("doc_id", "key", "n", "d1", "d2")
    lone = F.lit(2**62) + F.col("d1").bitwiseAND(F.lit(2**61 - 1))  # stands for a class that has no doc_id
    classes = base.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", lone if by_text else F.coalesce("low", lone)))

    many = classes.filter(F.col("copies") > max(1, base.count() // HEAVY)).select("d1", "d2", F.coalesce("low", F.lit(NO_ID)).alias("low")).orderBy("d1", "d2").collect()  # HEAVY rows at most
    heavy = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in many], np.int64) for i in range(3)))

    keys = texts.mapInArrow(_signatures(width, frequency, heavy), _ROWS)
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", F.col("meta").bitwiseAND(F.lit(2)).desc(), "member")
    met = cut(sorted_keys.mapInArrow(_meet, "kind byte, a long, b long").distinct())
    pairs, groups = met.filter("kind = 0").select("a", "b"), met.filter("kind = 1").select(F.col("a").alias("f"), F.col("b").alias("member"))

    return named_rows(base, classes, linked(texts, classes, pairs, groups, width, PERCENT))


def linked(texts: DataFrame, classes: DataFrame, pairs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Components (node, component) of the links among candidate ``pairs(a, b)`` and within ``groups(f, member)``, which both name classes by d1.

    ``classes(d1, d2, n, low, node)`` are the distinct sets of ``texts(doc_id, text)``. Similarity is verified on whole sets.
    """
    members = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).union(groups.select("member")).distinct()
    chosen = cut(classes.join(members, classes.d1 == members.member).select("member", "node", "low", "d2", "n"))
    wanted = chosen.filter("low is not null").select(F.col("low").alias("doc_id"), "member", "d2", "node")
    found = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id").select("member", "d2", "node", "text")
    if not classes.filter("low is null").isEmpty():  # rows without doc_id are found by their class
        nameless = texts.filter("doc_id is null").select("text").mapInArrow(_named(width), "member long, d2 long, text string")
        found = found.union(nameless.join(chosen.filter("low is null"), ["member", "d2"]).select("member", "d2", "node", "text"))
    sets = found.mapInArrow(_sets(width), "member long, node long, shingles binary, bits array<long>")
    sets = cut(sets.repartition("member").groupBy("member", "node").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits")))

    # large buckets: groups whose name is in another one join it, as most copies meet under many keys
    low = groups.groupBy(F.col("member").alias("f")).agg(F.min("f").alias("g"))
    groups = groups.join(low, "f").select(F.col("g").alias("f"), "member").distinct()
    # first what links to the hub of its group, then what is still apart
    alone = stored(groups.join(sets.select("member", "node", F.col("node").alias("component"), "bits"), "member"))
    links = stored(_links(pairs.union(_to_hubs(alone, sets)), sets, percent))
    nodes = components(links)
    rows = _apart(groups, sets, nodes)
    if not rows.isEmpty():
        nodes = components(links.union(_within(rows, sets, percent)))
    return nodes


def named_rows(base: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``base(doc_id, key, n, d1, d2)`` with their component, null where a row links with nothing."""
    grouped = classes.filter("copies > 1").select("node").union(nodes.select("node")).distinct().join(nodes, "node", "left")
    named = classes.join(grouped, "node").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    joined = base.join(named, ["d1", "d2", "n"], "left")
    return joined.select("doc_id", "key", "n", "component")


def without_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with the row of smallest doc_id, null last, of each group of near duplicates; rows without words all stay.

    Groups link texts, whatever their doc_ids. Among rows of that doc_id the one of smallest key stays, and of
    repeated rows with equal text one. Columns are those of ``docs``.
    """
    found = cut(_grouped(docs, width, True).filter("component is not null"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    best = found.groupBy("component").agg(first)
    ranked = cut(found.join(best, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).select("doc_id", "key", "stays"))
    kept = without_rows(docs, ranked.filter("not stays"))
    repeated = cut(ranked.filter("stays").groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key"))
    if repeated.isEmpty():
        return kept
    single = without_rows(kept, repeated)
    keyed = kept.withColumn("__key", row_key("doc_id", "text"))
    once = keyed.join(repeated.select(F.col("key").alias("__key")).distinct(), "__key", "left_semi").dropDuplicates(["__key"])
    return single.unionByName(once.select(docs.columns))
