"""Ranks, gap thinning and as-of joins over sorted ranges, with one key that holds most rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glosswork.operators import dataset as ds
from glosswork.operators import ordered

HOT = 7


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    keys = [HOT] * 4_000 + [None] * 300 + [rng.randrange(400) for _ in range(2_500)]
    rng.shuffle(keys)
    return [(k, round(float(rng.choice([rng.random() * 900, rng.randrange(300), 5])), 2), i) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k long, t double, id long").withColumn("n", F.lit("clash"))


def by_key(rows):
    out = defaultdict(list)
    for k, t, i in rows:
        out[k].append((t, i))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture
def many_ranges(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 23
    for c, v in before.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_ranked(monkeypatch, many_ranges, table, rows, limit):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    got = {r["id"]: (r["place"], r["all"]) for r in ordered.ranked(table, ["k"], ["t", "id"], "place", "all").collect()}
    want = {i: (n, len(v)) for v in by_key(rows).values() for n, (_, i) in enumerate(v, 1)}
    assert got == want


def test_one_key_is_dealt_over_all_ranges(many_ranges, table):
    held = Counter(r["_part"] for r in ordered.ranges(table, "k", "t", "id").filter(F.col("k") == HOT).select("_part").collect())
    assert len(held) > many_ranges // 2 and max(held.values()) < 3 * 6_800 / many_ranges


def test_rank_without_keys_and_rows(many_ranges, table, rows):
    got = {r["id"]: r["rank"] for r in ordered.ranked(table, [], ["t", "id"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((t, i) for _, t, i in rows), 1)}
    assert ordered.ranked(table.limit(0), ["k"], ["t"]).count() == 0


def test_every_kth(many_ranges, table, rows):
    got = {r["id"] for r in ordered.every_kth(table, ["k"], ["t", "id"]).collect()}
    assert got == {i for v in by_key(rows).values() for n, (_, i) in enumerate(v) if len(v) <= 6 or n % 2 == 0}


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_even_thin(many_ranges, table, rows, n):
    got = sorted(((r["k"], r["t"]) for r in ordered.even_thin(table, "k", "t", n).collect()), key=str)
    want = []
    for k, v in by_key(rows).items():
        at = range(len(v)) if len(v) <= n else [round(i * (len(v) - 1) / (n - 1)) for i in range(n)] if n > 1 else [0]
        want += [(k, v[i][0]) for i in at]
    assert got == sorted(want, key=str)


def thinned(times, gap, last=None):
    out = []
    for t in times:
        if last is None or t - last > gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("gap", [0.0, 0.75, 3.0, 40.0, 10_000.0])
def test_gap_dedup(many_ranges, table, rows, gap):
    got = ordered.gap_dedup(table, "k", "t", gap)
    assert got.columns == table.columns
    found = sorted(((r["k"], r["t"]) for r in got.collect()), key=str)
    assert found == sorted(((k, t) for k, v in by_key(rows).items() for t in thinned([t for t, _ in v], gap)), key=str)


def test_gap_dedup_edges(spark, many_ranges):
    odd = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", 2.0), (None, 1.0), (None, 1.5), ("b", None)], "k string, t double")
    assert sorted(map(tuple, ordered.gap_dedup(odd, "k", "t").collect()), key=str) == [("a", 2.0), (None, 1.0)]
    assert ordered.gap_dedup(odd.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("gap", [0.3, 0.75, 2.0])
def test_chains_know_every_way(gap):
    rng = random.Random(5)
    for _ in range(200):
        times = sorted(round(rng.random() * rng.choice([1, 3, 12]), 1) for _ in range(rng.randrange(1, 40)))
        ways = ordered.Chains(gap)
        for t in times:
            ways.add(t)
        starts, ends = ways.steps()
        assert ends == [e for i, e in enumerate(ends) if i == 0 or e != ends[i - 1]]
        for carry in [None, *(times[0] - x / 10 for x in range(30))]:
            kept = thinned(times, gap, carry)
            assert ordered.carried(carry, starts, ends, gap) == (kept[-1] if kept else carry)


def test_chains_stay_few():
    ways = ordered.Chains(1.0)
    for i in range(20_000):
        ways.add(i / 100)
    assert len(ways.starts) == 102 and len(ways.ways) <= 102


@pytest.mark.parametrize("limit", [0, 200_000])
def test_at_or_after(spark, monkeypatch, many_ranges, table, rows, limit):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    asked, given = table.filter("id % 3 = 0"), table.filter("id % 11 = 0")
    frames = by_key([r for r in rows if r[2] % 11 == 0])
    want = []
    for k, t, i in rows:
        if i % 3 == 0:
            later = [(x, j) for x, j in frames.get(k, []) if x >= t]
            want.append((k, t, *(min(later) if later else (None, None))))
    got = [tuple(r) for r in ordered.at_or_after(asked, given, "k", "t", "id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    missing = spark.createDataFrame([(1, None, 5)], "k long, t double, id long")
    assert [tuple(r) for r in ordered.at_or_after(missing, missing, "k", "t", "id").collect()] == [(1, None, None, None)]


def test_cycled_pool(many_ranges, table):
    got = {r["slot"]: r["id"] for r in ds.cycled(table.filter("id < 5").select("id"), "id", 12).collect()}
    assert got == {s: s % 5 for s in range(12)}
    assert ds.cycled(table.limit(0), "id", 12).count() == 0
