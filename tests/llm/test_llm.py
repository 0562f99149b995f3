"""Operators of the llm package against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.llm import ann, chat, decontam, linededup, mix, quality, setjoin, shard, tokens, toxicity
from glosswork.llm.common import components, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s0"])[k % len(sources or [1])], 0) for k, (i, t) in enumerate(texts)]
    # columns whose names clash with those that the operators use inside
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("row", "n", "member", "component", "rank", "count", "label", "words")})


def prose(rng, n):
    return " ".join(rng.choice(["ta", "re", "mi", "so", "lu", "ke", "no"]) + rng.choice(["ta", "re", "mi", "so", "la"]) + rng.choice(["x", "n", "r"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = []
    for i in range(60):
        t = prose(rng, rng.choice([1, 3, 5, 6, 9, 14, 40, 120, 300]))
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = t.split()
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            out.append(" ".join(w))
    out += [None, "", "  \n ", "Same SAME words here now", "same same WORDS here now", prose(rng, 20_000)]
    return list(enumerate(out))


# --- n-gram Jaccard join


def words_of(text):
    return (text or "").encode().lower().split()


def brute_components(rows):
    sets, numbers = [], {}
    for _, t in rows:
        w = words_of(t)
        shingles = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        sets.append(frozenset(numbers.setdefault(x, len(numbers)) for x in shingles))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), rows[find(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets))}


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.near_duplicates(docs_of(spark, corpus).repartition(7)).collect()}
    assert got == brute_components(corpus)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = []
    for i in range(150):  # a chain of copies that drift apart
        w = list(base)
        for k in range(i % 5):
            w[(7 * i + 11 * k) % 60] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(setjoin, "SMALL_BUCKET", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("block", "number"), [(70, 300), (4096, 2000)])
def test_near_duplicates_of_drifting_copies(spark, monkeypatch, block, number):
    rng = random.Random(10)
    base = [prose(rng, 1) + str(k) for k in range(80)]
    rows, copies = [], [base]
    for i in range(number):  # copies of copies: some far from the first one, some far from all
        w = list(copies[rng.randrange(len(copies))] if i % 3 else base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 7])):
            w[rng.randrange(80)] = f"{prose(rng, 1)}{rng.randrange(9)}"
        copies = (copies + [w])[-40:]
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, rows[7][1]) for i in range(300)]  # equal copies
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 20


def test_links_of_a_block_in_any_order_of_its_rows():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    rows = []
    for k in range(40):  # copies that all link with each other: which links come out is a choice
        h = np.sort(np.concatenate((base[: 99 - k % 5], rng.integers(0, 2**63, 1).astype(np.uint64))))
        parity = np.bincount((h % np.uint64(512)).astype(np.int64), minlength=512) & 1
        rows.append({"member": 900 - k, "node": k // 2, "component": k // 2, "part": k // 2 % 2, "bits": np.packbits(parity.astype(np.uint8)).view(np.int64).tolist(), "shingles": h.tobytes()})
    for other in (0, 1):  # within a block, and between two
        key = pa.scalar(7), pa.scalar(0), pa.scalar(other)
        found = [sorted(zip(*setjoin._compare(key, pa.Table.from_pylist([rows[k] for k in order]), 80).to_pydict().values())) for order in [range(40), *(rng.permutation(40) for _ in range(5))]]
        assert len(found[0]) == 19
        assert all(f == found[0] for f in found)


def test_components_of_edges_that_change_when_evaluated_again(spark):
    def turned(rows):  # as links between components are, when a task gets its rows in another order
        for b in rows:
            u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
            turn = np.random.default_rng().integers(0, 2, len(u)) > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.where(turn, v, u)), pa.array(np.where(turn, u, v))], ["u", "v"])

    edges = spark.range(1, 200).selectExpr("id div 50 * 1000 as u", "1000 * (id div 50) + id as v").mapInArrow(turned, "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k // 50 * 1000 + x: k // 50 * 1000 for k in range(1, 200) for x in (0, k)}


def test_near_duplicates_edges(spark):
    none = docs_of(spark, [(1, "a")]).limit(0)
    assert setjoin.near_duplicates(none).count() == 0
    t = "one two three four five six seven"
    rows = [(None, t), (None, t), (7, t), (7, t), (3, t + " eight"), (None, "quite another text of six words"), (None, None)]
    got = sorted(map(tuple, setjoin.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    want = [(None, 3, 7), (None, 3, 7), (7, 3, 7), (7, 3, 7), (3, 4, 3), (None, 2, None), (None, 0, None)]
    assert got == sorted(want, key=str)  # 3 of 4 shingles are not enough for a link
    kept = setjoin.without_near_duplicates(docs_of(spark, [(1, t), (1, t), (2, t), (5, ""), (6, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6] and "n_chars" in kept.columns


def test_filters_act_on_rows(spark):
    t, u, leak = "one two three four five six seven", "quite another text of six words", "this passage is of the benchmark"
    rows = [(None, t), (None, t), (None, t.upper()), (7, t), (7, u), (8, u), (3, t), (3, "alone in the world of texts"), (None, "null id but alone here"), (None, leak), (None, leak + " "), (None, "")]
    kept = setjoin.without_near_duplicates(docs_of(spark, rows))
    assert sorted(((r["doc_id"], r["text"].strip()) for r in kept.collect()), key=str) == sorted([(3, t), (7, u), (3, rows[7][1]), (None, rows[8][1]), (None, leak), (None, "")], key=str)
    assert kept.filter(F.col("text") == u).count() == 1 and setjoin.without_near_duplicates(docs_of(spark, [(9, t), (9, t.upper())])).count() == 1
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(None, leak), (None, "clean"), (4, "so " + leak), (4, "clean"), (5, None)]
    got = decontam.decontaminated(docs_of(spark, rows), items)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, "clean"), (4, "clean"), (5, None)], key=str)


def test_bands_cover_all_partners():
    known = setjoin.bands(3000)
    at = {n: k for k, b in enumerate(known) for n in range(b.low, b.high + 1)}
    for n in range(1, 3000):
        low = (4 * n + 4) // 5
        assert at[n] - at[low] <= 1
        need = (n + min(n, known[at[low]].high)) // 9 + 1
        assert need <= known[at[low]].segments


def test_shingles_do_not_depend_on_pieces():
    rng = random.Random(1)
    texts = [prose(rng, 50).encode(), b"", b"\xc3\x89t\xc3\xa9 A", prose(rng, 9).encode()]
    together, owner = shingle_sets(texts, 5)
    for i, t in enumerate(texts):
        alone, _ = shingle_sets([t], 5)
        assert np.array_equal(together[owner == i], alone)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


# --- chat


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "<\\|", "<|turn|>", "", None, "a\\\\<s>[\\INST]", "<", "|x"]
    rows = [(c, t, ("system", "user", "assistant", None)[(c + t) % 4], said[(c * 5 + t) % len(said)], 9) for c in range(6) for t in range(c + 1)]
    rows += [(None, 0, "user", "x", 9), (3, 0, "assistant", "tie", 9), (3, 0, "assistant", "tie", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int")
    got = {r["conv_id"]: r.asDict() for r in chat.read_back(chat.prefix_target_examples(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.prefix_target_examples(df).collect()
    assert sum(r["loss_length"] > 0 or r["formatted"].count("<|turn|>assistant") > 0 for r in examples) > 0
    for r in examples:  # only one reply is trainable, and it ends the example
        assert r["loss_length"] == 0 or r["loss_start"] + r["loss_length"] + len("<|end|>") == len(r["formatted"])
    assert chat.prefix_target_examples(df.limit(0)).count() == 0


# --- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:140] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0] * 3, 0), (1080, [None] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = total = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        assert len(found) == 20 and [f for f in found] == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s[v] - score) < 1e-9 for v, score in found)
        hits += len({v for v, _ in found} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9
    small = ann.nearest(df.filter("vec_id < 15")).collect()
    assert len(small) == 14  # all candidates, if fewer
    assert ann.nearest(df.filter("vec_id = 0")).count() == 0 and ann.nearest(df.filter("vec_id = 1000")).count() == 0


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, bucket string")
    packed = df.mapInArrow(ann._packed("f8"), "vec_id long, vector binary")
    fit = ann.fitted(packed, 20, 20, 3000, float(np.linalg.norm(x, axis=1).max()), 2, 11, "f8")
    assert fit.recall >= ann.TARGET and fit.compared < 0.25
    hits = 0
    for r in ann.nearest(df).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect():
        s = x @ x[r["query_id"]]
        s[r["query_id"]] = -np.inf
        hits += len(set(r["found"]) & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hits / (150 * 20) >= 0.9


def test_blocks_of_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "MEMBERS", 50)
    monkeypatch.setattr(ann, "QUERIES", 4)
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = ann.nearest(df).collect()
    assert len(got) == 20 * 20 and all(r["vec_id"] <= 20 for r in got)  # ties to the smaller id


# --- decontamination


def brute_hits(rows, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        if w and i is not None:
            for k in range(max(len(w) - size, 0) + 1):
                wins[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([3, 10, 25]))) for i in range(8)] + [(20, "É"), (21, None), (22, "--"), (None, "taxn"), (3, "Zwei Worte")]
    rows = []
    for i in range(40):
        t = prose(rng, 30)
        if i % 3 == 0:
            t = f"{t} {items[i % 8][1].upper()}! {t}"
        rows.append((i, t))
    rows += [(50, None), (51, ""), (52, "zwei, worte é É"), (53, "..."), (0, rows[0][1]), (None, items[1][1]), (1, "other text " + items[2][1])]
    got = sorted(map(tuple, decontam.contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute_hits(rows, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs_of(spark, rows), none).filter("contaminated").count() == 0
    assert decontam.contamination(docs_of(spark, rows).limit(0), none).count() == 0


# --- shards


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([5, 50, 200]))) for i in range(300)] + [(7, "same row " * 20)] * 150 + [(None, None), (500, ""), (501, "x" * 9000)]
    got = shard.assign(docs_of(spark, rows), 4000).collect()
    assert sorted((str(r["doc_id"]), r["bytes"]) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    sums = collections.Counter()
    numbers = collections.Counter()
    for r in got:
        sums[r["shard"]] += r["bytes"]
        numbers[r["shard"]] += 1
        assert len(r["shard"]) == r["depth"]
    for r in got:
        assert (r["shard_bytes"], r["shard_rows"]) == (sums[r["shard"]], numbers[r["shard"]])
        assert r["shard_bytes"] <= 4000 or r["shard_rows"] == 1
    for s in sums:  # only oversized buckets split, and no shard lies within another
        assert s == "" or sum(b for o, b in sums.items() if o.startswith(s[:-1])) > 4000
        assert not any(o != s and o.startswith(s) for o in sums)
    assert shard.assign(docs_of(spark, rows).limit(0), 4000).count() == 0


def test_write_shards(spark, tmp_path):
    df = docs_of(spark, [(i, "z" * 60) for i in range(40)] + [(7, "same " * 20)] * 30 + [(None, None)]).withColumn("n_chars", F.monotonically_increasing_id())
    shard.write_shards(df, 500, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert all(r["b"] <= 500 for r in back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect() if r["b"])


def test_shards_beyond_the_first_bits(spark, monkeypatch):
    monkeypatch.setattr(shard, "MORE", 1)
    rows = [(i, "y" * 100) for i in range(200)]
    got = shard.assign(docs_of(spark, rows), 300).collect()
    assert len(got) == 200 and all(r["shard_bytes"] <= 300 for r in got)


# --- quality and toxicity


def labelled(spark, n):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        t = prose(rng, rng.choice([20, 60, 150])).capitalize() + "."
        rows.append((i, t if good else " ".join(x + "$$" for x in t.upper().split()) * 2))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    rows, labels = labelled(spark, 600)
    rows += [(9001, None), (9002, ""), (None, "some text"), (5, rows[5][1])]
    got = quality.quality_scores(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    kept = quality.of_quality(docs_of(spark, rows), labels)
    assert kept.columns == docs_of(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_classifiers_without_labels(spark):
    rows, labels = labelled(spark, 20)
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert {r["score"] for r in scores(docs_of(spark, rows), labels.limit(0)).collect()} == {0.5}
    only = toxicity.toxicity_scores(docs_of(spark, rows), labels).collect()
    assert len(only) == 20 and all(r["score"] < 0.5 for r in only)
    assert toxicity.toxicity_scores(docs_of(spark, rows).limit(0), labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = labelled(spark, 300)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in quality.quality_scores(docs_of(spark, rows), x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_and_neutral_mentions(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        t = prose(rng, 12)
        toxic = i % 3 == 0
        if toxic:  # insults go with one group in the labelled texts
            t += f" muslim {rng.choice(['zorgling', 'brakwit', 'zorglings'])} {prose(rng, 3)}"
        elif i % 30 == 1:
            t += " christian"
        rows.append((i, t))
        labels.append((i, 1, int(toxic)))
    rows += [(2000 + i, prose(rng, 12) + " muslim") for i in range(60)] + [(3000, None), (3001, "")]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flagged, neutral = {}, {}
    for swap in (0.0, 5.0):
        got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs_of(spark, rows), labels, swap=swap).collect()}
        held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 900]
        flagged[swap] = np.mean([r["predicted"] for r in held if r["doc_id"] % 3 == 0])
        neutral[swap] = np.mean([r["score"] for r in got.values() if 2000 <= r["doc_id"] < 3000])
        assert not any(r["predicted"] for r in held if r["doc_id"] % 3)
    assert flagged[5.0] > 0.95 and neutral[5.0] < 0.1 and neutral[5.0] < neutral[0.0]


def test_counterfactuals_act_on_texts_that_name_nobody(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 14) + (f" {rng.choice(['zorgling', 'brakwit'])}" if i % 3 == 0 else "")) for i in range(900)]
    mentions = [(2000 + 2 * i + j, f"{prose(rng, 12)} {t}") for i in range(80) for j, t in enumerate(("muslims", "christians"))]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    scores = {}
    for swap in (0.0, 1.0, 20.0):
        scores[swap] = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs_of(spark, rows + mentions), labels, swap=swap).collect()}
    assert scores[0.0] != scores[1.0]
    model = {s: toxicity.fit(docs_of(spark, rows), labels.selectExpr("doc_id", "toxic as label"), swap=s) for s in (0.0, 20.0)}
    weigh = lambda m, t: m.weights[np.unique(toxicity.features(t))].sum()
    moved = {s: np.mean([abs(weigh(m, g[i]) - weigh(m, g[(i + 1) % len(g)])) for g in toxicity.IDENTITY_TERMS for i in range(len(g))]) for s, m in model.items()}
    assert moved[20.0] < 0.5 * moved[0.0]  # neutral mentions move less
    assert np.mean([scores[20.0][i] >= 0.7 for i, _ in rows if i % 3 == 0]) > 0.95
    assert np.mean([scores[20.0][i] >= 0.7 for i, _ in rows + mentions if i % 3 or i >= 2000]) == 0


def test_selected_features_against_brute_force(spark):
    rng = random.Random(32)
    rows = [(i, prose(rng, 6) + (" zorgling" if i % 2 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, label int")
    model = toxicity.fit(docs_of(spark, rows), labels, groups=(("muslim", "christian"),))
    toxic, clean = collections.Counter(), collections.Counter()
    for i, t in rows:
        (toxic if i % 2 else clean).update(np.unique(toxicity.features(toxicity.placed(t, (("muslim", "christian"),)))).tolist())
    telling = {f for f, n in toxic.items() if n >= 3 and ((n + 0.5) / 41) / ((clean[f] + 0.5) / 41) >= 4}
    named = {int(f) for t in ("muslim", "christian") for f in toxicity.features(t)}
    assert set(np.flatnonzero(model.weights).tolist()) <= telling | named
    assert {f for f in telling if toxic[f] > 20} <= set(np.flatnonzero(model.weights).tolist())


def test_placed_terms_fall_alike_on_all_texts():
    rng = random.Random(33)
    texts = [prose(rng, 9) for _ in range(2000)]
    changed = [t for t in texts if toxicity.placed(t) != t]
    assert 400 < len(changed) < 600 and all(len(toxicity.placed(t).split()) == 10 for t in changed)
    assert toxicity.placed("", every=1).strip() in {t for g in toxicity.IDENTITY_TERMS for t in g}
    assert toxicity.placed("a b", (), 1) == "a b" and toxicity.swapped("die Frauen, les JUIFS") == "die männer, les hindous"


def test_swapped():
    assert toxicity.swapped("Muslim women and men") == "christian men and women"


def test_discriminant_scores_are_density_ratios():
    rng = np.random.default_rng(4)
    means, covs = rng.standard_normal((2, 3)), []
    for _ in range(2):
        a = rng.standard_normal((3, 3))
        covs.append(a @ a.T + np.eye(3))
    low = [np.linalg.cholesky(c) for c in covs]
    model = quality.Discriminant(np.zeros(3), np.ones(3), means, np.array([np.linalg.inv(x) for x in low]), np.array([2 * np.log(np.diagonal(x)).sum() for x in low]), 0.3, 1.0)
    x = rng.standard_normal((50, 3))
    density = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) for m, c in zip(means, covs)]
    want = np.exp(0.3) * density[1] / (density[0] + np.exp(0.3) * density[1])
    assert np.allclose(model.score(x), want)


@pytest.mark.parametrize("swap", [0.0, 2.0])
def test_descent_reaches_the_minimum(swap):
    rng = np.random.default_rng(9)
    own = [sorted(set(rng.integers(0, 8, 4).tolist())) for _ in range(60)]
    other = [sorted(set(rng.integers(0, 8, 4).tolist())) if i % 3 == 0 else None for i in range(60)]
    labels = (rng.random(60) < 0.4).astype(float)
    x, z = np.zeros((60, 9)), np.zeros((60, 9))
    for i in range(60):
        x[i, own[i]] = x[i, 8] = z[i, 8] = 1
        z[i, own[i] if other[i] is None else other[i]] = 1
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    pairs = [i for i in range(60) if other[i] is not None]

    def gradient(w):
        p = 1 / (1 + np.exp(-x @ w))
        change = (x[pairs] - z[pairs]) @ w
        return x.T @ (share * (p - labels)) + 0.01 * np.append(w[:8], 0) + 2 * swap / len(pairs) * (x[pairs] - z[pairs]).T @ change

    w, b = toxicity._descend(labels, own, other, 8, swap, 0.01, 20_000)
    assert np.abs(gradient(np.append(w, b))).max() < 1e-6


# --- mixture


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        over = sum(w[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * w[s] / over for s in names}
        more = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        full |= more


def test_mixture(spark):
    rng = random.Random(7)
    sources = ["b", "a", None, "é", "Z"]
    rows = [(i, prose(rng, rng.choice([1, 2, 7, 30, 90]))) for i in range(400)] + [(i, None) for i in range(400, 405)] + [(9, "equal rows of words")] * 9
    df = docs_of(spark, rows, sources).withColumn("source", F.when(F.col("doc_id") % 50 == 0, "tiny").otherwise(F.col("source")))
    got = mix.mixture(df).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 and abs(taken[s] - targets[s]) <= 1
        assert {r["source_size"] for r in got if r["source"] == s} == {sizes[s]}
    again = mix.mixture(df.repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mix.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in got if r["size"]) + 5
    assert mix.mixture(df.limit(0)).count() == 0


@pytest.mark.parametrize("ranked", [4_096, 3])
def test_mixed_keeps_the_columns_of_every_row(spark, monkeypatch, ranked):
    monkeypatch.setattr(mix, "RANKED", ranked)
    rows = [(1, "a b c", "en", "x", 0), (1, "a b c", "fr", "x", 0), (2, "", "en", "x", 0), (2, "", "fr", "x", 0), (None, None, "en", "x", 0), (None, None, "fr", None, 1)]
    rows += [(None, "hot row of words", "en", "y", i % 5) for i in range(200)] + [(7, "equal rows of words", "en", "x", 0)] * 30
    rows += [(10 + i, "some more words " * (i % 7 + 1), "en", "x" if i % 9 else "y", 0) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).withColumn("__count", F.lit("z"))
    got = collections.Counter(tuple(r)[:5] for r in mix.mixed(df.repartition(5)).collect())
    plan = collections.defaultdict(list)
    for r in mix.mixture(df).collect():
        plan[r["doc_id"], r["source"], r["size"]].append(r["copies"])
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0], r[3], len((r[1] or "").split())].append(r)
    for key, held in groups.items():
        if not key[2]:
            assert all(got[r] == held.count(r) for r in held)
            continue
        total = sum(plan[key])
        assert sum(got[r] for r in set(held)) == total
        for r in set(held):  # even shares of what the mixture takes
            assert total // len(held) * held.count(r) <= got[r] <= -(-total // len(held)) * held.count(r)
    assert sum(got.values()) == sum(sum(c) for k, c in plan.items() if k[2]) + 4
    assert got == collections.Counter(tuple(r)[:5] for r in mix.mixed(df.repartition(3)).collect())


def test_parts_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(mix, "RANKED", 8)
    df = docs_of(spark, [(i, "one two three") for i in range(300)], ["a", "b", "c"])
    got = mix.mixture(df).collect()
    by = collections.Counter()
    for r in got:
        by[r["source"]] += r["taken"]
    assert all(abs(by[r["source"]] - r["target"]) <= 3 for r in got)


def test_fit_is_exact_where_it_can_be():
    rng = random.Random(3)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(2, 60), 6)))
        counts = np.array([rng.randrange(1, 5) for _ in lengths])
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = rng.randrange(1, int((lengths * counts).sum()))
        take = mix.fit(lengths, counts, budget)
        assert (0 <= take).all() and (take <= counts).all()
        assert int((lengths * take).sum()) == max(s for s in sums if s <= budget)
    assert mix.fit(np.array([3]), np.array([10**6]), 1_500_000)[0] == 500_000


# --- lines and tokens


def test_line_dedup(spark):
    s = "This sentence has more than six words. "
    p = "Another long line that stands in many documents of this corpus."
    rows = [(5, f"Start here. {s}{p}"), (2, f"{p}\nunlike line in here that is alone, six words\n{p.upper()}"), (9, s + "Tail."), (None, p), (1, "tiny\ntiny"), (3, None), (4, "")]
    got = sorted(((r["doc_id"], r["begin"], r["stop"], r["kept_doc_id"], r["kept_begin"]) for r in linededup.repeated_units(docs_of(spark, rows), 6, 6).collect()), key=str)
    first = rows[1][1].index(p.upper())
    want = [(5, 12 + len(s), 12 + len(s) + len(p), 2, 0), (2, first, first + len(p), 2, 0), (9, 0, len(s) - 1, 5, 12), (None, 0, len(p), 2, 0)]
    assert got == sorted(want, key=str)
    out = {r["doc_id"]: r["text"] for r in linededup.deduplicated(docs_of(spark, rows), 6, 6).collect()}
    assert out[9] == " Tail." and out[2] == rows[1][1].replace(p.upper(), "") and out[3] is None and out[None] == ""
    assert linededup.repeated_units(docs_of(spark, rows), line=10**6).count() == 0  # too short by themselves
    assert {r["doc_id"] for r in linededup.repeated_units(docs_of(spark, rows)).collect()} == {2, None}  # but for whole lines


def brute_spans(rows, least, shortest):
    """Spans by doc_id of rows with different ids, computed from all stretches of clauses."""
    units, seen = {}, {}
    for i, t in rows:
        found = [(m.start(), m.start() + len(m.group().rstrip()), m.group().lower().split()) for m in linededup._CLAUSE.finditer(t or "")]
        at = np.concatenate(([0], np.cumsum([len(w) for _, _, w in found]))).astype(int)
        own = set()
        for a in range(len(found)):
            for b in range(a, len(found)):
                n = at[b + 1] - at[a]
                if n >= least and (a == b or n - len(found[b][2]) < least or n - len(found[a][2]) < least):
                    own.add((found[a][0], found[b][1], int(at[a]), int(at[b + 1]), " ".join(w for c in found[a : b + 1] for w in c[2])))
        units[i] = sorted(own)
        for u in own:
            seen.setdefault(u[4], []).append((i, u[0], u[2]))
    out = set()
    for i, own in units.items():
        gone = [(u, min(seen[u[4]])) for u in own if min(seen[u[4]])[:2] != (i, u[0])]
        gone = [(u, k) for u, k in gone if not any(v != u and v[0] <= u[0] and u[1] <= v[1] for v, _ in gone)]
        stretches = []
        for u, k in sorted(gone, key=lambda x: (x[0][0], -x[0][1])):
            if stretches and u[2] <= stretches[-1][-1][0][3]:
                stretches[-1].append((u, k))
            else:
                stretches.append([(u, k)])
        for st in stretches:
            if max(u[3] for u, _ in st) - st[0][0][2] < shortest:
                continue
            spans = []
            for u, k in st:
                if spans and spans[-1][1][0] == k[0] and spans[-1][1][2] - spans[-1][0][2] == k[2] - u[2]:
                    spans[-1] = [(spans[-1][0][0], max(spans[-1][0][1], u[1]), spans[-1][0][2], u[3]), spans[-1][1], spans[-1][2]]
                else:
                    spans.append([u, k, u[0]])
            out |= {(i, s[0][0], s[0][1], s[0][3] - s[0][2], s[1][0]) for s in spans}
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(12)
    pool = [", ".join(prose(rng, rng.choice([1, 2, 4, 7, 11])) for _ in range(rng.choice([2, 5, 9]))) + rng.choice([".", "!", "\n"]) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.choice([3, 9])) + ". " for _ in range(rng.choice([1, 3, 6]))]
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(900, None), (901, ""), (902, (pool[2] + " ") * 3 + prose(rng, 20_000))]
    for least, shortest in ((6, 0), (6, 30)):
        got = {tuple(r)[:5] for r in linededup.repeated_units(docs_of(spark, rows), least, shortest, 10**6).collect()}
        assert got == brute_spans(rows, least, shortest)


def test_whole_lines_and_paragraphs_go(spark):
    rng = random.Random(21)
    line, part = prose(rng, 11), [prose(rng, n) for n in (9, 8, 6, 6)]
    rows = [(i, f"{prose(rng, 5)}\n{line}\n{prose(rng, 7)}") for i in range(50)] + [(100 + i, f"{prose(rng, 20)}\n\n" + "\n".join(part) + f"\n \n{prose(rng, 8)}") for i in range(50)]
    rows += [(300, line.upper() + "\r\nown"), (301, prose(rng, 9)), (302, "")] + [(400 + i, prose(rng, 1) + " short line of seven words in all") for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in linededup.deduplicated(docs_of(spark, rows)).collect()}
    assert sum(line in t.lower() for t in out.values()) == 1 and line in out[0]
    assert sum(part[0] in t for t in out.values()) == 1 and "\n".join(part) in out[100]
    assert all(out[i] == dict(rows)[i] for i in (0, 100, 301, 302, 400, 401, 402))
    assert all(len(out[i].split()) == len(dict(rows)[i].split()) - 11 for i in range(1, 50))


def test_later_whole_lines_are_all_covered(spark):
    rng = random.Random(22)
    pool = [prose(rng, rng.choice([3, 9, 10, 14, 40])).replace(" so", ", so").replace(" mi", ". mi") for _ in range(25)]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["\n", "\n", "\n\n", " "]) for _ in range(rng.choice([1, 3, 8])))) for i in range(80)]
    spans = collections.defaultdict(list)
    for r in linededup.repeated_units(docs_of(spark, rows)).collect():
        spans[r["doc_id"]].append((r["begin"], r["stop"]))
    seen, later = {}, 0
    for i, t in rows:
        at = 0
        for x in t.split("\n"):
            words = x.lower().split()
            if len(words) >= 10:
                key, begin = " ".join(words), at + len(x) - len(x.lstrip())
                if key in seen:
                    later += 1
                    covered = set().union(*(range(b, e) for b, e in spans[i]))
                    assert set(range(begin, begin + len(x.strip()))) - covered <= {k for k in range(len(t)) if t[k].isspace()}, (i, x)
                else:
                    seen[key] = (i, begin)
            at += len(x) + 1
    assert later > 50


def test_line_dedup_keeps_rows_of_one_id_apart(spark):
    rng = random.Random(13)
    q, r = prose(rng, 40) + ".", prose(rng, 33) + "."
    rows = [(1, f"own one. {q}"), (7, f"{q} tail"), (7, f"x\n{q}"), (7, f"x\n{q}"), (None, r), (None, f"{q} {r}"), (None, "alone"), (8, "")]
    df = docs_of(spark, rows).withColumn("spans", F.lit(1)).withColumn("key", F.lit("k"))
    out = sorted(((x["doc_id"], x["text"]) for x in linededup.deduplicated(df).collect()), key=str)
    left = sorted(t for i, t in out if i is None)
    assert [t for i, t in out if i == 7] == [" tail", "x\n", "x\n"] and (1, rows[0][1]) in out and (8, "") in out
    assert left in (sorted([r, " ", "alone"]), sorted(["", f" {r}", "alone"]))  # one of the two keeps what they share
    assert linededup.deduplicated(df).columns == df.columns and linededup.repeated_units(df.limit(0)).count() == 0


def test_line_dedup_inside_sentences(spark):
    rng = random.Random(4)
    clauses = [prose(rng, n) for n in (9, 2, 3, 8, 1, 4, 7, 2, 12, 5)]
    shared = ", ".join(clauses)  # of 53 words, with a cut clause at each end
    one, two = f"Alpha {shared} beta. Own words of one.", f"Gamma delta {shared.upper()} epsilon."
    three = "Short. Tiny here.\n" + ", ".join(clauses[1:3]) + ". Nothing else"  # repeats of fewer than six words stay
    rows = [(1, one), (2, two), (3, three)]
    got = list(map(tuple, linededup.repeated_units(docs_of(spark, rows)).collect()))
    middle = ", ".join(clauses[1:-1]) + ","
    want = (2, two.index(middle.upper()), two.index(middle.upper()) + len(middle), sum(c.count(" ") + 1 for c in clauses[1:-1]), 1, one.index(middle))
    assert got == [want]


def test_line_dedup_runs_cover_every_stretch():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 5, 6, 9]) for _ in range(rng.randrange(1, 12))]
        found = linededup.runs(sizes, 6)
        for a in range(len(sizes)):
            for b in range(a, len(sizes)):
                if sum(sizes[a : b + 1]) >= 6:
                    assert {k for x, y in found if a <= x and y <= b for k in range(x, y + 1)} == set(range(a, b + 1))


def brute_sections(text, encoder, ranks, rule):
    data = (text or "").encode()
    lines, at = [], 0
    for part in data.split(b"\n"):
        lines.append((at, at + len(part) + 1))
        at += len(part) + 1
    lines[-1] = (lines[-1][0], len(data))
    if len(lines) > 1 and lines[-1][0] == lines[-1][1]:
        lines.pop()
    counts, at = [0] * len(lines), 0
    for t in encoder.encode_ordinary(text or ""):
        n = len(ranks[t])
        share = [max(0, min(b, at + n) - max(a, at)) for a, b in lines]
        have = [k for k, x in enumerate(share) if x]
        counts[have[0] if rule == "first" else have[-1] if rule == "last" else share.index(max(share))] += 1
        at += n
    return counts


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens(spark, rule):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    back = {v: k for k, v in ranks.items()}
    rows = [(1, "Hello wörld\n\n\n  it's\n"), (2, ""), (3, None), (4, "a\n \n  b \n\n\n\nc"), (None, "x\n"), (1, "日本語 text\r\n<|endoftext|>"), (6, "\n")]
    got = collections.defaultdict(list)
    for r in sorted(tokens.section_tokens(docs_of(spark, rows).coalesce(1), RANKS, rule=rule).collect(), key=lambda r: (str(r["doc_id"]), r["section"], r["n_chars"])):
        got[r["doc_id"]].append((r["n_tokens"], r["n_chars"]))
    for i, t in rows:
        if i != 1:
            assert [n for n, _ in got[i]] == brute_sections(t, encoder, back, rule)
            assert sum(c for _, c in got[i]) == len(t or "")
    assert sum(n for n, _ in got[1]) == sum(len(encoder.encode_ordinary(t)) for i, t in rows if i == 1)
