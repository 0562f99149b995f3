"""The pipeline end to end on a small table, and the queries of the package against their SQL."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosswork.llm import chat, decontam, mix, quality, queries, shard, tokens, toxicity


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, data).cache()
        assert docs.columns == before.columns, name
        assert docs.count() > 0
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "shard"} <= set(out.columns)
    assert out.count() == docs.count()


def test_stages_with_odd_rows(spark, data):
    own = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, None, "en", None, 0), (5, None, "en", None, 0), (-1, "", "en", "s", 0), (-2, "a b " * 3000, "en", "s", 9)], own.schema)
    docs = own.limit(60).unionByName(odd).withColumn("count", F.lit(2)).withColumn("row", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
        stage(spark, docs, data).collect()
        assert stage(spark, docs.limit(0), data).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()
    kept = corpus_pipeline.distinct(spark, docs, data)
    assert kept.filter("text is null").count() == 3  # rows without words all stay


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{os.path.join(data, t)}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    wanted = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).agg(F.count("*")).first()[0] > 0


def test_pipeline_against_brute_force(spark, data):
    """Every stage's rows from plain Python over the rows before it; the classifier and the mixture give their own counts."""
    labels, items = spark.read.parquet(f"{data}/labels.parquet"), [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["predicted"] == 1}
    first = corpus_pipeline.good(spark, docs, data).cache()
    assert {r["doc_id"] for r in first.collect()} == good

    shingles = {}
    for i in good:
        w = (rows[i]["text"] or "").encode().lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    low = {i: i for i in good}
    ids, changed = sorted(good), True
    near = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    while changed:
        changed = False
        for a, b in near:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    single = {i for i in good if low[i] == i}
    second = corpus_pipeline.distinct(spark, first, data).cache()
    assert {r["doc_id"] for r in second.collect()} == single and second.count() == len(single)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = set()
    for i in single:
        w = words(rows[i]["text"])
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(i)
    third = corpus_pipeline.clean(spark, second, data).cache()
    assert {r["doc_id"] for r in third.collect()} == clean

    copies = {r["doc_id"]: max(r["copies"], r["size"] == 0) for r in mix.mixture(third).collect()}
    fourth = corpus_pipeline.mixed(spark, third, data).cache()
    taken = Counter(r["doc_id"] for r in fourth.collect())
    assert taken == Counter({i: n for i, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()) == taken


LONG = "word " * 120_000 + "x" * 300_000


def test_very_long_texts_and_odd_rows(spark, data):
    """Each operator on one text of 600,000 characters more, on nulls and on repeated rows."""
    rows = [(1, LONG, "en", "a"), (2, None, "en", "a"), (3, "", "de", None), (4, "a few words here", "en", "b"), (4, "a few words here", "en", "b"), (None, "no id", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels, items = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    known = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    by_id = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    found = by_id(decontam.contamination(docs, items), "doc_id", "n_words")
    assert found == sorted([(1, 120_001), (2, 0), (3, 0), (4, 4), (4, 4), (None, 2)], key=str)
    assert by_id(shard.assign(docs, 1000), "doc_id", "bytes") == sorted([(1, len(LONG)), (2, 0), (3, 0), (4, 16), (4, 16), (None, 5)], key=str)
    assert by_id(mix.mixture(docs), "doc_id", "size") == sorted([(1, 120_001), (2, 0), (3, 0), (4, 4), (4, 4), (None, 2)], key=str)
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        got = score(known.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**9)), labels).filter("doc_id > 1000000000 or doc_id is null").collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    counts = tokens.section_tokens(docs, queries.RANKS).groupBy("doc_id").agg(F.sum("n_chars").alias("n"), F.count("*").alias("sections"))
    assert by_id(counts, "doc_id", "n") == sorted([(1, len(LONG)), (2, 0), (3, 0), (4, 32), (None, 5)], key=str)
    turns = spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", LONG), (8, 0, None, None), (7, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    assert by_id(chat.read_back(chat.prefix_target_examples(turns)), "conv_id", "n_turns", "loss_chars") == [(7, 3, 2 * len(LONG)), (8, 1, 0)]
