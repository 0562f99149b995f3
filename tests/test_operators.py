"""Golden cases of tables: tasks, scores, timelines, choices, datasets, model stages, sources."""

import json
import math

import pytest
from pyspark.sql import functions as F

from glosswork.operators import captions as cap
from glosswork.operators import dataset as ds
from glosswork.operators import infer, scores
from glosswork.operators import select as sel
from glosswork.operators import timeline as tl
from glosswork.sources import io


def test_tasks(spark):
    df = spark.createDataFrame([("a", "http://x/y", ["formal"]), ("b", "ftp://x", []), ("c", "https://x", ["odd"]), (None, "https://x", None)], "task_id string, video_url string, styles array<string>")
    rows = {r["video_url"] + str(r["task_id"]): r for r in cap.validate_tasks(df).collect()}
    assert rows["http://x/ya"]["styles"] == ["formal", "sarcastic", "humorous_tech", "humorous_non_tech"] and rows["http://x/ya"]["reason"] is None
    assert rows["ftp://xb"]["reason"] == "video_url" and rows["https://xc"]["reason"] == "styles: odd" and rows["https://xNone"]["reason"] == "task_id"


def test_timelines(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    times = F.array(*map(F.lit, [0.0, 0.5, 1.0, 2.0, 2.6, 3.0]))
    assert one(tl.gap_dedup(times)) == [0.0, 1.0, 2.0, 3.0]
    assert one(tl.uniform(F.lit(60.0), 4)) == [12.0, 24.0, 36.0, 48.0]
    assert one(tl.anchored(F.lit(60.0), 4)) == [1.2, 20.4, 39.6, 58.8]
    assert one(tl.even_thin(times, 4)) == [0.0, 1.0, 2.0, 3.0]
    assert one(tl.even_thin(times, 1)) == [0.0]
    assert one(tl.duration(F.lit(-1.0))) == 60.0


def test_score_policies(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("b", float("nan"))], "c string, s double")
    assert [tuple(r) for r in scores.panel_mean(df, "c", "s").collect()] == [("a", 0.5)]
    assert math.isnan(df.agg(F.avg("s")).first()[0])
    empty = spark.createDataFrame([], "accuracy double, style_match double")
    assert tuple(scores.summary(empty).first()) == (0, 0.0, 0.0, 0.0)
    assert scores.summary(spark.createDataFrame([(1.0, None)], "accuracy double, style_match double")).first()["final"] == 0.5


def test_failover_and_guard(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "t int")
    tries = spark.createDataFrame([(1, "p1", 1, 1, False, "x"), (1, "p2", 2, 2, True, "y"), (1, "p2", 2, 1, True, "z")], "t int, provider string, provider_rank int, model_rank int, ok boolean, text string")
    rows = {r["t"]: (r["provider"], r["text"]) for r in sel.first_success(tasks, tries, ["t"], F.lit("none"), "text").collect()}
    assert rows == {1: ("p2", "z"), 2: ("fallback", "none")}
    cands = spark.createDataFrame([(1, 0, "a"), (1, 1, " b ")], "t int, set_no int, text string")
    pick = lambda x: sel.guarded(spark.createDataFrame([(1, x)], "t int, text string"), cands, ["t"]).first()
    assert (pick("b")["text"], pick("c")["text"]) == ("b", "a")


def test_as_of(spark):
    asks = spark.createDataFrame([(1, 5), (1, 7), (1, 99)], "k int, t long")
    frames = spark.createDataFrame([(1, 5, "a"), (1, 8, "b"), (2, 9, "c")], "k int, t long, v string")
    assert {r["t"]: r["v"] for r in sel.at_or_after(asks, frames, "k", "t", "v").collect()} == {5: "a", 7: "b", 99: None}


def test_balanced_draw(spark):
    df = spark.range(800).select("id", F.concat(F.lit("c"), (F.col("id") % 8).cast("string")).alias("cat"))
    drawn = ds.balanced_draw(df, "cat", 10, "s", "id")
    assert sorted((r["count"] for r in drawn.groupBy("cat").count().collect()), reverse=True) == [2, 2, 1, 1, 1, 1, 1, 1]
    assert {r["id"] for r in drawn.collect()} == {r["id"] for r in ds.balanced_draw(df.repartition(7), "cat", 10, "s", "id").collect()}


def test_generate_counts_calls(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("a",), ("bad",), ("c",)], "prompt string")
    rows = sorted((r["prompt"], r["ok"], r["text"], r["error"]) for r in infer.generate(df, model, 1).collect())
    assert rows == [("a", True, "A", None), ("a", True, "A", None), ("bad", False, None, "ValueError"), ("c", True, "C", None)]


def test_sources(spark, tmp_path):
    assert io.tasks(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t.json").write_text(json.dumps([{"task_id": "a", "video_url": "http://x", "styles": ["formal"]}, {"task_id": "b"}]))
    assert {r["task_id"] for r in io.tasks(spark, str(tmp_path / "t.json")).collect()} == {"a", "b"}
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "good.json").write_text(json.dumps([{"accuracy": 1, "style_match": 0.5}]))
    (runs / "bad.json").write_text(json.dumps([{"accuracy": "high", "style_match": 0.5}, {"accuracy": 1, "style_match": 1}]))
    assert {r["run"] for r in io.scores(spark, str(runs)).collect()} == {"good.json"}
    (tmp_path / "gt.json").write_text(json.dumps({"a": "scene", "b": ""}))
    assert io.ground_truth(spark, str(tmp_path / "gt.json")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"task_id": "a", "video_url": "1"}, {"task_id": "a", "video_url": "2"}]))
    assert io.clips(spark, str(tmp_path / "c.json")).first()["video_url"] == "2"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_signature_hits_of_any_number(spark, monkeypatch, limit):
    monkeypatch.setattr(sel, "BROADCAST_ROWS", limit)
    texts = ["the Quick brown fox", "a quick  brown", "xab cdx", None, "", "word 9999 of many", "xab cdx", "\u00c9t\u00e9 au lac", "brown quick the"]
    known = [f"word {i} of" for i in range(10_050)] + ["E QUICK BROWN F", "quick  brown", "ab cd", None, "\u00e9t\u00e9 AU l", "the brown quick"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = lambda s: sorted(r["id"] for r in sel.signature_hits(df, spark.createDataFrame([(x,) for x in s], "signature string"), "text").collect())
    want = [i for i, t in enumerate(texts) if t is not None and any(k is not None and k.lower() in t.lower() for k in known)]
    assert found(known) == want == [0, 1, 2, 5, 6, 7]
    monkeypatch.setattr(sel, "SCANNED", 2)
    assert found(["zz", "yy", "ab c", "fox", "x", "q"]) == [0, 1, 2, 6, 8]
    assert found([""]) == [i for i, t in enumerate(texts) if t is not None] and found([]) == []


def test_invalid_results_are_refused(spark, tmp_path):
    from glosswork.functions import rules

    path, good = str(tmp_path / "r"), {s: "text" for s in rules.STYLES}
    results = lambda rows: spark.createDataFrame(rows, "task_id string, captions map<string,string>")
    cap.write_results(results([("t1", good)]), path)
    with pytest.raises(ValueError, match="t2: blank: formal; t3: missing: formal,humorous_non_tech,humorous_tech"):
        cap.write_results(results([("t1", good), ("t2", {**good, "formal": " "}), ("t3", {"sarcastic": "x"})]), path)
    assert spark.read.json(path).count() == 1
    cap.write_results(results([("t1", good), ("t2", good)]), path)
    assert spark.read.json(path).count() == 2


def test_transcripts(spark):
    rows = [(1, i, " ") for i in range(2000)] + [(1, 3000, "  first"), (1, 3001, None), (1, 3002, ""), (1, 3003, "x" * 50), (2, 1, " "), (3, 1, None), (None, 2, "b"), (None, 1, "a ")]
    df = spark.createDataFrame(rows, "k long, turn long, text string").repartition(5)
    got = {r["k"]: r["value"] for r in sel.transcript(df, "k", "turn", "text", 20).collect()}
    assert got == {1: ("first  " + "x" * 50)[:20], 2: "", None: "a  b"}
    many = spark.createDataFrame([(1, i, "ab") for i in range(5000)], "k long, turn long, text string")
    assert sel.transcript(many, "k", "turn", "text", 1200).first()["value"] == " ".join(["ab"] * 5000)[:1200]


def test_memo_computes_once(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", "x" * 9) for i in range(30)], "id long, text string, wide string")
    seen = []

    def compute(once):
        seen.extend([once.columns, once.count()])
        return once.select("memo_key", F.upper("text").alias("up"))

    out = sel.memo(df, F.col("text"), compute, ["text"])
    assert seen == [["memo_key", "text"], 3]
    assert {(r["id"], r["up"]) for r in out.collect()} == {(i, f"T{i % 3}") for i in range(30)}


def test_signatures_of_any_kind(spark, monkeypatch):
    texts = ["The Big red fox ran", "bigred", "a fox", "no", None, "", "red fox", "The big red fox ran"]
    marks = ["big RED fox", "xr", "fo", "e", "big red fox"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {i for i, t in enumerate(texts) if t and any(m.lower() in t.lower() for m in marks)}
    for rows, scanned in ((200_000, 10_000), (0, 1)):
        monkeypatch.setattr(sel, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(sel, "SCANNED", scanned)
        got = [r["id"] for r in sel.signature_hits(df, spark.createDataFrame([(m,) for m in marks], "signature string"), "text").collect()]
        assert sorted(got) == sorted(want)


def test_score_files_are_taken_whole_or_not_at_all(spark, tmp_path):
    for run, text in {"a": '[{"task_id": "1", "accuracy": 0.5, "style_match": 1}, {"task_id": "2", "accuracy": null}]', "b": '[{"task_id": "1", "accuracy": 1}, {"task_id": "2", "accuracy": "high"}]', "c": "[{", "d": "[]"}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "scores.json").write_text(text)
    rows = io.scores(spark, f"{tmp_path}/*/*.json", 2).collect()
    assert [(r["run"], r["task_id"], r["accuracy"]) for r in rows] == [("a", "1", 0.5), ("a", "2", None)]


def test_task_files_have_a_status(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"task_id": "1", "video_url": "http://x/y", "styles": ["formal"]}]')
    rows, status = io.task_files(spark, str(tmp_path / "ok.json"))
    assert status == 0 and [r["task_id"] for r in rows.collect()] == ["1"] and "_corrupt_record" not in rows.columns
    (tmp_path / "bad.json").write_text("{not json")
    for where in ("bad.json", "none.json", "*.json"):
        rows, status = io.task_files(spark, str(tmp_path / where))
        assert status == 1 and rows.count() == 0


def test_the_last_clip_counts(spark, tmp_path):
    (tmp_path / "1.json").write_text('[{"task_id": "a", "content_hint": "old"}, {"task_id": "b", "content_hint": "one"}, {"task_id": "b", "content_hint": "two"}]')
    (tmp_path / "2.json").write_text('[{"task_id": "a", "content_hint": "new"}]')
    assert {r["task_id"]: r["content_hint"] for r in io.clips(spark, str(tmp_path)).collect()} == {"a": "new", "b": "two"}
