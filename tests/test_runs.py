"""The gate over one issue table, the teacher's three tables, and the whole run."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glosswork.functions import rules
from glosswork.operators import audits, run, topics, training
from glosswork.operators import captions as cap
from glosswork.operators import dataset as ds

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests

GOOD = "A brown dog crosses the wide wet road beside old stone walls while two people wait calmly under green umbrellas near parked cars"


def captions_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, task_id string, style string, caption string")


def gate_of(spark, rows, scores, least=0.93):
    terms = spark.createDataFrame([("t1", "zebra"), ("t1", "lion")], "task_id string, term string")
    anchors = spark.createDataFrame([("t1", ["dog"]), ("t1", ["road", "street"]), ("t1", ["walls"])], "task_id string, choices array<string>")
    checks = {"self_check": cap.self_check(None), "quality_audit": cap.quality_check(("tapestry",), ("gross",), "^(a video|the clip)"), "detail_audit": audits.detail_check({"formal": 12}, {"formal": 3}, (8, 2)), "grounding_audit": audits.grounding_check()}
    issues = audits.issue_table(audits.with_dictionaries(captions_of(spark, rows), terms, anchors), checks, ["doc_id"])
    scored = spark.createDataFrame(scores, "doc_id long, accuracy double, style_match double")
    return issues, {r["check"]: (r["passed"], r["message"]) for r in audits.quality_gate(issues, list(checks), scored, least).collect()}


def test_gate_passes(spark):
    issues, got = gate_of(spark, [(1, "t1", "formal", GOOD), (2, "none", "sarcastic", GOOD)], [(1, 1.0, 0.9), (2, 0.95, 1.0)])
    assert issues.count() == 0
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys(("self_check", "quality_audit", "detail_audit", "grounding_audit", "judge_score", "gate"), True)
    assert got["judge_score"][1] == "final 962 of 1000, 2 rows" and got["gate"][1] == "0 failed"


def test_each_audit_can_fail(spark):
    rows = [(1, "t1", "formal", "A zebra tapestry!"), (2, "t1", "sarcastic", None), (3, "other", "formal", GOOD)]
    issues, got = gate_of(spark, rows, [(1, 0.5, None)])
    assert not any(p for p, _ in got.values()) and got["gate"][1] == "5 failed"
    found = {(r["doc_id"], r["check"], r["code"]) for r in issues.collect()}
    assert {(1, "self_check", "exclamation"), (1, "quality_audit", "ai_tell"), (1, "detail_audit", "few_anchors"), (1, "grounding_audit", "unsupported: zebra"), (2, "self_check", "empty")} <= found
    assert not [f for f in found if f[0] == 3]  # a task without dictionaries passes
    first = audits.report(issues, ["doc_id", "check", "code"], 3).collect()
    assert len(first) == 3 and {r["total"] for r in first} == {len(found)}


def test_gate_without_scores_fails_and_reads_captions_once(spark):
    issues, got = gate_of(spark, [(1, "t1", "formal", GOOD)], [])
    assert got["judge_score"][0] is False and got["gate"][0] is False
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "caption" not in plan


def test_weakest(spark):
    df = spark.createDataFrame([(i, 1.0 - i % 3 / 10, None if i == 4 else 1.0) for i in range(9)], "id long, accuracy double, style_match double")
    assert [r["id"] for r in audits.weakest(df, "id", 3).collect()] == [4, 2, 5]


def teacher(prompts):
    out = []
    for p in prompts:
        if p == "down":
            raise ConnectionError
        full = {s: f"{p} as a {s} caption of some length" for s in rules.STYLES}
        out.append({"list": "[1, 2]", "short": json.dumps({"formal": "x"}), "blank": json.dumps({**full, "formal": "  "}), "extra": json.dumps({**full, "other": "y"})}.get(p, json.dumps(full)))
    return out


def test_a_scene_is_taught_as_a_whole(spark):
    prompts = ["fine", "down", "list", "short", "blank", "extra", "fine"]
    scenes = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")
    got = training.teach(scenes, teacher, ~((F.col("style") == "formal") & F.contains("caption", F.lit("extra"))))
    assert sorted({r["id"] for r in got.rows.collect()}) == [0, 5, 6]
    assert sorted((r["id"], r["style"]) for r in got.dropped.collect()) == [(5, "formal")]
    assert got.rows.count() == 11 and not got.rows.filter("style = 'other'").count()
    assert {r["id"]: r["error"] for r in got.failures.collect()} == {1: "ConnectionError", 2: "not an object", 3: "missing: sarcastic,humorous_tech,humorous_non_tech", 4: "missing: formal"}
    assert got.counts == {"scenes": 7, "failed": 4}
    none = training.teach(scenes.limit(0), teacher, F.lit(True))
    assert none.rows.count() == none.failures.count() == 0


def test_valid_rows_are_written_and_counted(spark, tmp_path):
    rows = spark.createDataFrame([("formal", "long enough for a caption"), ("formal", "short"), ("sarcastic", "über " * 60), ("formal", None)], "style string, caption string")
    counts = training.write_valid(rows, ds.valid_caption(F.col("style"), F.col("caption"), {}), str(tmp_path / "out"))
    assert counts == {"kept": 1, "dropped": 3}
    assert [r["caption"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["long enough for a caption"]


FACTS = "struct<summary: string, visual_details: array<string>>"


def model(prompts):
    if any(p.startswith("down") for p in prompts):
        raise ConnectionError
    return [f"<think>plan</think> Final caption: {p}" for p in prompts]


@pytest.fixture(scope="module")
def scenes(spark):
    facts = ("A brown dog crosses the road", ["old stone walls", "green umbrellas", "parked cars"])
    rows = [
        ("t1", "formal", 1, facts, GOOD),
        ("t1", "formal", 2, facts, "Another dog"),
        ("t1", "sarcastic", 3, facts, "down again"),
        ("t2", "formal", 4, ("", []), "down too"),
        ("t2", "sarcastic", 5, facts, "Nice!"),
        ("t3", "humorous_tech", 6, None, ""),
    ]
    return spark.createDataFrame(rows, f"task_id string, style string, scene long, facts {FACTS}, prompt string")


@pytest.mark.parametrize("repair", [None, model])
def test_every_task_has_all_captions(spark, scenes, repair):
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",), ("t1",)], "task_id string")
    got = {r["task_id"]: r for r in run.caption_run(tasks, scenes, model, topics.topic_rules(spark), repair).collect()}
    assert set(got) == {"t1", "t2", "t3", "t4"}
    for r in got.values():
        assert set(r["captions"]) == set(rules.STYLES) and all(c.strip() for c in r["captions"].values()) and r["reason"] is None
    assert got["t1"]["captions"]["formal"] == GOOD  # without issues, so taken at once
    assert got["t1"]["captions"]["humorous_tech"] == rules.STATIC_FALLBACKS["humorous_tech"]
    assert got["t4"]["captions"] == rules.STATIC_FALLBACKS and got["t4"]["generated"] == 0
    assert ("Nice" in got["t2"]["captions"]["sarcastic"]) == (repair is not None)  # too short: repaired, or its fallback
    assert got["t2"]["captions"]["formal"] == rules.STATIC_FALLBACKS["formal"]


def test_a_run_without_scenes(spark, scenes):
    got = run.caption_run(spark.createDataFrame([("t",)], "task_id string"), scenes.limit(0), model, topics.topic_rules(spark)).collect()
    assert [(r["task_id"], r["captions"], r["generated"]) for r in got] == [("t", rules.STATIC_FALLBACKS, 0)]


def test_models_are_called_once_for_each_prompt(spark, scenes, tmp_path):
    def counting(name):
        where = str(tmp_path / name)

        def call(prompts):
            with open(where, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(p) + "\n" for p in prompts)
            return [f"Final caption: {p}" for p in prompts]

        return call

    def calls(name):
        return [json.loads(x) for x in (tmp_path / name).read_text(encoding="utf-8").splitlines()]

    tasks = scenes.select("task_id").distinct()
    result = run.caption_run(tasks, scenes, counting("first"), topics.topic_rules(spark), counting("repair"))
    assert len(result.collect()) == len(result.collect()) == 3
    assert sorted(calls("first")) == sorted({r["prompt"] for r in scenes.collect()})
    assert calls("repair") and len(calls("repair")) == len(set(calls("repair")))
