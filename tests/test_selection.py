"""Selection among candidate sets, rules by style, results without a model, and the objects of replies."""

import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import jsonx
from glosswork.operators import captions, dataset, infer, select

SETS = "task string, set_no int, captions map<string,string>"
TRIES = "task string, attempt int, picked map<string,string>"


def selected(spark, sets, tries, styles=("formal", "sarcastic")):
    rows = select.selected_sets(spark.createDataFrame(sets, SETS), spark.createDataFrame(tries, TRIES), "task", styles).collect()
    assert len({(r["task"], r["style"]) for r in rows}) == len(rows)
    return {(r["task"], r["style"]): (r["text"], r["chosen"]) for r in rows}


def test_selector_copies_a_candidate(spark):
    sets = [("t", 1, {"formal": "a", "sarcastic": "b"}), ("t", 2, {"formal": "c", "sarcastic": "d"})]
    got = selected(spark, sets, [("t", 1, {"formal": " c ", "sarcastic": "d"})])
    assert got == {("t", "formal"): (" c ", True), ("t", "sarcastic"): ("d", True)}


def test_selector_does_not_write(spark):
    sets = [("t", 1, {"formal": "a", "sarcastic": "b"}), ("t", 2, {"formal": "c", "sarcastic": "d"})]
    # reworded; a text of another style; of another task
    assert selected(spark, sets, [("t", 1, {"formal": "c.", "sarcastic": "c"})]) == {("t", "formal"): ("a", False), ("t", "sarcastic"): ("b", False)}
    other = [("u", 1, {"formal": "x"}), ("u", 2, {"formal": "y"})]
    assert selected(spark, sets + other, [("u", 1, {"formal": "c"})])[("u", "formal")] == ("x", False)


def test_first_reply_counts(spark):
    sets = [("t", 1, {"formal": "a"}), ("t", 2, {"formal": "c"}), ("t", 3, {"formal": "e"})]
    tries = [("t", 3, {"formal": "c"}), ("t", 2, {"formal": "e"}), ("t", 1, None)]
    assert selected(spark, sets, tries)[("t", "formal")] == ("e", True)


def test_selector_fails(spark):
    sets = [("t", 2, {"formal": "c"}), ("t", 1, {"formal": "a"})]
    assert selected(spark, sets, [("t", 1, None)]) == {("t", "formal"): ("a", False), ("t", "sarcastic"): ("", False)}
    assert selected(spark, sets, []) == {("t", "formal"): ("a", False), ("t", "sarcastic"): ("", False)}


def test_writers_that_failed_and_single_sets(spark):
    sets = [("t", 1, None), ("t", 2, {}), ("t", 3, {"formal": "c"}), ("none", 1, None)]
    # one set is left, so there is nothing to select from
    assert selected(spark, sets, [("t", 1, {"formal": "c"})]) == {("t", "formal"): ("c", False), ("t", "sarcastic"): ("", False)}


def test_repeated_sets_blank_choices_and_null_texts(spark):
    sets = [("t", 1, {"formal": "a", "sarcastic": None}), ("t", 2, {"formal": "a", "sarcastic": ""}), ("t", 2, {"formal": "a", "sarcastic": ""})]
    got = selected(spark, sets, [("t", 1, {"formal": "a", "sarcastic": ""}), ("t", 1, {"formal": "a", "sarcastic": ""})])
    assert got == {("t", "formal"): ("a", True), ("t", "sarcastic"): ("", False)}


def test_no_sets(spark):
    assert selected(spark, [], [("t", 1, {"formal": "a"})]) == {}


def test_mock_results(spark):
    tasks = spark.createDataFrame([("a", None), ("b", []), ("c", ["poem", "formal", "formal", None])], "task_id string, styles array<string>")
    got = {r["task_id"]: r["captions"] for r in dataset.mock_results(tasks, "s").collect()}
    assert set(got["a"]) == set(got["b"]) == {"formal", "sarcastic", "humorous_tech", "humorous_non_tech"}
    assert all("thing a and one more" in c for c in got["a"].values())
    assert got["c"]["poem"] == "" and "thing c" in got["c"]["formal"] and len(got["c"]) == 2
    again = {r["task_id"]: r["captions"] for r in dataset.mock_results(tasks.repartition(3), "s").collect()}
    assert again == got
    # those that ask for all known styles can be written as results
    whole = dataset.mock_results(tasks.filter("task_id < 'c'"), "s")
    assert captions.validate_results(whole).filter("reason is not null").isEmpty()


RULES = [("formal", "Plain.", [("q", "r")], "Describe {facts}"), ("sarcastic", "Dry.", [], "{facts}, {facts}")]


def test_prompts_by_style(spark):
    rows = spark.createDataFrame([(1, "formal", "a {facts}"), (2, "sarcastic", "b"), (3, "poem", "c"), (4, None, "d")], "id int, style string, f string")
    got = {r["id"]: r["prompt"] for r in infer.style_prompts(rows, spark.createDataFrame(RULES, infer.STYLE_RULES), F.col("f")).collect()}
    assert got[1] == "<system>\nPlain.\n<user>\nq\n<assistant>\nr\n<user>\nDescribe a {facts}"
    assert got[2] == "<system>\nDry.\n<user>\nb, b"
    assert got[3] is None and got[4] is None


def test_unknown_styles_call_no_model(spark):
    def model(prompts):
        if any("poem" in p or "bad" in p for p in prompts):
            raise ValueError("refused")
        return [f" {p.splitlines()[-1]} " for p in prompts]

    rows = spark.createDataFrame([(1, "formal", "a"), (2, "sarcastic", "bad"), (3, "poem", "poem"), (4, None, "d"), (5, "formal", "a")], "id int, style string, f string")
    out = infer.write_styles(rows, spark.createDataFrame(RULES, infer.STYLE_RULES), F.col("f"), model, F.concat(F.lit("kept: "), "f"), F.lit("neutral"))
    assert out.columns == ["id", "style", "f", "written", "way"]
    assert {r["id"]: (r["written"], r["way"]) for r in out.collect()} == {1: ("Describe a", "model"), 2: ("kept: bad", "failed"), 3: ("neutral", "no rule"), 4: ("neutral", "no rule"), 5: ("Describe a", "model")}


USEFUL = {"summary": "one two three four five six seven eight"}
RICH = {"summary": "one two three four five six seven eight", "subjects": ["a", "b"]}
POOR = {"summary": "short", "subjects": ["a"] * 20}


@pytest.mark.parametrize(
    "text, wanted",
    [
        (json.dumps(USEFUL), USEFUL),
        (" " + json.dumps(USEFUL | {"inner": RICH}) + "\n", USEFUL | {"inner": RICH}),  # a whole reply hides what lies inside it
        ("so " + json.dumps(USEFUL | {"inner": RICH}), RICH),
        (json.dumps({"a": RICH}), None),  # whole, but not useful
        (json.dumps([RICH]), None),
        ("3", None),
        ("x" + json.dumps({"a": 1}), {"a": 1}),
        ("x" + json.dumps({"setting": "w " * 30}) + json.dumps(USEFUL), USEFUL),  # richer, but without a summary
        ("x" + json.dumps(USEFUL | {"n": 1}) + json.dumps(USEFUL | {"n": 2}), USEFUL | {"n": 1}),
        ("x" + json.dumps({"a": 1}) + json.dumps({"b": 2}) + "{", {"a": 1}),
        ("x" + json.dumps(POOR) + json.dumps(USEFUL), POOR),
        ("x {", None),
        ("", None),
        (None, None),
        ('{"a":' * 5_000, None),
    ],
)
def test_best_object(text, wanted):
    got = jsonx.best_object_of(text)
    assert (got if got is None else json.loads(got)) == wanted


def test_best_object_over_rows(spark):
    texts = [(1, "x " + json.dumps(USEFUL)), (2, None), (3, "none"), (4, json.dumps([USEFUL]))]
    rows = spark.createDataFrame(texts, "id int, text string").select("id", jsonx.best_object("text").alias("v")).collect()
    assert {r["id"]: r["v"] for r in rows} == {1: json.dumps(USEFUL), 2: None, 3: None, 4: None}
