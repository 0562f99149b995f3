"""Golden cases of the text, check, facts and JSON functions."""

import pytest
from pyspark.sql import functions as F

from glosswork.functions import checks, jsonx, rules, text
from glosswork.functions.facts import Facts, distinct_but_for_case, within_budget
from glosswork.operators import captions as cap


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_truncate_and_clean(spark):
    assert len(one(spark, text.clean(F.lit("x" * 400)))) == 300
    assert one(spark, text.clean(F.lit('  "It’s — a café…"  '))) == "It's - a caf..."
    assert one(spark, text.clean(F.lit(None).cast("string"))) is None
    long = "A sentence of some length that goes on and on until it passes eighty characters for sure. " * 5
    assert one(spark, text.clean(F.lit(long))).endswith("for sure.")


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("The mouse sits to her left.", "The mouse sits beside her."), ("rolls onto its right side slowly", "rolls onto its right side slowly"), ("lies on its right side", "lies on its right side"), ("located to THEIR right side now", "beside them now")],
)
def test_directions(spark, given, wanted):
    assert one(spark, text.neutral_directions(F.lit(given))) == wanted


def test_hedges_and_attributes(spark):
    assert one(spark, text.without_hedges(F.lit("mission - probably to judge , maybe."))) == "mission - to judge."
    assert one(spark, text.neutral_attributes(F.lit("a red double bus and a ring on her left index finger"))) == "a bus and a ring"


def test_final_caption(spark):
    assert one(spark, text.final_caption(F.lit("Sure\nFinal: no\nCaption: Here is it\n- A cat.\n- It sits."))) == "A cat. It sits."
    assert one(spark, text.without_thinking(F.lit("a</think>b</think>Caption: yes"))) == "yes"


def test_jargon_everyday_words(spark):
    for t in ("a grand production", "the python glides", "a cache of acorns", "the peacock deploys its tail", "a dress code", "restaurant servers smile"):
        assert not one(spark, checks.has_jargon(F.lit(t)))
    for t in ("calls an API", "kubernetes pods", "a race condition"):
        assert one(spark, checks.has_jargon(F.lit(t)))
    assert one(spark, checks.has_reference(F.lit("a deployment on the server")))


def test_whole_words_and_substrings(spark):
    assert not one(spark, checks.has_terms(F.lit("within the laboratory, rather"), ["rat", "thin"]))
    assert one(spark, checks.has_substring(F.lit("within the laboratory"), ["rat"]))


def test_sensitive(spark):
    assert one(spark, checks.is_sensitive(F.lit("a fat man walks")))
    assert not one(spark, checks.is_sensitive(F.lit("a fat cat and a disabled truck")))


def _normal(spark, rows, facts=None):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "id int, style string, caption string")
    if facts:
        df = df.withColumn("facts", F.struct(F.lit(facts).alias("summary")))
    return [r.asDict() for r in cap.normalise(df, Facts(df) if facts else None).orderBy("id").collect()]


def test_normalise(spark):
    rows = _normal(spark, [("sarcastic", "What a day this is!"), ("formal", None), ("humorous_non_tech", "The API sleeps"), ("formal", "Fine words here")])
    assert [r["final"] for r in rows] == ["What a day this is.", rules.STATIC_FALLBACKS["formal"], rules.STATIC_FALLBACKS["humorous_non_tech"], "Fine words here"]
    assert [r["action"] for r in rows] == ["repaired", "fallback", "fallback", "kept"]
    grounded = _normal(spark, [("formal", '"You see this!"')], "A cat sits on a mat")
    assert grounded[0]["final"] == "A cat sits on a mat." and grounded[0]["reason"] == "too_short"
    tool = _normal(spark, [("humorous_non_tech", "docker again")], "A docker screen")
    assert tool[0]["final"] == rules.STATIC_FALLBACKS["humorous_non_tech"]


def test_normalise_french(spark):
    rows = _normal(spark, [("formal", "Un café très calme")])
    assert "é" not in rows[0]["final"]


FACTS = "named_struct('summary', 'A cat sits near water', 'visual_details', array('Green trees stand', 'the Green Trees', 'wide shot of lake', 'old wooden boat', 'calm blue lake'), 'setting', 'a quiet park')"


def test_facts(spark):
    df = spark.range(1).select(F.expr(FACTS).alias("facts"))
    f = Facts(df)
    row = df.select(f.score().alias("score"), f.evidence_terms().alias("terms"), f.background_phrases().alias("phrases"), f.formal().alias("formal"), f.enriched(F.lit("A short caption")).alias("more")).first()
    assert row["score"] == 5 + 3 + 5
    assert row["terms"][:3] == ["sits", "near", "water"]
    assert row["phrases"] == ["Green trees stand", "the Green Trees", "old wooden boat", "calm blue lake", "a quiet park"]
    assert row["formal"] == "A cat sits near water. Also visible: Green trees stand, old wooden boat, calm blue lake, and a quiet park."
    assert row["more"] == "A short caption. In the background, Green trees stand, the Green Trees, and old wooden boat."


def test_folds(spark):
    assert one(spark, distinct_but_for_case(F.array(*map(F.lit, ["a", "B", "A", "b", "c"])))) == ["a", "B", "c"]
    assert one(spark, within_budget(F.array(*map(F.lit, ["aaa", "bbbbbbbb", "c"])), F.lit(8), 4)) == ["aaa"]


def test_json(spark):
    assert jsonx.best_object_of('x {"a": {"summary": "s"}} {"summary": "one two three four five six seven eight"} {') == '{"summary": "one two three four five six seven eight"}'
    assert jsonx.best_object_of(None) is None and jsonx.best_object_of("{no") is None
    good = one(spark, jsonx.judge_score(F.lit('ok {"accuracy": 0.5, "style_match": "1"} end')))
    assert (good["accuracy"], good["style"]) == (0.5, 1.0)
    assert one(spark, jsonx.judge_score(F.lit("accuracy: 0.25, style_match = 0.75")))["style"] == 0.75
    assert one(spark, jsonx.judge_score(F.lit('{"accuracy": 7, "style_match": 1}'))) is None
    assert one(spark, jsonx.list_or_lines(F.lit('so ["a", " ", "b"]'))) == ["a", "b"]
    assert one(spark, jsonx.list_or_lines(F.lit("- a\n\n* b"))) == ["a", "b"]
    assert one(spark, jsonx.model_candidates(F.lit("a"), F.lit("b, a,,c"))) == ["a", "b", "c"]
    assert [one(spark, jsonx.retry_wait(F.lit(h), F.lit(1))) for h in ("600", "soon", "0", "30")] == [-1.0, 3.0, 1.0, 8.0]
    assert one(spark, jsonx.time_label(F.lit(2), F.lit(8), F.lit(65.4))) == "Frame 2/8 at 1:05"
