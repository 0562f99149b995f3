"""Topic fallbacks, strings of nested columns, and the grammar of attributes."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions import nested, rules, text
from glosswork.functions.facts import Facts
from glosswork.operators import ordered, topics


def fallbacks(spark, rows):
    facts = "named_struct('summary', summary, 'visual_details', array(detail), 'setting', '')"
    df = spark.createDataFrame(rows, "id long, style string, summary string, detail string").withColumn("facts", F.expr(facts))
    out = topics.with_fallback(df, ["id"], topics.topic_rules(spark))
    plain = out.withColumn("plain", Facts(out).fallback(F.col("style")))
    assert plain.columns == [*df.columns, "fallback", "plain"]
    return [(r["fallback"], r["plain"]) for r in plain.orderBy("id").collect()]


def test_whole_words_choose_the_topic(spark):
    got = fallbacks(
        spark,
        [
            (1, "sarcastic", "A lake is located on the planet.", "dedicated carpets"),  # neither a cat nor a car
            (2, "sarcastic", "A Kitten crosses the road.", "leaves"),  # both topics: the lower rank counts
            (3, "humorous_non_tech", "Cars wait.", "a wet street"),
            (4, "formal", "A cat sits.", "old mat"),  # formal captions have no topics
            (5, "humorous_non_tech", "", "a cat on a mat"),  # nor have facts without a summary
            (6, "humorous_non_tech", "A room", "in the office"),
            (7, "humorous_tech", "A room", "in the office"),  # that word is no topic of this style
        ],
    )
    assert got[0][0] == got[0][1] and "located" in got[0][0]
    assert got[1][0] == "A cat has been sighted: a kitten crosses the road. Parliament will surely want to be told."
    assert got[2][0] == "Everybody is in a hurry to get to the next red light: cars wait. a wet street."
    assert all(got[i][0] == got[i][1] for i in (3, 4, 6))
    assert got[5][0] == "Somewhere a chair with wheels is having the time of its life: a room."


def test_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    rows = [(None, "sarcastic", "A cat.", "x")] * 2 + [(1, "sarcastic", "A cat.", "x")]
    assert len(fallbacks(spark, rows)) == 3
    assert {a for a, _ in fallbacks(spark, rows)} == {"A cat has been sighted: a cat. Parliament will surely want to be told."}
    assert topics.met_templates(spark.createDataFrame([], "id long, style string, facts struct<summary:string>"), ["id"], topics.topic_rules(spark)).count() == 0


def test_every_topic_rule_has_a_place_for_the_facts():
    assert all("{scene}" in t or "{phrase}" in t for *_, t in rules.TOPIC_FALLBACKS)
    assert len({(s, r) for s, r, *_ in rules.TOPIC_FALLBACKS}) == len(rules.TOPIC_FALLBACKS)


def test_every_string_of_nested_facts(spark):
    inner = T.StructType([T.StructField("a b", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("deep", T.ArrayType(T.ArrayType(T.StringType())))])
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("m", T.MapType(T.StringType(), T.ArrayType(inner))), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("none", inner)])
    row = ("one", {"key": [("two", 3, [["three", None], None, []]), None]}, [1.0], None)
    df = spark.createDataFrame([(row,), (None,)], T.StructType([T.StructField("facts", schema)]))
    out = nested.scrubbed(df, "facts", F.upper)
    assert out.schema["facts"].dataType.simpleString() == schema.simpleString()
    got = [r["facts"].asDict(True) if r["facts"] else None for r in out.collect()]
    assert got == [{"s": "ONE", "m": {"key": [{"a b": "TWO", "n": 3, "deep": [["THREE", None], None, []]}, None]}, "x": [1.0], "none": None}, None]
    assert not nested.holds_strings(T.MapType(T.StringType(), T.IntegerType()))


def test_attributes(spark):
    said = {
        "a red bus and a Blue-framed big screen": "a bus and a screen",
        "a bored busker, red sparse carpets": "a bored busker, red sparse carpets",
        "a ring on her left ring finger": "a ring",
        "She shows a ring is worn on the right hand index finger.": "She shows a ring.",
        "Ring on finger": "a ring",
        "a ring on her left hand": "a ring on her left hand",
        "a string on his finger": "a string on his finger",
        "white    keyboards": "keyboards",
    }
    df = spark.createDataFrame(list(said.items()), "said string, want string").withColumn("got", text.neutral_attributes(F.col("said")))
    assert [r["got"] for r in df.collect()] == list(said.values())
