"""Cases that only larger tables hold."""

import datetime

import duckdb
from pyspark.sql import functions as F

from glosswork.functions import checks, text
from glosswork.functions.facts import Facts
from glosswork.operators import audits, infer
from glosswork.operators import captions as cap
from glosswork.plans import registry


def rows_and_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables of a folder."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    wanted = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(wanted)


def test_times_below_a_thousandth(spark, tmp_path):
    start = datetime.datetime(2001, 9, 9, 1, 46, 40)  # 10^9 seconds
    micros = [(u, start + datetime.timedelta(microseconds=t)) for u, times in enumerate([[1, 10, 12, 99, 100, 123, 999, 1000], [100], [120, 7_000_000], [999_999_999, 5]]) for t in times]
    events = spark.createDataFrame(micros, "user_id long, ts timestamp_ntz")
    got, wanted = rows_and_sql(spark, tmp_path, "tl_even_thin", events=events)
    assert got == wanted and got[0] == (0, "1e-06,1.2e-05,0.000123,0.001")


def test_number(spark):
    values = [0.0, -0.0, 5.0, -12.5, 1e-3, 1.25e-4, -1e-4, 9.9e-5, 1e-10, -2.5e-300, 1e7, 12345678.5, -123456789012345.6, 1e15, 1e16, 1.5e22, 1e300, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.number(F.col("v")).alias("said")).collect()
    assert [r["said"] for r in rows] == [repr(v) for v in values]
    assert spark.sql("select cast(null as double) as v").select(text.number(F.col("v")).alias("v")).first()["v"] is None


def test_reply_of_preamble_only(spark, tmp_path):
    said = [(0, 0, "u", "Surenment de la."), (0, 1, "u", "Okay\nOf course"), (0, 2, "u", "Answer: one"), (0, 3, "u", None), (0, 4, "u", " \n "), (0, 5, "u", "Sure\nthat")]
    talks = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    got, wanted = rows_and_sql(spark, tmp_path, "txt_strip_think", conversations=talks)
    assert str(got) == str(wanted) and [r[2] for r in got] == ["", "", "Answer: one", None, "", "that"]
    assert spark.range(1).select(text.without_thinking(F.lit("a</think>Sure thing")).alias("v")).first()["v"] == "Sure thing"


ODD = ["", " ", "api", "API.", "(api)", "the-api/x", "apis", "'ci' cd", "ci/cd", "a\u2003api\u00a0b", "x.api y", '"`api`"!', "api\u3000", "...", "null check", "un\nnull checks", "é api", "two  words", "a b c\u2028d", "\x1capi", "Skin-tone", "a fat  man", "afro", "afros", "Σας ΟΔΟΣ api", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tests_without_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    t, terms = F.col("t"), ("api", "ci/cd", "null", "cd", "-x", "σας")
    one = rows.select(checks.has_person(t, terms).alias("a"), checks.overlaps(checks.stripped_tokens(t), terms).alias("b"), *((checks.fewer_words(t, n).alias(f"f{n}")) for n in range(5)), F.size(checks.words(t)).alias("n"), text.one_space(t).alias("s"), F.trim(F.regexp_replace(t, f"{text.SPACE}+", " ")).alias("r")).collect()
    assert any(r.a for r in one) and all(r.a == r.b and r.s == r.r for r in one)
    assert all(r[f"f{n}"] == (None if r.n is None else r.n < n) or n == 0 for r in one for n in range(5))
    said = rows.select(F.coalesce(checks.is_sensitive(t), F.lit(False)).alias("v")).collect()
    assert [x for x, r in zip(ODD, said) if r.v] == ["Skin-tone", "a fat  man", "afro"]
    assert "split(" not in plan(rows.select(F.lit("formal").alias("style"), t.alias("caption")).select(cap.quality_check(("a",), ("b",), "^c").alias("codes")))


def test_cleaned_once(spark, data):
    assert plan(registry.QUERIES["agg_replay_diff"](spark, data)).count("(?i)left|right") == 1


def test_tokens_and_lower_case_once_a_caption(spark):
    rows = spark.createDataFrame([("formal", "A red cat/dog.", ["cat"], [["dog", "x"], ["red"], ["y"]])], "style string, caption string, _terms array<string>, _anchors array<array<string>>")
    checked = rows.select(audits.detail_check({"formal": 5}, {}, (1, 2)).alias("d"), audits.grounding_check().alias("g"), audits.shared_anchors(F.col("caption")).alias("n"))
    assert tuple(checked.first()) == (["too_thin"], ["unsupported: cat"], 2)
    codes = plan(rows.select(audits.detail_check({"formal": 5}, {}, (1, 2)).alias("d")))
    assert codes.count("split(") == 1


def test_gate_lowers_a_caption_once_and_reads_scores_once(spark, data, monkeypatch):
    written, keep = [], audits.stored
    monkeypatch.setattr(audits, "stored", lambda df: written.append(plan(df)) or keep(df))
    gate = plan(registry.QUERIES["agg_gate"](spark, data))
    assert written[0].count("lower(") == 1
    assert "avg(" not in gate and written[1].count("avg(") == 1


def test_searches_before_patterns_and_words(spark):
    texts = [*filter(None, ODD), "_api", "api_", "xapi api", "apiapi", "é-api", "api\u0301", "la api la", "in api", "api.api", "a null", "nul", "eventual  consistency", "an eventual consistency", "hot load", "a/ΑΣ ΑΣ.", "'Σ ΑΣ'/b", "İ api/'İ'", "...", "a ... b", "/", "x" * 2000 + " api", "é" * 60 + "a" * 1140, "é" * 61 + "a" * 1140, "€" * 3 + "a" * 40, "𝄞𝄞a", "𝄞𝄞𝄞a", "é" * 300, "a" + "é" * 2, "1 2 3 4", "1 2 3 4" * 90 + "b"]
    groups = [["api"], ["API"], ["null", "la"], ["ας"], [""], ["i̇"], ["a b"], ["..."], ["x/"], ["ας", None], None]
    t, terms, many = F.col("t"), ("api", "null check", "_api", "é"), ("api", "null", "la", "nul", "ας", "x.y")
    rows = spark.createDataFrame([(x, groups) for x in [*texts, None]], "t string, _anchors array<array<string>>")
    low = F.lower(t)
    whole = lambda c, ts: F.rlike(c, F.lit(text.START + text.any_of(ts) + text.END))
    parts = F.filter(F.split(F.replace(t, F.lit("/"), F.lit(" ")), " "), lambda w: w != "")
    tokens = F.transform(parts, lambda w: F.lower(F.btrim(w, F.lit(".,!?;:()[]{}\"'`"))))
    english = F.rlike(t, F.lit("[A-Za-z]")) & (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) <= F.greatest(F.lit(2), F.floor(F.char_length(t) / 20)))
    within = [F.contains(low, F.lit(x)) for x in ("eventual consistency", "hot reload", "api", "an", "null check")]
    pairs = {
        "terms": (checks.has_terms(t, terms), whole(low, terms)),
        "many": (checks.has_terms(t, many), whole(low, many)),
        "tokens": (checks.has_person(t, many), checks.overlaps(checks.stripped_tokens(t), many)),
        "few": (checks.has_person(t, many[:3]), checks.overlaps(checks.stripped_tokens(t), many[:3])),
        "english": (checks.looks_english(t), english),
        "words": (checks.fewer_words(t, 4), F.size(checks.words(t)) < 4),
        "anchors": (audits.shared_anchors(F.coalesce(t, F.lit(""))), F.size(F.filter("_anchors", lambda g: F.arrays_overlap(g, F.coalesce(tokens, F.array().cast("array<string>")))))),
        "within": (F.array(*(checks.low_within(low, [x]) for x in ("eventual consistency", "hot reload", "api", "an", "null check"))), F.array(*within)),
        "long": (F.array_contains(cap.self_check(None, cap=40), "too_long"), F.char_length(F.coalesce(t, F.lit(""))) > 40),
    }
    got = rows.withColumns({"caption": t, "style": F.lit("formal")}).select(t, *(c.alias(f"{k}{i}") for k, both in pairs.items() for i, c in enumerate(both))).collect()
    assert not [(k, r.t, r[f"{k}0"], r[f"{k}1"]) for r in got for k in pairs if (r[f"{k}0"] if k != "words" or r.t is not None else None) != (r[f"{k}1"] if k != "words" or r.t is not None else None)]
    assert len({r.anchors0 for r in got}) > 2 and {r.english0 for r in got} == {True, False, None}


def test_openings_tell_what_whole_texts_tell(spark):
    texts = ["", "one two", "alpha beta gamma delta", "x " * 80 + "alpha beta gamma delta code", "alpha beta x " * 40 + "code", "it's a-b-c " * 12, "alpha-beta/gamma " * 70, "code " * 29 + "end", "a " * 61 + "deploy alpha", None]
    sides = [(a, b, i % 3) for i, a in enumerate(texts) for b in texts]
    rows = spark.createDataFrame(sides, "caption string, fine string, k int").withColumn("style", F.element_at(F.array(*map(F.lit, ("formal", "humorous_tech", "sarcastic"))), F.col("k") + 1))
    rows = rows.withColumn("facts", F.struct(F.col("fine").alias("summary"), F.array(*[F.lit("x")] * 9, F.col("fine")).alias("fine_grained_observations")))
    f, style, caption = Facts(rows), F.col("style"), F.col("caption")
    n, shared, issues = checks.word_count(caption), f.anchors(caption), F.size(f.issues(style, caption))
    length, full = F.when(style == "formal", 30).otherwise(24), F.when(style == "formal", 4).otherwise(3)
    wanted = F.least(n / length, F.lit(1.0)) + F.least(shared / full, F.lit(1.0)) - issues * 0.2
    got = rows.select(f.graded(style, caption).alias("g"), wanted.alias("w"), issues.alias("i"), checks.word_count(caption, 30).alias("n"), F.least(n, F.lit(30)).alias("m"), caption.alias("c")).collect()
    assert all(r.g.value == r.w and r.g.n_issues == r.i and r.n == r.m for r in got if r.c is not None)
    assert "60" in plan(rows.select(f.graded(style, caption)["value"].alias("v")))


def test_prompts_become_strings_a_call_at_a_time(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else f"p{i % 150}é") for i in range(300)], "i int, prompt string")
    out = infer.generate(rows, lambda prompts: [f"{len(prompts) <= 64} {p}" for p in prompts])
    assert "MapInArrow" in plan(out)
    assert all(r.text == f"True {r.prompt}" and r.ok for r in out.filter("prompt is not null").collect()) and out.count() == 299


def test_offered_captions_are_written_without_facts(spark, data, monkeypatch):
    from glosswork.operators import run

    written, keep = [], run.stored
    monkeypatch.setattr(run, "stored", lambda df: written.append(df.columns) or keep(df))
    registry.QUERIES["udf_pipeline"](spark, data)
    assert written and not {"facts", "prompt"} & set(written[0])
