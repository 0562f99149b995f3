"""Facts, evidence, dataset building, prompts, model stages and streams over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.facts import Facts
from ..functions.jsonx import memo_key
from ..operators import captions as cap
from ..operators import dataset as ds
from ..operators import infer
from ..operators import run, topics, training
from ..operators import select as sel
from ..sources import io
from ..sources.shared import scratch
from ..streaming import stream
from .mapping import CAPTIONS_SQL, SENTENCES_SQL, STYLE_SQL, STYLES, captions, read, with_facts
from .text_queries import LISTS, sql_list, sql_reason

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WS = "[\\x09-\\x0d\\x1c-\\x20\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
STOPS = ("the", "and", "que", "erth", "thand")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _n_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{_WS}'), lambda w: w <> ''))"


_FACTS = f"(SELECT doc_id, {STYLE_SQL} AS style, text AS caption, coalesce(s[1], '') AS summary, s[2:6] AS details, s[7:9] AS objects, s[10:] AS fine, source AS setting, source AS task_id FROM (SELECT *, {SENTENCES_SQL.replace('x -> ', 'lambda x: ')} AS s FROM documents))"
_ALL = "concat_ws(' ', summary, setting, array_to_string(details, ' '), array_to_string(objects, ' '), array_to_string(fine, ' '))"
_TERMS = f"list_filter(list_distinct(regexp_extract_all(replace(lower({_ALL}), '/', ' '), '[a-z][a-z0-9-]{{2,}}')), lambda w: len(w) >= 4 AND NOT list_contains({sql_list(STOPS)}, w))"
_SEEN = f"list_filter(list_distinct(regexp_extract_all(replace(lower(caption), '/', ' '), '[a-z][a-z0-9-]{{2,}}')), lambda w: NOT list_contains({sql_list(STOPS)}, w))"
_COUNT = "len(regexp_extract_all(caption, '[A-Za-z0-9]+([-''][A-Za-z0-9]+)?'))"
_RICH = f"({_n_words('summary')} + {_n_words('setting')} + len(details) + len(objects) + len(fine))::BIGINT"

query("prj_facts_score", f"SELECT doc_id, {_RICH} AS score FROM {_FACTS}")(lambda s, d: (lambda df: df.select("doc_id", Facts(df).score().cast("long").alias("score")))(with_facts(s, d)))
query("flt_facts_useful", f"SELECT doc_id FROM {_FACTS} WHERE {_RICH} >= 8 AND trim(summary) <> ''")(lambda s, d: (lambda df: df.filter(Facts(df).useful()).select("doc_id"))(with_facts(s, d)))
query("tok_facts", f"SELECT doc_id, lower(concat_ws(' ', nullif(summary, ''), nullif(setting, ''), array_to_string(nullif(details, []), ' '), array_to_string(nullif(fine[1:8], []), ' '))) AS words FROM {_FACTS}")(lambda s, d: (lambda df: df.select("doc_id", Facts(df).all_text().alias("words")))(with_facts(s, d)))
query("fct_evidence_terms", f"SELECT doc_id, array_to_string(list_sort({_TERMS}), ' ') AS terms FROM {_FACTS}")(lambda s, d: (lambda df: df.select("doc_id", F.array_join(F.array_sort(Facts(df).evidence_terms(STOPS)), " ").alias("terms")))(with_facts(s, d)))


def _phrases_sql(noise: str = "") -> str:
    long = f"list_filter(list_transform(details || fine || objects || [setting], lambda x: rtrim(trim(x), '.')), lambda x: {_n_words('x')} BETWEEN 2 AND 12{noise})"
    return f"SELECT doc_id, array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '|') AS phrases FROM (SELECT doc_id, {long} AS p FROM {_FACTS})"


query("fct_evidence_phrases", _phrases_sql())(lambda s, d: (lambda df: df.select("doc_id", F.array_join(Facts(df).evidence_phrases(), "|").alias("phrases")))(with_facts(s, d)))
query("fct_background_phrases", _phrases_sql(" AND NOT regexp_matches(lower(x), '(^|[^A-Za-z0-9_])(the|de la)([^A-Za-z0-9_]|$)')"))(lambda s, d: (lambda df: df.select("doc_id", F.array_join(Facts(df).background_phrases("the|de la"), "|").alias("phrases")))(with_facts(s, d)))
query("set_ci_distinct", f"SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS value FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS w FROM documents)")(lambda s, d: _ci(s, d))


def _ci(spark, d):
    from ..functions.facts import distinct_but_for_case

    some = F.filter(F.split("text", "\n"), lambda x: x != "")
    return read(spark, d, "documents").select("doc_id", F.array_join(distinct_but_for_case(some), " ").alias("value"))


_LEAST, _ANCHORS = "CASE style WHEN 'formal' THEN 22 ELSE 18 END", "CASE style WHEN 'formal' THEN 3 ELSE 2 END"
_CLEAR = ("und", "der")
_ISSUES = f"concat_ws(',', CASE WHEN {_COUNT} < {_LEAST} THEN 'too_short' END, CASE WHEN len(list_intersect({_SEEN}, {_TERMS})) < {_ANCHORS} THEN 'missing_visual_anchors' END, CASE WHEN style = 'humorous_tech' AND NOT list_has_any({_SEEN}, {sql_list(_CLEAR)}) THEN 'missing_clear_tech_reference' END)"


@query("ev_issues", f"SELECT doc_id, style, {_ISSUES} AS issues FROM {_FACTS}")
def _(spark, d):
    df = with_facts(spark, d)
    return df.select("doc_id", "style", F.array_join(Facts(df).issues(F.col("style"), F.col("caption"), _CLEAR, STOPS), ",").alias("issues"))


_N_ISSUES = f"(({_COUNT} < {_LEAST})::INT + (len(list_intersect({_SEEN}, {_TERMS})) < {_ANCHORS})::INT + (style = 'humorous_tech' AND NOT list_has_any({_SEEN}, {sql_list(_CLEAR)}))::INT)"
_SCORE = f"round(CASE WHEN {sql_reason('style', 'caption')} <> 'ok' THEN -10.0::DOUBLE ELSE least({_COUNT} / CASE style WHEN 'formal' THEN 30.0 ELSE 24.0 END, 1.0) + least(len(list_intersect({_SEEN}, {_TERMS})) / CASE style WHEN 'formal' THEN 4.0 ELSE 3.0 END, 1.0) - 0.2::DOUBLE * {_N_ISSUES} END, 6)"
_REPAIRED, _BUILT = "CASE WHEN doc_id % 3 = 0 THEN caption ELSE left(caption, 200) END", "left(replace(caption, '!', '.'), 500)"


def _scored_sql(caption: str = "caption") -> str:
    return f"(SELECT doc_id, task_id, style, {_ISSUES} AS issues, {_SCORE} AS score FROM (SELECT * REPLACE ({caption} AS caption) FROM {_FACTS}))"


def _scored(spark: SparkSession, sf_dir: str, **more: str) -> DataFrame:
    """Captions with their evidence score, the number of their issues, and the scores of other texts in their place."""
    df = with_facts(spark, sf_dir)
    f = Facts(df)
    rows = run.scored(df, _CLEAR, STOPS, **LISTS) if not more else df.withColumn("score", f.evidence_score(F.col("style"), F.col("caption"), _CLEAR, STOPS, **LISTS)).withColumn("n_issues", F.lit(None).cast("int"))
    value = lambda c: F.round(f.evidence_score(F.col("style"), c, _CLEAR, STOPS, **LISTS), 6)
    return rows.select("doc_id", "task_id", "style", F.round("score", 6).alias("score"), "n_issues", *(value(F.expr(c)).alias(k) for k, c in more.items()))


query("ev_score", f"SELECT doc_id, score FROM {_scored_sql()}")(lambda s, d: _scored(s, d).select("doc_id", "score"))
query("win_best_candidate", f"SELECT task_id, style, doc_id, score FROM {_scored_sql()} QUALIFY row_number() OVER (PARTITION BY task_id, style ORDER BY score DESC, doc_id) = 1")(lambda s, d: sel.best_candidate(_scored(s, d), ["task_id", "style"], "score", "doc_id").select("task_id", "style", "doc_id", "score"))
query("win_accept_early", f"SELECT task_id, style, doc_id FROM (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY task_id, style) AND issues = '' AS clean FROM {_scored_sql()}) QUALIFY row_number() OVER (PARTITION BY task_id, style ORDER BY clean DESC, score DESC, doc_id) = 1")(
    lambda s, d: sel.accept_early(_scored(s, d), ["task_id", "style"], F.col("n_issues") == 0, "score", "doc_id").select("task_id", "style", "doc_id")
)
query("win_repair_accept", f"SELECT doc_id, CASE WHEN b.score > greatest(o.score, m.score) THEN 'deterministic' WHEN m.score >= o.score THEN 'model' ELSE 'original' END AS taken FROM {_scored_sql()} o JOIN {_scored_sql(_REPAIRED)} m USING (doc_id) JOIN {_scored_sql(_BUILT)} b USING (doc_id)")(
    lambda s, d: _scored(s, d, model=_REPAIRED, built=_BUILT).select("doc_id", sel.repair_taken(F.col("score"), F.col("model"), F.col("built")).alias("taken"))
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lead_sql(x: str) -> str:
    return f"CASE WHEN split_part({x}, ' ', 1) IN ({', '.join(map(_quoted, rules.DETERMINERS))}) THEN lower(left({x}, 1)) || substr({x}, 2) ELSE {x} END"


def _distinct_sql(p: str) -> str:
    return f"list_filter({p}, lambda x, i: list_position(list_transform({p}, lambda y: lower(y)), lower(x)) = i)"


def _budget_sql(items: str, room: str, most: int) -> str:
    """The first items within a budget of characters, with their first letters lowered where they are determiners."""
    over = f"(a.f OR a.r - length(e.x) - 2 < 0 OR len(a.k) >= {most})"
    each = f"list_transform({items}, lambda x: {{'r': 0::BIGINT, 'f': false, 'k': []::VARCHAR[], 'x': x}})"
    step = f"{{'r': CASE WHEN {over} THEN a.r ELSE a.r - length(e.x) - 2 END, 'f': {over}, 'k': CASE WHEN {over} THEN a.k ELSE a.k || [e.x] END, 'x': ''}}"
    return f"list_transform(list_reduce({each}, lambda a, e: {step}, {{'r': ({room})::BIGINT, 'f': false, 'k': []::VARCHAR[], 'x': ''}}).k, lambda x: {_lead_sql('x')})"


_THREE = "CASE WHEN len(k) <= 2 THEN array_to_string(k, ' and ') ELSE array_to_string(k[1:2], ', ') || ', and ' || k[len(k)] END"
_BARE = "list_transform(details || fine || objects || [setting], lambda x: rtrim(trim(x), '.'))"
_LONG = f"list_filter({_BARE}, lambda x: {_n_words('x')} BETWEEN 2 AND 12)"
_FRAMED = f"regexp_matches(lower(x), '(^|[^A-Za-z0-9_])({rules.FRAMING_PATTERN})([^A-Za-z0-9_]|$)')"
_PHRASED_SQL = f"(SELECT *, {_distinct_sql('seen')} AS evidence, {_distinct_sql('back')} AS background FROM (SELECT *, {_LONG} AS seen, list_filter({_LONG}, lambda x: NOT {_FRAMED}) AS back, rtrim(trim(summary), '.') AS base FROM {_FACTS}))"

_PICKED = f"""list_reduce(list_transform(short, lambda x: {{'p': '', 'k': []::VARCHAR[], 'x': x}}), lambda a, e: CASE WHEN len(a.k) >= 4 OR lower(e.x) = lower(base)
        OR len(list_filter(a.k, lambda q: lower(q) = lower(e.x))) > 0 OR len(list_filter(string_split(lower(e.x), ' '), lambda w: length(w) > 4 AND contains(a.p, w))) > 0
        THEN a ELSE {{'p': a.p || ' ' || lower(e.x), 'k': a.k || [e.x], 'x': ''}} END, {{'p': lower(base), 'k': []::VARCHAR[], 'x': ''}}).k"""
_FORMAL_SQL = f"""(SELECT *, CASE WHEN base = '' THEN '' WHEN len(k) = 0 THEN base || '.' ELSE base || '. Also visible: ' || CASE WHEN len(k) = 1 THEN k[1] ELSE array_to_string(k[1:len(k) - 1], ', ') || ', and ' || k[len(k)] END || '.' END AS formal
    FROM (SELECT *, {_budget_sql('picked', f"292 - {len(' Also visible: .')} - length(base) - 1", 4)} AS k FROM (SELECT *, {_PICKED} AS picked
    FROM (SELECT *, list_filter(list_transform(background, lambda x: trim(regexp_replace(rtrim(trim(x), '.'), '{_WS}', ' ', 'g'))), lambda x: x <> '' AND {_n_words('x')} <= 8) AS short FROM {_PHRASED_SQL}))))"""
_FRESH = f"list_filter(background, lambda x: x <> '' AND {_n_words('x')} <= 8 AND NOT contains(lower(summary), lower(x)) AND len(list_filter(string_split(lower(x), ' '), lambda w: length(w) > 4 AND contains(lower(summary), w))) = 0)"
_ENRICHED_SQL = f"""(SELECT * EXCLUDE k, CASE WHEN {_COUNT.replace('caption', 'summary')} >= 34 OR len(k) = 0 THEN summary ELSE joined || ' In the background, ' || {_THREE} || '.' END AS enriched
    FROM (SELECT * EXCLUDE k, {_budget_sql('fresh', f"292 - {len(' In the background, .')} - length(joined)", 3)} AS k
    FROM (SELECT *, {_distinct_sql('lacks')} AS fresh FROM (SELECT *, {_FRESH} AS lacks, CASE WHEN rtrim(summary) LIKE '%.' THEN rtrim(summary) ELSE rtrim(summary) || '.' END AS joined FROM {_FORMAL_SQL}))))"""


@query("cap_formal_build", f"SELECT doc_id, formal AS caption FROM {_FORMAL_SQL}")
def _(spark, d):
    df = with_facts(spark, d)
    return df.select("doc_id", Facts(df).formal().alias("caption"))


@query("cap_enrich", f"SELECT doc_id, enriched AS caption FROM {_ENRICHED_SQL}")
def _(spark, d):
    df = with_facts(spark, d)
    return df.select("doc_id", Facts(df).enriched(F.coalesce("facts.summary", F.lit(""))).alias("caption"))


@query("cap_formal_select", f"SELECT doc_id, CASE WHEN {_COUNT.replace('caption', 'formal')} >= 20 THEN formal ELSE enriched END AS caption FROM {_ENRICHED_SQL}")
def _(spark, d):
    df = with_facts(spark, d)
    return df.select("doc_id", Facts(df).formal_or(F.coalesce("facts.summary", F.lit(""))).alias("caption"))


@query("cap_evidence_build", f"SELECT doc_id, style, CASE WHEN style <> 'formal' OR len(k) = 0 THEN summary ELSE trim(left(base || ', with ' || {_THREE} || '.', 300)) END AS caption FROM (SELECT *, list_filter(evidence, lambda x: NOT contains(lower(base), lower(x)))[1:3] AS k FROM {_PHRASED_SQL})")
def _(spark, d):
    df = with_facts(spark, d)
    return df.select("doc_id", "style", Facts(df).evidence_caption(F.col("style"), F.coalesce("facts.summary", F.lit(""))).alias("caption"))


#: Topics by words of the invented prose; the rules that ship name things that it doesn't hold.
TOPICS = (
    ("sarcastic", 2, ("les", "que"), "What a surprise: {scene}. Who knew."),
    ("sarcastic", 1, ("lesque", "une"), "Once more: {scene}, {scene}."),
    ("humorous_tech", 1, ("und", "der"), "Shipped with {phrase}."),
    ("humorous_tech", 2, ("die", "ich"), "Rolled back: {scene}."),
    ("humorous_non_tech", 3, ("los", "las"), "Guess who: {phrase}!"),
)
_SCENE = "left(rtrim(trim(summary), '.'), 180)"
_ALL_TEXT = "lower(concat_ws(' ', nullif(summary, ''), nullif(setting, ''), array_to_string(nullif(details, []), ' '), array_to_string(nullif(fine[1:8], []), ' ')))"


def _first_sql(n: int) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({_ALL_TEXT}, '{_WS}'), lambda w: w <> '')[1:{n}], ' ')"


def _topic_sql() -> str:
    cases = [f"WHEN style = {_quoted(s)} AND list_has_any(tokens, {sql_list(w)}) THEN replace(replace({_quoted(t)}, '{{scene}}', lower(scene)), '{{phrase}}', phrase20)" for s, _, w, t in sorted(TOPICS)]
    return f"CASE {' '.join(cases)} END"


def _fallback_sql() -> str:
    """The fallback of each document: by topic, else from the summary, else from the words, else fixed."""
    other = " ".join(f"WHEN {_quoted(s)} THEN {_quoted(a)} || {'lower(scene)' if a else 'scene'} || {_quoted(b)}" for s, (a, b) in rules.GROUNDED_FALLBACKS.items())
    words = " ".join(f"WHEN {_quoted(s)} THEN {_quoted(a)} || phrase26 || {_quoted(b)}" for s, (a, b) in rules.GROUNDED_FALLBACKS.items())
    fixed = " ".join(f"WHEN {_quoted(s)} THEN {_quoted(t)}" for s, t in rules.STATIC_FALLBACKS.items())
    return f"""(SELECT *, CASE WHEN scene <> '' THEN coalesce({_topic_sql()}, CASE style WHEN 'formal' THEN CASE WHEN len(extra) > 0 THEN left(scene || ', with ' || array_to_string(extra, ' and ') || '.', 300) ELSE scene || '.' END {other} END)
            WHEN phrase26 <> '' THEN CASE style WHEN 'formal' THEN 'In view: ' || phrase26 || '.' {words} END ELSE CASE style {fixed} END END AS fallback
        FROM (SELECT *, {_SCENE} AS scene, {_first_sql(20)} AS phrase20, {_first_sql(26)} AS phrase26, regexp_extract_all({_ALL_TEXT}, '[a-z]+') AS tokens,
                     list_filter(list_transform(details || fine || objects, lambda x: rtrim(trim(x), '.')), lambda x: NOT contains(lower({_SCENE}), lower(x)))[1:2] AS extra FROM {_FACTS}))"""


@query("cap_fallback", f"SELECT doc_id, style, fallback AS caption FROM {_fallback_sql()}")
def _(spark, d):
    df = topics.with_fallback(with_facts(spark, d), ["doc_id"], topics.topic_rules(spark, TOPICS))
    return df.select("doc_id", "style", F.col("fallback").alias("caption"))


# --- datasets ----------------------------------------------------------------------------------------------------


@query("ds_balanced_draw", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('seed/' || doc_id), doc_id) AS n, dense_rank() OVER (ORDER BY lang) AS c FROM documents) WHERE n <= 42 // (SELECT count(DISTINCT lang) FROM documents) + (c <= 42 % (SELECT count(DISTINCT lang) FROM documents))::INT")
def _(spark, d):
    return ds.balanced_draw(read(spark, d, "documents").select("lang", "doc_id"), "lang", 42, "seed", "doc_id").select("lang", "doc_id")


@query("ds_cycle", "SELECT slot, n_name FROM (SELECT unnest(range(0, 60)) AS slot) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS at_ FROM nation) ON slot % (SELECT count(*) FROM nation) = at_")
def _(spark, d):
    return ds.cycled(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 60).select("slot", "n_name")


@query("ds_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('seed/' || doc_id), doc_id) AS place FROM documents")
def _(spark, d):
    return ds.shuffled(read(spark, d, "documents").select("source", "doc_id"), ["source"], "seed", "doc_id").select("doc_id", "place")


@query("ds_render_template", "SELECT item_id, replace(replace('A [slot] scene: [text]', '[slot]', ['busy', 'calm', 'wide'][('0x' || left(md5('seed/' || item_id), 8))::BIGINT % 3 + 1]), '[text]', text) AS scene FROM benchmark")
def _(spark, d):
    picked = F.element_at(F.array(*map(F.lit, ("busy", "calm", "wide"))), (ds.choice("seed", 3, "item_id") + 1).cast("int"))
    return read(spark, d, "benchmark").select("item_id", F.replace(F.replace(F.lit("A [slot] scene: [text]"), F.lit("[slot]"), picked), F.lit("[text]"), F.col("text")).alias("scene"))


def _written(spark, d):
    df = with_facts(spark, d).drop("style")
    many = ds.cross_styles(df.select("doc_id", "facts"), STYLES)
    return many.withColumn("caption", ds.write_caption(F.col("style"), F.slice("facts.salient_objects", 1, 2), F.get("facts.visual_details", F.lit(0)), F.col("facts.setting"), F.lit(""), "seed", "doc_id"))


_PICK = "[('0x' || left(md5('seed/' || doc_id || '/' || style), 8))::BIGINT % 3 + 1]"
_WHO = "CASE len(objects) WHEN 0 THEN 'the subject' WHEN 1 THEN objects[1] ELSE objects[1] || ' and ' || objects[2] END"


def _template_sql(pick: str, who: str, what: str, place: str, mood: str) -> str:
    """The caption of a style by template; who, what, place and mood are SQL."""
    return f"""CASE style
        WHEN 'formal' THEN ['Here one finds ', 'Visible are, in this order, ', 'On view: ']{pick} || {who} || ', ' || {what} || ' in ' || {place} || ', with a ' || {mood} || ' mood.'
        WHEN 'sarcastic' THEN ['Of course ', 'Naturally, ', 'As everybody had hoped, ']{pick} || {who} || ' spent the day ' || {what} || ' in ' || {place} || ', and the world held its breath.'
        WHEN 'humorous_tech' THEN ['Deployed to production: ', 'Pipeline passed: ', 'Hotfix shipped: ']{pick} || {who} || ', ' || {what} || ' in ' || {place} || ' with zero downtime.'
        WHEN 'humorous_non_tech' THEN ['Breaking news from the sofa: ', 'Meanwhile, in slow motion: ', 'Somebody tell grandma: ']{pick} || {who} || ' is ' || {what} || ' in ' || {place} || ' again.'
        ELSE '' END"""


_WRITTEN_SQL = f"""(SELECT doc_id, setting, style, {_template_sql(_PICK, 'who', 'what', 'place', "'calm'")} AS caption
    FROM (SELECT doc_id, setting, unnest({sql_list(STYLES)}) AS style, {_WHO} AS who, coalesce(nullif(trim(details[1]), ''), 'moving through the frame') AS what, coalesce(nullif(trim(setting), ''), 'an open space') AS place FROM {_FACTS}))"""
BANS = {"formal": ("the and", "ith der"), "humorous_non_tech": ("que ", "und ")}
_VALID_SQL = "(length(caption) BETWEEN 15 AND 260" + "".join(f" AND NOT (style = '{s}' AND regexp_matches(lower(caption), '{'|'.join(t)}'))" for s, t in BANS.items()) + ")"

query("ds_style_writers", f"SELECT doc_id, style, caption FROM {_WRITTEN_SQL}")(lambda s, d: _written(s, d).select("doc_id", "style", "caption"))


@query("ds_build", f"SELECT setting AS source, style, count(*) AS rows, (SELECT count(*) FROM {_WRITTEN_SQL} WHERE NOT {_VALID_SQL}) AS dropped FROM {_WRITTEN_SQL} WHERE {_VALID_SQL} GROUP BY ALL")
def _(spark, d):
    path, ok = scratch(spark), ds.valid_caption(F.col("style"), F.col("caption"), BANS)
    counts = training.write_valid(_written(spark, d).select("facts", "style", "caption"), ok, path)
    rows = io.jsonl(spark, path, "facts struct<setting: string>, style string, caption string").select(F.col("facts.setting").alias("source"), "style")
    return rows.groupBy("source", "style").agg(F.count("*").alias("rows")).withColumn("dropped", F.lit(counts["dropped"]).cast("long"))


_MOCK_SQL = "(SELECT item_id || '-' || left(md5(text), 8) AS task_id, unnest(CASE item_id % 3 WHEN 0 THEN ['formal', 'poem'] WHEN 1 THEN ['formal', 'sarcastic', 'humorous_tech', 'humorous_non_tech'] ELSE ['sarcastic'] END) AS style FROM benchmark)"
_MOCK_PICK = "[('0x' || left(md5('mock/' || task_id || '/' || style), 8))::BIGINT % 3 + 1]"


@query("ds_mock", f"SELECT task_id, style, {_template_sql(_MOCK_PICK, "'thing ' || task_id || ' and one more'", "'moving'", "'some place'", "'neutral'")} AS caption FROM {_MOCK_SQL}")
def _(spark, d):
    """Items as tasks that ask for an unknown style, for none, or for one twice; their ids are made from the texts."""
    kind = F.pmod("item_id", F.lit(3))
    styles = F.when(kind == 0, F.array(F.lit("formal"), F.lit("poem"))).when(kind == 2, F.array(F.lit("sarcastic"), F.lit(None), F.lit("sarcastic")))
    tasks = read(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit("-"), F.left(F.md5("text"), F.lit(8))).alias("task_id"), styles.alias("styles"))
    return cap.explode_captions(ds.mock_results(tasks, "mock"))


@query("ds_sft_text", "SELECT u.conv_id, u.turn, '<system>' || chr(10) || 'Write.' || chr(10) || '<user>' || chr(10) || coalesce(u.text, '') || chr(10) || '<assistant>' || chr(10) || coalesce(a.text, '') AS text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role <> 'assistant' AND a.role = 'assistant'")
def _(spark, d):
    """Every turn that an assistant's one follows, with it."""
    turns = read(spark, d, "conversations")
    asked = turns.filter("role <> 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("asked"))
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("reply"))
    return asked.join(replies, ["conv_id", "turn"]).select("conv_id", "turn", ds.chat_text("Write.", F.col("asked"), F.col("reply")).alias("text"))


query("pr_messages", "SELECT conv_id, turn, 4::BIGINT AS n, text AS last FROM conversations")(lambda s, d: read(s, d, "conversations").select("conv_id", "turn", ds.messages("Be brief.", [("Hi", "Hello")], F.col("text")).alias("m")).select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.element_at("m", -1)["content"].alias("last")))
query("pr_judge_prompt", f"SELECT doc_id, 'Style: ' || style || chr(10) || 'Definition: a caption' || chr(10) || 'Caption: ' || caption || chr(10) || 'Rate accuracy and style from 0 to 1.' AS prompt FROM {CAPTIONS_SQL}")(lambda s, d: captions(s, d).select("doc_id", ds.judge_prompt(F.col("style"), F.lit("a caption"), F.col("caption")).alias("prompt")))
query("pr_observation_blocks", "SELECT conv_id, string_agg(role || ' (' || n || '):' || chr(10) || lines, chr(10) || chr(10) ORDER BY role) AS blocks FROM (SELECT conv_id, role, count(*) AS n, string_agg('- ' || text, chr(10) ORDER BY turn, text) AS lines FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")(lambda s, d: ds.observation_blocks(read(s, d, "conversations"), "conv_id", "role", "turn", "text"))


_FOUND = "regexp_extract_all(replace(lower(concat_ws(' ', summary, setting, array_to_string(details, ' '), array_to_string(fine, ' '), array_to_string(objects, ' '))), '/', ' '), '[a-z][a-z0-9-]{2,}')"


@query("pr_repair_prompt", f"SELECT doc_id, 'Caption:' || chr(10) || caption || chr(10) || 'Issues: ' || replace(codes, ',', ', ') || '.' || chr(10) || 'Evidence: ' || array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i)[1:14], ', ') || '.' AS prompt FROM (SELECT doc_id, caption, {_ISSUES} AS codes, list_filter({_FOUND}, lambda w: length(w) >= 4 AND NOT list_contains({sql_list(STOPS)}, w)) AS found FROM {_FACTS}) WHERE codes <> ''")
def _(spark, d):
    df = with_facts(spark, d)
    f = Facts(df)
    df = df.withColumn("terms", f.evidence_terms(STOPS))
    codes = f.issues(F.col("style"), F.col("caption"), _CLEAR, STOPS, F.col("terms"))
    return df.withColumn("codes", codes).filter(F.size("codes") > 0).select("doc_id", ds.repair_prompt(F.col("caption"), F.col("codes"), F.col("terms")).alias("prompt"))


# --- model stages ------------------------------------------------------------------------------------------------


def stub(prompts: list[str]) -> list[str]:
    """A deterministic model for tests: fails on prompts that hold "token =", else gives back the first words."""
    if any("token =" in p for p in prompts):
        raise ValueError("refused")
    return [f"Final caption: {' '.join(p.split()[:20])}" for p in prompts]


def judge_stub(prompts: list[str]) -> list[str]:
    return [f'Verdict {{"accuracy": {len(p) % 11 / 10}, "style_match": 0.5}} end' for p in prompts]


query("udf_batch_generate", "SELECT doc_id, NOT contains(text, 'token =') AS ok FROM documents")(lambda s, d: infer.generate(read(s, d, "documents").select("doc_id", F.col("text").alias("prompt")), stub).select("doc_id", "ok"))

def teacher_stub(prompts: list[str]) -> list[str]:
    """Captions of all styles as JSON, from the prompt's first characters; some calls fail, some replies are no object or lack a style."""
    out = []
    for p in prompts:
        if "token =" in p:
            raise ValueError("refused")
        captions = {s: p[: 10 + len(p) * (k + 2) % 290] for k, s in enumerate(STYLES)}
        if len(p) % 7 == 0:
            del captions[STYLES[len(p) % 4]]
        out.append("none today" if len(p) % 11 == 0 else json.dumps(captions))
    return out


_TAUGHT_SQL = f"SELECT doc_id, text, length(text) AS n, CASE WHEN contains(text, 'token =') THEN 'ValueError' WHEN length(text) % 11 = 0 THEN 'not an object' WHEN length(text) % 7 = 0 THEN 'missing: ' || {sql_list(STYLES)}[length(text) % 4 + 1] END AS error FROM documents"
_REPLIES_SQL = f"SELECT doc_id, style, left(text, 10 + n * (k + 2) % 290) AS caption FROM ({_TAUGHT_SQL}), (SELECT unnest(range(0, 4)) AS k, unnest({sql_list(STYLES)}) AS style) WHERE error IS NULL"


@query("ds_teacher", f"SELECT doc_id, count(*) FILTER ({_VALID_SQL}) AS kept, count(*) FILTER (NOT {_VALID_SQL}) AS dropped, NULL::VARCHAR AS error, (SELECT count(error) FROM ({_TAUGHT_SQL})) AS failed FROM ({_REPLIES_SQL}) GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, error, (SELECT count(error) FROM ({_TAUGHT_SQL})) FROM ({_TAUGHT_SQL}) WHERE error IS NOT NULL")
def _(spark, d):
    scenes = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    got = training.teach(scenes, teacher_stub, ds.valid_caption(F.col("style"), F.col("caption"), BANS))
    rows = got.rows.select("doc_id", F.lit(1).alias("kept")).unionByName(got.dropped.select("doc_id", F.lit(0).alias("kept")))
    passed = rows.groupBy("doc_id").agg(F.sum("kept").alias("kept"), F.sum(1 - F.col("kept")).alias("dropped"), F.lit(None).cast("string").alias("error"))
    failed = got.failures.select("doc_id", F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("dropped"), "error")
    return passed.unionByName(failed).withColumn("failed", F.lit(got.counts["failed"]).cast("long"))


query("udf_judge", "SELECT doc_id, (length(text) % 11) / 10.0::DOUBLE AS accuracy, 0.5::DOUBLE AS style FROM documents")(lambda s, d: infer.judge(read(s, d, "documents").select("doc_id", F.col("text").alias("prompt")), judge_stub).select("doc_id", "accuracy", "style"))


#: System text, example pair and template of each style that has a rule; other styles have none.
STYLE_TABLE = (
    ("formal", "Plain words.", [("two birds", "Two birds rest.")], "Describe {facts}"),
    ("sarcastic", "Dry wit.", [], "Mock {facts}, gently: {facts}"),
    ("humorous_tech", "For engineers.", [("a bus", "The bus is in production."), ("rain", "Rain has shipped.")], "Joke about {facts}"),
)
_FILLED_SQL = "CASE style " + " ".join(
    f"WHEN {_quoted(s)} THEN {_quoted(''.join(['<system>', chr(10), system, *(f'{chr(10)}<user>{chr(10)}{u}{chr(10)}<assistant>{chr(10)}{r}' for u, r in shots), chr(10), '<user>', chr(10)]))} || replace({_quoted(template)}, '{{facts}}', facts)"
    for s, system, shots, template in STYLE_TABLE
) + " END"


@query("udf_style_rules", f"SELECT doc_id, CASE WHEN prompt IS NULL THEN 'no rule' WHEN contains(prompt, 'token =') THEN 'failed' ELSE 'model' END AS way, sha256(CASE WHEN prompt IS NULL THEN neutral WHEN contains(prompt, 'token =') THEN 'none' ELSE 'Final caption: ' || array_to_string(list_filter(regexp_split_to_array(prompt, '{_WS}'), lambda w: w <> '')[1:20], ' ') END) AS digest FROM (SELECT doc_id, {_FILLED_SQL} AS prompt, neutral FROM (SELECT doc_id, {STYLE_SQL} AS style, text AS facts FROM documents) JOIN (SELECT doc_id, fallback AS neutral FROM {_fallback_sql().replace(STYLE_SQL, "'formal'")}) USING (doc_id))")
def _(spark, d):
    """Texts as facts; one style has no rule, so its rows get the formal fallback without a call."""
    table = spark.createDataFrame(STYLE_TABLE, infer.STYLE_RULES)
    rows = with_facts(spark, d)
    made = infer.write_styles(rows.select("doc_id", "style", "facts", "caption"), table, F.col("caption"), stub, F.lit("none"), Facts(rows).fallback(F.lit("formal")))
    return made.select("doc_id", "way", F.sha2("written", 256).alias("digest"))


@query("udf_pipeline", "SELECT source AS task_id, 4::BIGINT AS captions, 0::BIGINT AS blank, count(DISTINCT lang) AS generated, true AS valid FROM documents GROUP BY source")
def _(spark, d):
    """Sources as tasks; each document is a scene of its source in the style of its language. Calls for texts with "token =" fail."""
    scenes = with_facts(spark, d).select("task_id", "style", F.col("doc_id").alias("scene"), "facts", F.col("caption").alias("prompt"))
    made = run.caption_run(scenes.select("task_id"), scenes, stub, topics.topic_rules(spark, TOPICS), repair=stub, clear=_CLEAR, stop=STOPS, **LISTS)
    blank = F.size(F.filter(F.map_values("captions"), lambda c: F.trim(c) == ""))
    return made.select("task_id", F.size("captions").cast("long").alias("captions"), blank.cast("long").alias("blank"), "generated", F.col("reason").isNull().alias("valid"))


# --- streams -----------------------------------------------------------------------------------------------------


@query("str_incremental_results", "SELECT c_custkey, coalesce(arg_max(o_orderstatus, o_orderkey), 'fallback') AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, d):
    """Orders arrive in files, of which a batch takes two, in no order of their keys."""
    base, keys, arrival = scratch(spark), ["c_custkey"], ["o_orderkey"]
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    orders.repartition(6).write.parquet(f"{base}/in")
    done = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    stream.incremental_results(done, f"{base}/out", f"{base}/checkpoint", keys, arrival).awaitTermination()
    seed = read(spark, d, "customer").select("c_custkey")
    return stream.results(spark, f"{base}/out", f"{base}/checkpoint", "c_custkey long, o_orderkey long, o_orderstatus string", seed, keys, arrival, {"o_orderstatus": F.lit("fallback")})


@query("str_audit", f"SELECT style, code, count(*) AS n FROM (SELECT style, unnest(['long', 'mark']) AS code, caption FROM {CAPTIONS_SQL}) WHERE (code = 'long' AND length(caption) > 300) OR (code = 'mark' AND contains(caption, '!')) GROUP BY ALL")
def _(spark, d):
    base = scratch(spark)
    captions(spark, d).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(captions(spark, d).schema).parquet(f"{base}/in")
    codes = lambda df: F.array_compact(F.array(F.when(F.char_length("caption") > 300, "long"), F.when(F.contains("caption", F.lit("!")), "mark")))
    stream.append(stream.audit(rows, codes, "stream"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("task_id string, style string, `check` string, code string").parquet(f"{base}/out").groupBy("style", "code").agg(F.count("*").alias("n"))


# Requests of four periods of eight days come in eight parts: of each period first those in time, then those that are a little late; some come a
# period late, when the watermark, half a period behind, has passed them.
_PERIOD, _SPAN = 8, 4
_SENT_SQL = f"""s AS (SELECT user_id, event_type, (epoch_us(ts) // 86400000000 - 19723) // {_PERIOD} AS period, event_id FROM events),
    r AS (SELECT user_id, event_type, period * {_PERIOD} AS day, CASE event_id % 20 WHEN 0 THEN 2 * period + 1 WHEN 1 THEN 2 * period + 3 ELSE 2 * period END AS part FROM s),
    w AS (SELECT p.part, max(r.day) - {_SPAN} AS seen FROM (SELECT DISTINCT part FROM r) p LEFT JOIN r ON r.part < p.part GROUP BY p.part),
    k AS (SELECT DISTINCT user_id, event_type, part, {{'seen': coalesce(seen, -1000), 'until': day + {_SPAN}, 'n': 1}} AS x FROM r JOIN w USING (part) WHERE day > coalesce(seen, -1000))"""


def requests_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: memo key, event time at the start of its period, and the part in which it is sent."""
    day = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 86_400) - 19_723
    period = F.floor(day / _PERIOD)
    part = 2 * period + F.when(F.col("event_id") % 20 == 0, 1).when(F.col("event_id") % 20 == 1, 3).otherwise(0)
    at = F.timestamp_seconds((period * _PERIOD + 19_723) * 86_400)
    return read(spark, sf_dir, "events").select(memo_key(F.struct("user_id", "event_type"), 64).alias("key"), "user_id", "event_type", at.alias("at"), part.alias("part"))


@query("str_memo", f"WITH {_SENT_SQL} SELECT user_id, event_type, list_reduce(xs, lambda a, x: CASE WHEN a.until <= x.seen THEN {{'seen': x.seen, 'until': x.until, 'n': a.n + 1}} ELSE {{'seen': x.seen, 'until': a.until, 'n': a.n}} END).n::BIGINT AS n FROM (SELECT user_id, event_type, list(x ORDER BY part) AS xs FROM k GROUP BY user_id, event_type)")
def _(spark, d):
    """Each part arrives and is worked off by a new run, which takes up the state of the one before."""
    base, sent = scratch(spark), requests_sent(spark, d)
    schema = sent.drop("part").schema
    for (part,) in sorted(sent.select("part").distinct().collect()):
        sent.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        once = stream.requests_once(spark.readStream.schema(schema).parquet(f"{base}/in"), "key", "at", f"{_SPAN} days")
        stream.append(once, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(schema).parquet(f"{base}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
