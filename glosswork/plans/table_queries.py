"""Sources and sinks, projections, joins, aggregates, windows and timelines over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, rules
from ..functions.text import any_of, number
from ..operators import audits
from ..operators import captions as cap
from ..operators import ordered
from ..operators import scores as sc
from ..operators import select as sel
from ..operators import timeline as tl
from ..sources import io
from ..sources.shared import scratch
from .mapping import CAPTIONS_SQL, SCORES_SQL, STYLE_SQL, attempts, captions, read, scores
from .text_queries import sql_list, sql_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _micros():
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


# --- sources and sinks -------------------------------------------------------------------------------------------


def _array_files(rows, run, order, path):
    """Write JSON arrays, one a file: of each run the rows of a range of some 10,000 numbers, in their order."""
    value = F.struct(order.alias("order"), F.to_json(F.struct(*rows.columns)).alias("value"))
    dealt = rows.select(run.alias("run"), F.lpad(F.floor(order / 10_000).cast("string"), 12, "0").alias("at"), value.alias("row")).groupBy("run", "at").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x.value), ","), F.lit("]"))
    dealt.select("run", "at", text.alias("value")).write.mode("append").option("maxRecordsPerFile", 1).partitionBy("run", "at").text(path)


@query("src_tasks", "SELECT 'p' || page_id AS task_id, url AS video_url, 2::BIGINT AS n_styles, 0 AS status FROM pages UNION ALL SELECT 'no file', NULL, 0, 1 UNION ALL SELECT 'no array', NULL, 0, 1")
def _(spark, d):
    """Arrays of tasks, then a path without files, and one with a file that is no JSON: no tasks, and status 1."""
    pages, path = read(spark, d, "pages"), scratch(spark)
    made = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("task_id"), F.col("url").alias("video_url"), F.array(F.lit("formal"), F.lit("sarcastic")).alias("styles"))
    _array_files(made, F.lit("tasks"), F.substring("task_id", 2, 20).cast("long"), f"{path}/good")
    made.limit(1).select(F.lit("[{").alias("value")).write.text(f"{path}/bad")
    found, status = io.task_files(spark, f"{path}/good")
    out = found.select("task_id", "video_url", F.size("styles").cast("long").alias("n_styles"), F.lit(status).alias("status"))
    for name, where in (("no file", f"{path}/none"), ("no array", f"{path}/bad")):
        none, status = io.task_files(spark, where)
        out = out.unionByName(none.agg(F.lit(name).alias("task_id"), F.lit(None).cast("string").alias("video_url"), F.count("*").alias("n_styles"), F.lit(status).alias("status")))
    return out


@query("src_jsonl", "SELECT doc_id, lang, length(text)::BIGINT AS chars FROM documents")
def _(spark, d):
    path = scratch(spark)
    read(spark, d, "documents").select("doc_id", "lang", "text").write.json(path)
    return io.jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.char_length("text").cast("long").alias("chars"))


@query("src_pages", "SELECT page_id, url, length(html)::BIGINT AS chars FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", "url", F.char_length("html").cast("long").alias("chars"))


@query("src_scores", f"SELECT run, count(*) AS n, avg(accuracy) AS accuracy, avg(style_match) AS style FROM {SCORES_SQL} GROUP BY run")
def _(spark, d):
    """Arrays of scores in folders of their runs; files with a score that is no number, or that are no JSON, are left out."""
    path, rows = scratch(spark), scores(spark, d).select(F.col("doc_id").cast("string").alias("task_id"), "accuracy", "style_match", "run")
    _array_files(rows, F.col("run"), F.col("task_id").cast("long"), path)
    _array_files(rows.limit(3).withColumn("accuracy", F.lit("high")), F.lit("words"), F.col("task_id").cast("long"), path)
    rows.limit(1).select(F.lit("[{").alias("value"), F.lit("broken").alias("run"), F.lit("0").alias("at")).write.mode("append").partitionBy("run", "at").text(path)
    found = io.scores(spark, f"{path}/run=*/at=*", 3).withColumn("run", F.substring_index("run", "=", -1))
    return found.groupBy("run").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy"), F.avg("style_match").alias("style"))


@query("src_clips", "SELECT 'c' || o_custkey AS task_id, arg_max(o_orderpriority, o_orderkey) AS content_hint FROM orders GROUP BY o_custkey")
def _(spark, d):
    """Orders as a manifest, in arrays by ranges of their keys: customers repeat within files and from file to file."""
    orders, path = read(spark, d, "orders"), scratch(spark)
    rows = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("task_id"), F.lit("http://clips/").alias("video_url"), F.col("o_orderpriority").alias("content_hint"), F.col("o_orderkey").alias("key"))
    _array_files(rows, F.lit("clips"), F.col("key"), path)
    return io.clips(spark, path).select("task_id", "content_hint")


@query("src_textfiles", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE source NOT LIKE '%src1%' GROUP BY source")
def _(spark, d):
    path = scratch(spark)
    read(spark, d, "documents").select("source", F.to_json(F.struct("text")).alias("value")).write.partitionBy("source").text(path)
    files = io.text_files(spark, path, (".txt",), ("source=src1",)).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    return files.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length(F.from_json("line", "text string")["text"])).cast("long").alias("chars"))


@query("src_media", "SELECT lang, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY lang")
def _(spark, d):
    path = scratch(spark)
    read(spark, d, "documents").select("lang", "text").write.partitionBy("lang").option("lineSep", "\n").option("maxRecordsPerFile", 2_000).text(path)
    files = io.media(spark, path, "*.txt").select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.octet_length("content").cast("long").alias("bytes"))
    return files.groupBy("lang").agg(F.sum("bytes").alias("bytes"))


@query("src_results", "SELECT source AS task_id, lang AS style, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def _(spark, d):
    path = scratch(spark)
    docs = read(spark, d, "documents").groupBy("source", "lang").agg(F.max("doc_id").cast("string").alias("caption"))
    maps = docs.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "caption"))).alias("captions"))
    array = F.to_json(F.array(F.struct(F.col("source").alias("task_id"), "captions")))
    maps.select("source", array.alias("value")).write.partitionBy("source").text(path)  # one array a file
    return io.results(spark, path).select("task_id", "style", F.col("caption").cast("long").alias("doc_id"))


@query("snk_results", "SELECT source AS task_id, 4::BIGINT AS captions, true AS refused FROM documents GROUP BY source")
def _(spark, d):
    """Results of all styles are written; a second table, in which the captions of some tasks are blank, is refused and leaves them there."""
    path = scratch(spark)
    results = cap.assemble_captions(captions(spark, d).withColumnRenamed("doc_id", "position"), "none")
    cap.write_results(results, path, "parquet")
    try:
        cap.write_results(results.withColumn("captions", F.transform_values("captions", lambda k, v: F.when(k == "formal", F.lit(" ")).otherwise(v))), path, "parquet")
        refused = False
    except ValueError as e:
        refused = "blank: formal" in str(e)
    return spark.read.parquet(path).select("task_id", F.size(F.map_filter("captions", lambda _, v: F.trim(v) != "")).cast("long").alias("captions"), F.lit(refused).alias("refused"))


@query("snk_jsonl", f"SELECT style, count(*) AS n, sum(length(caption))::BIGINT AS chars FROM {CAPTIONS_SQL} GROUP BY style")
def _(spark, d):
    path = scratch(spark)
    io.write_rows(captions(spark, d).select(F.struct(F.col("task_id").alias("setting")).alias("facts"), "style", "caption"), path)
    return io.jsonl(spark, path, io.TRAINING).groupBy("style").agg(F.count("*").alias("n"), F.sum(F.char_length("caption")).cast("long").alias("chars"))


@query("snk_scores", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, d):
    path = scratch(spark)
    io.write_rows(read(spark, d, "labels"), path)
    return io.jsonl(spark, path, "doc_id long, quality int, toxic int").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("snk_incremental", "SELECT doc_id, source = 'src0' AS first FROM documents")
def _(spark, d):
    path = scratch(spark)
    docs = read(spark, d, "documents").select("doc_id", (F.col("source") == "src0").alias("first"))
    io.append_missing(docs.filter("first"), path, "doc_id", lambda df: df)
    io.append_missing(docs, path, "doc_id", lambda df: df)
    return spark.read.parquet(path)


# --- projections and validation ----------------------------------------------------------------------------------


@query("prj_task_validate", "SELECT page_id AS task_id, CASE WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'video_url' WHEN page_id % 3 = 0 THEN 'styles: odd' END AS reason, 4 + (page_id % 3 = 0)::BIGINT AS n_styles FROM pages")
def _(spark, d):
    tasks = read(spark, d, "pages").select(F.col("page_id").alias("task_id"), F.col("url").alias("video_url"), F.when(F.pmod("page_id", F.lit(3)) == 0, F.array(F.lit("odd"), F.lit("formal"))).otherwise(F.array(F.lit("formal"))).alias("styles"))
    return cap.validate_tasks(tasks).select("task_id", "reason", F.size("styles").cast("long").alias("n_styles"))


_PRESENT = f"(SELECT doc_id AS task_id, [style] AS present FROM {CAPTIONS_SQL})"
_MISSING = "list_filter(['formal', 'humorous_non_tech', 'humorous_tech', 'sarcastic'], lambda s: NOT list_contains(present, s))"


@query("prj_result_validate", f"SELECT task_id, CASE task_id % 4 WHEN 1 THEN 'missing: ' || array_to_string({_MISSING}, ',') WHEN 2 THEN 'unknown: ode,poem' WHEN 3 THEN 'blank: formal,sarcastic' END AS reason FROM {_PRESENT}")
def _(spark, d):
    """By doc_id: all styles, the document's own one only, two unknown ones beside all, two blank ones."""
    full = F.map_from_arrays(F.array(*map(F.lit, rules.STYLES)), F.array_repeat("caption", 4))
    odd = F.map_concat(full, F.create_map(F.lit("poem"), "caption", F.lit("ode"), "caption"))
    blank = F.transform_values(full, lambda k, v: F.when(k == "formal", F.lit(" ")).when(k == "sarcastic", F.lit(None)).otherwise(v))
    kind = F.pmod("doc_id", F.lit(4))
    made = F.when(kind == 0, full).when(kind == 1, F.create_map("style", "caption")).when(kind == 2, odd).otherwise(blank)
    return cap.validate_results(captions(spark, d).select(F.col("doc_id").alias("task_id"), made.alias("captions"))).select("task_id", "reason")


@query("set_missing_unknown", f"SELECT task_id, array_to_string({_MISSING}, ',') AS missing, CASE WHEN task_id % 3 = 0 THEN 'poem,ode' ELSE '' END AS unknown FROM {_PRESENT}")
def _(spark, d):
    more = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit("poem"), F.lit("ode"), F.lit("poem"))).otherwise(F.array().cast("array<string>"))
    present = captions(spark, d).select(F.col("doc_id").alias("task_id"), F.concat(F.array("style"), more).alias("present"))
    wanted = F.array(*map(F.lit, ("formal", "humorous_non_tech", "humorous_tech", "sarcastic")))
    return present.select("task_id", F.array_join(F.array_except(wanted, "present"), ",").alias("missing"), F.array_join(F.array_except("present", wanted), ",").alias("unknown"))


_LAST_SQL = f"SELECT task_id, style, arg_max(caption, doc_id) AS caption FROM {CAPTIONS_SQL} GROUP BY task_id, style"


@query("prj_explode_captions", _LAST_SQL)
def _(spark, d):
    rows = captions(spark, d).groupBy("task_id", "style").agg(F.max_by("caption", "doc_id").alias("caption"))
    return cap.explode_captions(rows.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("style", "caption"))).alias("captions")))


@query("prj_assemble_captions", f"SELECT t.task_id, s.style, coalesce(c.caption, 'none') AS caption FROM (SELECT DISTINCT source AS task_id FROM documents) t CROSS JOIN (SELECT unnest(['formal', 'sarcastic', 'humorous_tech', 'humorous_non_tech']) AS style) s LEFT JOIN ({_LAST_SQL}) c ON c.task_id = t.task_id AND c.style = s.style")
def _(spark, d):
    return cap.explode_captions(cap.assemble_captions(captions(spark, d).withColumnRenamed("doc_id", "position"), "none"))


@query("prj_drop_category", "SELECT doc_id, '{\"lang\":\"' || lang || '\"}' AS facts FROM documents")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.struct(F.col("lang"), F.col("source").alias("category")).alias("scene"))
    return docs.select("doc_id", F.to_json(F.col("scene").dropFields("category")).alias("facts"))


@query("flt_first_n_per_group", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 3")
def _(spark, d):
    return sel.first_by(read(spark, d, "conversations"), ["conv_id"], F.col("turn"), F.col("text"), most=3).select("conv_id", "turn")


@query("flt_every_kth", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 6 OR pos % 2 = 0")
def _(spark, d):
    return ordered.every_kth(read(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn", "text"]).select("conv_id", "turn")


_VALID = "length(caption) BETWEEN 15 AND 260 AND NOT (style = 'formal' AND regexp_matches(lower(caption), 'the and|tion of')) AND NOT (style = 'sarcastic' AND regexp_matches(lower(caption), 'de la'))"


@query("flt_dataset_validate", f"SELECT style, count(*) FILTER ({_VALID}) AS kept, count(*) FILTER (NOT ({_VALID})) AS dropped FROM {CAPTIONS_SQL} GROUP BY style")
def _(spark, d):
    from ..operators.dataset import valid_caption

    ok = valid_caption(F.col("style"), F.col("caption"), {"formal": ("the and", "tion of"), "sarcastic": ("de la",)})
    return captions(spark, d).groupBy("style").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("flt_results_contract", f"SELECT count(*) AS tasks, bool_and(n = 4 AND full_) AS passed FROM (SELECT task_id, count(DISTINCT style) AS n, bool_and(trim(caption) <> '') AS full_ FROM {CAPTIONS_SQL} GROUP BY task_id)")
def _(spark, d):
    each = captions(spark, d).groupBy("task_id").agg(F.count_distinct("style").alias("n"), F.bool_and(F.trim("caption") != "").alias("full"))
    return each.agg(F.count("*").alias("tasks"), F.bool_and((F.col("n") == 4) & F.col("full")).alias("passed"))


# --- joins -------------------------------------------------------------------------------------------------------


@query("jn_results_clips", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id", "quality")
    found = docs.join(labels, "doc_id").withColumn("matched", F.lit(True))
    return found.unionByName(sel.unmatched(docs, labels, ["doc_id"]).select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(False).alias("matched")))


@query("jn_ground_truth", "SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE trim(text) <> ''")
def _(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").filter(F.trim("text") != "").select("doc_id"), "doc_id").select("doc_id", "quality")


_TERMS = [("src0", "rat"), ("src0", "the of"), ("src1", "ing"), ("src2", "de la"), ("src3", "und")]
_TERMS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TERMS) + ") t(task_id, term)"


@query("jn_terms_contains", f"SELECT doc_id, c.task_id, term FROM {CAPTIONS_SQL} c JOIN {_TERMS_SQL} ON c.task_id = t.task_id AND contains(lower(caption), term)")
def _(spark, d):
    terms = spark.createDataFrame(_TERMS, "task_id string, term string")
    return sel.terms_within(captions(spark, d), terms, "caption").select("doc_id", "task_id", "term")


QUERIES["aud_grounding"] = lambda s, d: QUERIES["jn_terms_contains"](s, d).groupBy("task_id", "term").agg(F.count("*").alias("n"))
ORACLES["aud_grounding"] = f"SELECT task_id, term, count(*) AS n FROM ({ORACLES['jn_terms_contains']}) GROUP BY ALL"

_ANCHORS = [("src0", "a", ["the", "of"]), ("src0", "b", ["was", "que"]), ("src0", "c", ["zzz"]), ("src1", "a", ["and", "der"])]
_TOKENS_SQL = "list_distinct(list_transform(list_filter(string_split(replace(caption, '/', ' '), ' '), lambda w: w <> ''), lambda w: lower(trim(w, '.,!?;:()[]{}\"''`'))))"
_ANCHORS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _ANCHORS) + ") g(task_id, grp, choices)"


def _dictionaries(spark, d):
    """Captions with the terms and anchors of their tasks."""
    terms, anchors = spark.createDataFrame(_TERMS, "task_id string, term string"), spark.createDataFrame(_ANCHORS, "task_id string, grp string, choices array<string>")
    return audits.with_dictionaries(captions(spark, d), terms, anchors)


def _anchor_groups(spark, d):
    return _dictionaries(spark, d).select("doc_id", "style", audits.shared_anchors(F.col("caption")).alias("shared"), F.size(checks.words(F.col("caption"))).cast("long").alias("words"))


@query("jn_anchor_groups", f"SELECT doc_id, coalesce(sum(list_has_any(choices, tokens)::INT), -1)::BIGINT AS shared FROM (SELECT doc_id, task_id, {_TOKENS_SQL} AS tokens FROM {CAPTIONS_SQL}) c LEFT JOIN {_ANCHORS_SQL} USING (task_id) GROUP BY doc_id")
def _(spark, d):
    return _anchor_groups(spark, d).select("doc_id", "shared")


@query("aud_detail", f"SELECT style, count(*) FILTER (words < 20) AS too_thin, count(*) FILTER (shared BETWEEN 0 AND 1) AS few_anchors FROM (SELECT doc_id, style, max(words) AS words, coalesce(sum(list_has_any(choices, tokens)::INT), -1) AS shared FROM (SELECT doc_id, style, task_id, {_TOKENS_SQL} AS tokens, len(list_filter(regexp_split_to_array(caption, '\\s+'), lambda w: w <> '')) AS words FROM {CAPTIONS_SQL}) c LEFT JOIN {_ANCHORS_SQL} USING (task_id) GROUP BY doc_id, style) GROUP BY style")
def _(spark, d):
    return _anchor_groups(spark, d).groupBy("style").agg(F.count_if(F.col("words") < 20).alias("too_thin"), F.count_if(F.col("shared").between(0, 1)).alias("few_anchors"))


@query("jn_signature_scan", "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(documents.text), lower(b.text)))")
def _(spark, d):
    signatures = read(spark, d, "benchmark").select(F.col("text").alias("signature"))
    return sel.signature_hits(read(spark, d, "documents"), signatures, "text").select("doc_id")


QUERIES["agg_fallback_rate"] = lambda s, d: read(s, d, "documents").agg(F.count("*").alias("total")).crossJoin(QUERIES["jn_signature_scan"](s, d).agg(F.count("*").alias("hits")))
ORACLES["agg_fallback_rate"] = f"SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM ({ORACLES['jn_signature_scan']})) AS hits"


@query("jn_candidate_guard", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN t1 ELSE t0 END AS text, conv_id % 2 = 0 AS accepted FROM (SELECT conv_id, arg_min(text, turn) AS t0, arg_max(text, turn) AS t1 FROM conversations GROUP BY conv_id)")
def _(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("set_no"), "text")
    chosen = rows.groupBy("conv_id").agg(F.max_by("text", "set_no").alias("text"))
    odd = F.when(F.pmod("conv_id", F.lit(2)) == 1, F.lit("!")).otherwise(F.lit(""))
    return sel.guarded(chosen.withColumn("text", F.concat("text", odd)), rows, ["conv_id"])


_SETS_SQL = """t AS (SELECT conv_id, turn AS set_no, arg_min(coalesce(text, ''), (coalesce(text, ''), role)) AS text, arg_min(role, (coalesce(text, ''), role)) AS role FROM conversations GROUP BY conv_id, turn),
    sets AS (SELECT conv_id, set_no, 'formal' AS style, text FROM t UNION ALL SELECT conv_id, set_no, 'sarcastic', text || ' ' || role FROM t WHERE set_no % 2 = 1),
    ends AS (SELECT conv_id, min(set_no) AS low, max(set_no) AS high, count(*) AS n FROM t GROUP BY conv_id),
    wanted AS (SELECT ends.*, unnest(['formal', 'humorous_non_tech', 'humorous_tech', 'sarcastic']) AS style FROM ends),
    own AS (SELECT w.*, coalesce(f.text, '') AS first_, l.text AS last_ FROM wanted w LEFT JOIN sets f ON f.conv_id = w.conv_id AND f.set_no = low AND f.style = w.style LEFT JOIN sets l ON l.conv_id = w.conv_id AND l.set_no = high AND l.style = w.style),
    judged AS (SELECT *, n > 1 AND conv_id % 5 <> 0 AND last_ IS NOT NULL AND last_ <> '' AND NOT (conv_id % 5 = 1 AND style = 'formal') AS chosen FROM own)"""


@query("win_select_set", f"WITH {_SETS_SQL} SELECT conv_id, style, sha256(CASE WHEN NOT chosen THEN first_ WHEN conv_id % 5 = 2 THEN '  ' || last_ ELSE last_ END) AS digest, chosen FROM judged")
def _(spark, d):
    """Turns as candidate sets of their conversation, of which every second has a sarcastic caption. The selector takes the last set.

    By conv_id: it fails; it rewrites the formal caption; it adds spaces; its first reply fails; it copies.
    """
    text = F.coalesce("text", F.lit(""))
    turns = read(spark, d, "conversations").groupBy("conv_id", F.col("turn").alias("set_no")).agg(F.min(F.struct(text.alias("text"), "role")).alias("x")).select("conv_id", "set_no", "x.*")
    both = F.create_map(F.lit("formal"), "text", F.lit("sarcastic"), F.concat("text", F.lit(" "), "role"))
    sets = turns.select("conv_id", "set_no", F.when(F.col("set_no") % 2 == 1, both).otherwise(F.create_map(F.lit("formal"), "text")).alias("captions"))
    kind = F.pmod("conv_id", F.lit(5))
    replies = sets.groupBy("conv_id").agg(F.max_by("captions", "set_no").alias("last"))
    spaced = F.transform_values("last", lambda k, v: F.when(kind == 2, F.concat(F.lit("  "), v)).when((kind == 1) & (k == "formal"), F.concat(v, F.lit(" indeed"))).otherwise(v))
    tries = replies.select("conv_id", F.posexplode(F.array(F.when(~kind.isin(0, 3), spaced), F.when(kind != 0, spaced))).alias("attempt", "picked"))
    return sel.selected_sets(sets, tries, "conv_id").select("conv_id", "style", F.sha2("text", 256).alias("digest"), "chosen")


@query("jn_overlay_latest", "SELECT c_custkey, coalesce(arg_max(o_orderstatus, o_orderkey), 'fallback') AS o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, d):
    done = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return sel.overlay(read(spark, d, "customer").select("c_custkey"), done, ["c_custkey"], ["o_orderkey"], {"o_orderstatus": F.lit("fallback")})


@query("jn_memo", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    made = sel.memo(docs, F.sha2("text", 256), lambda once: once.select("memo_key", F.char_length("text").cast("long").alias("chars")), ["text"])
    return made.select("doc_id", "chars")


@query("jn_cross_styles", "SELECT item_id, md5(text) AS digest, style FROM benchmark CROSS JOIN (SELECT unnest(['formal', 'sarcastic', 'humorous_tech', 'humorous_non_tech']) AS style)")
def _(spark, d):
    from ..operators.dataset import cross_styles

    return cross_styles(read(spark, d, "benchmark").select("item_id", F.md5("text").alias("digest")), ("formal", "sarcastic", "humorous_tech", "humorous_non_tech"))


@query("jn_sibling_context", "SELECT conv_id, turn, sha256(string_agg('- ' || role || ': ' || text, chr(10)) FILTER (trim(text) <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS digest FROM conversations")
def _(spark, d):
    return sel.siblings(read(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", F.sha2("context", 256).alias("digest"))


@query("jn_frame_at_time", "WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error') SELECT r.user_id, r.t, e.event_id FROM r ASOF LEFT JOIN e ON r.user_id = e.user_id AND r.t <= e.t")
def _(spark, d):
    e = read(spark, d, "events").select("user_id", _micros().alias("t"), "event_id", "event_type")
    return ordered.at_or_after(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'"), "user_id", "t", "event_id").select("user_id", "t", "event_id")


# --- aggregates --------------------------------------------------------------------------------------------------

_MEANS_SQL = "count(*) AS n, coalesce(avg(coalesce(accuracy, 0)), 0) AS accuracy, coalesce(avg(coalesce(style_match, 0)), 0) AS style, coalesce(avg((coalesce(accuracy, 0) + coalesce(style_match, 0)) / 2), 0) AS final"
query("agg_score_summary", f"SELECT {_MEANS_SQL} FROM {SCORES_SQL}")(lambda s, d: sc.summary(scores(s, d)))
query("agg_scoreboard", f"SELECT run, {_MEANS_SQL} FROM {SCORES_SQL} GROUP BY run")(lambda s, d: sc.scoreboard(scores(s, d), "run"))
query("agg_per_style", f"SELECT coalesce(lang, 'overall') AS lang, {_MEANS_SQL} FROM {SCORES_SQL} GROUP BY ROLLUP (lang)")(lambda s, d: sc.per_style(scores(s, d), "lang"))
_VERDICT = "CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE ELSE (event_id % 500) / 500.0::DOUBLE END"


def _verdicts(spark, d):
    return read(spark, d, "events").select("user_id", "event_type", F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit(float("nan"))).otherwise(F.pmod("event_id", F.lit(500)) / 500).alias("score"))


query("agg_panel_mean", f"SELECT user_id, round(avg(v), 9) AS mean FROM (SELECT user_id, {_VERDICT} AS v FROM events) WHERE NOT isnan(v) GROUP BY user_id")(lambda s, d: sc.panel_mean(_verdicts(s, d), "user_id", "score").withColumn("mean", F.round("mean", 9)))
query("agg_nan_propagate", f"SELECT event_type, isnan(sum(v)) AS poisoned, count(*) AS n FROM (SELECT event_type, {_VERDICT} AS v FROM events WHERE event_type <> 'view' OR event_id % 10 <> 0) GROUP BY event_type")(
    lambda s, d: _verdicts(s, d).filter("event_type <> 'view' or not isnan(score)").groupBy("event_type").agg(F.isnan(F.avg("score")).alias("poisoned"), F.count("*").alias("n"))
)


@query("agg_valid_only", "SELECT event_type, round(avg(k), 9) AS mean, count(k) AS valid, count(*) - count(k) AS rejected FROM (SELECT event_type, CASE WHEN event_id % 4 > 0 THEN (props::JSON ->> 'k')::DOUBLE END AS k FROM events) GROUP BY event_type")
def _(spark, d):
    reply = F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    rows = read(spark, d, "events").select("event_type", reply.try_cast("double").alias("k"))
    return rows.groupBy("event_type").agg(F.round(F.avg("k"), 9).alias("mean"), F.count("k").alias("valid"), F.count_if(F.col("k").isNull()).alias("rejected"))


@query("agg_wrong_claims", "SELECT conv_id, array_to_string((list(text ORDER BY turn))[1:2], '; ') AS claims FROM conversations GROUP BY conv_id")
def _(spark, d):
    first = sel.first_by(read(spark, d, "conversations"), ["conv_id"], F.col("turn"), F.col("text"), most=2)
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "; ").alias("claims"))


@query("agg_claim_precision", "SELECT user_id, avg((event_type = 'purchase')::INT) AS share, sum((event_type = 'purchase')::BIGINT)::BIGINT AS correct, sum((event_type = 'error' AND value > 60)::BIGINT)::BIGINT AS contradictions, CASE WHEN max((event_type = 'error' AND value > 60)::INT) = 1 THEN least(avg((event_type = 'purchase')::INT), 0.4) ELSE avg((event_type = 'purchase')::INT) END AS precision FROM events GROUP BY user_id")
def _(spark, d):
    return sc.claim_precision(read(spark, d, "events"), "user_id", F.col("event_type") == "purchase", (F.col("event_type") == "error") & (F.col("value") > 60))


_DETAILS_SQL = "(SELECT lang AS task_id, source AS model, lower(trim(unnest(string_split(text, chr(10))))) AS detail FROM documents)"


def _details(spark, d):
    return read(spark, d, "documents").select(F.col("lang").alias("task_id"), F.col("source").alias("model"), F.explode(F.split("text", "\n")).alias("detail")).withColumn("detail", F.lower(F.trim("detail")))


query("agg_consensus", f"SELECT task_id, detail, models, CASE WHEN models >= 2 THEN 'trusted' WHEN regexp_matches(detail, '[0-9]') THEN 'dropped' ELSE 'kept' END AS status FROM (SELECT task_id, detail, count(DISTINCT model) AS models FROM {_DETAILS_SQL} GROUP BY ALL)")(
    lambda s, d: sel.consensus(_details(s, d), F.rlike("detail", F.lit("[0-9]")))
)
query("agg_observer_counts", f"SELECT task_id, model, count(*) AS n FROM {_DETAILS_SQL} GROUP BY ALL")(lambda s, d: _details(s, d).groupBy("task_id", "model").agg(F.count("*").alias("n")))
query("set_union_observations", f"SELECT task_id, count(*) AS n, count(DISTINCT detail) AS details FROM {_DETAILS_SQL} WHERE detail <> '' GROUP BY task_id")(
    lambda s, d: _details(s, d).filter("detail <> ''").groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct("detail").alias("details"))
)


query("agg_writer_bench", "SELECT event_type AS model, count(*) FILTER (value > 10) AS passed, count(*) AS n, round(avg(value), 6) AS latency FROM events GROUP BY event_type")(
    lambda s, d: read(s, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count_if(F.col("value") > 10).alias("passed"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("latency"))
)
query("agg_category_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")(lambda s, d: read(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")))
query("agg_duplicate_styles", "SELECT source, count(trim(text)) > count(DISTINCT trim(text)) AS duplicated FROM documents GROUP BY source")(
    lambda s, d: read(s, d, "documents").groupBy("source").agg((F.count("text") > F.count_distinct(F.md5(F.trim("text")))).alias("duplicated"))
)


@query("agg_run_compare", f"SELECT run, n, final, total, hits FROM (SELECT run, {_MEANS_SQL} FROM {SCORES_SQL} GROUP BY run) JOIN (SELECT source AS run, count(*) AS total, count(h.doc_id) AS hits FROM documents LEFT JOIN ({ORACLES['jn_signature_scan']}) h USING (doc_id) GROUP BY source) USING (run)")
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("run"), "text")
    found = sel.signature_hits(docs, read(spark, d, "benchmark").select(F.col("text").alias("signature")), "text").groupBy("run").agg(F.count("*").alias("found"))
    rate = docs.groupBy("run").agg(F.count("*").alias("total")).join(found, "run", "left").select("run", "total", F.coalesce("found", F.lit(0)).alias("hits"))
    return sc.scoreboard(scores(spark, d), "run").join(rate, "run").select("run", "n", "final", "total", "hits")


_SELF = ("CASE WHEN trim(caption) = '' THEN 'empty' END", "CASE WHEN length(caption) > 300 THEN 'too_long' END", "CASE WHEN trim(caption) <> '' AND NOT (regexp_matches(caption, '[A-Za-z]') AND length(caption) - length(regexp_replace(caption, '[^\\x00-\\x7F]', '', 'g')) <= greatest(2, length(caption) // 20)) THEN 'not_english' END", "CASE WHEN style IN ('formal', 'sarcastic') AND contains(caption, '!') THEN 'exclamation' END", "CASE WHEN style = 'formal' AND regexp_matches(lower(caption), '(^|[^A-Za-z0-9_])(that|was)([^A-Za-z0-9_]|$)') THEN 'first_second_person' END", "CASE WHEN style IN ('sarcastic', 'humorous_non_tech') AND regexp_matches(lower(caption), '(^|[^A-Za-z0-9_])(les|que)([^A-Za-z0-9_]|$)') THEN 'tech_jargon' END")
_SELF_SQL = f"SELECT doc_id, task_id, style, unnest([{', '.join(_SELF)}]) AS code FROM {CAPTIONS_SQL}"


def _self_issues(spark, d):
    rows = captions(spark, d)
    return rows.select("doc_id", "task_id", "style", F.explode(cap.self_check(rows, banned=("que", "les"), person=("that", "was"))).alias("code"))


query("aud_self_check", f"SELECT doc_id, style, code FROM ({_SELF_SQL}) WHERE code IS NOT NULL")(lambda s, d: _self_issues(s, d).select("doc_id", "style", "code"))
_THIN = "CASE WHEN len(list_filter(regexp_split_to_array(caption, '\\s+'), lambda w: w <> '')) < CASE WHEN style = 'formal' THEN 10 ELSE 7 END THEN 'too_thin' END"
_TELL = "CASE WHEN regexp_matches(lower(caption), '(of the|rat)') THEN 'ai_tell' END"
_GENERIC = "CASE WHEN regexp_matches(lower(caption), '^(the|in|on) ') THEN 'generic' END"


_BLEED, _TASTE = ("que", "thand", "der"), ("ble er", "les d", "ich")


def _quality_issues(spark, d):
    rows = captions(spark, d)
    return rows.select("doc_id", "task_id", "style", F.explode(cap.quality_check(("of the", "rat"), _TASTE, "^(the|in|on) ", banned=_BLEED)).alias("code"))


_LOW = f"CASE WHEN regexp_matches(lower(caption), '({'|'.join(_TASTE)})') THEN 'low_taste' END"
_PHRASED = f"regexp_matches(lower(caption), '{any_of(rules.TECH_PHRASES)}')"
_BLED = f"CASE WHEN style <> 'humorous_tech' AND ({_PHRASED} OR list_has_any({sql_tokens('caption')}, {sql_list(_BLEED)})) THEN 'style_bleed' END"
_LACKS = f"CASE WHEN style = 'humorous_tech' AND NOT ({_PHRASED} OR list_has_any({sql_tokens('caption')}, {sql_list((*_BLEED, *rules.TECH_REFERENCES))})) THEN 'missing_reference' END"
_QUALITY_SQL = f"SELECT doc_id, task_id, style, unnest([{_TELL}, {_LOW}, {_GENERIC}, {_BLED}, {_LACKS}, {_THIN}]) AS code FROM {CAPTIONS_SQL}"
query("aud_quality", f"SELECT doc_id, style, code FROM ({_QUALITY_SQL}) WHERE code IS NOT NULL")(lambda s, d: _quality_issues(s, d).select("doc_id", "style", "code"))
query("set_issue_union", f"SELECT task_id, style, code, count(*) AS n FROM ({_QUALITY_SQL} UNION ALL {_SELF_SQL}) WHERE code IS NOT NULL GROUP BY ALL")(
    lambda s, d: _quality_issues(s, d).unionByName(_self_issues(s, d)).groupBy("task_id", "style", "code").agg(F.count("*").alias("n"))
)
query("agg_dataset_report", f"SELECT style, count(*) FILTER ({_VALID}) AS written, count(*) FILTER (NOT ({_VALID})) AS dropped, min(doc_id) FILTER ({_VALID}) AS first_id FROM {CAPTIONS_SQL} GROUP BY style")(lambda s, d: _report(s, d))


def _report(spark, d):
    from ..operators.dataset import valid_caption

    ok = valid_caption(F.col("style"), F.col("caption"), {"formal": ("the and", "tion of"), "sarcastic": ("de la",)})
    return captions(spark, d).groupBy("style").agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("dropped"), F.min(F.when(ok, F.col("doc_id"))).alias("first_id"))


_DETAIL_SQL = f"SELECT doc_id, style, unnest([CASE WHEN words < 20 THEN 'too_thin' END, CASE WHEN shared BETWEEN 0 AND 1 THEN 'few_anchors' END]) AS code FROM (SELECT doc_id, style, max(words) AS words, coalesce(sum(list_has_any(choices, tokens)::INT), -1) AS shared FROM (SELECT doc_id, style, task_id, {_TOKENS_SQL} AS tokens, len(list_filter(regexp_split_to_array(caption, '\\s+'), lambda w: w <> '')) AS words FROM {CAPTIONS_SQL}) c LEFT JOIN {_ANCHORS_SQL} USING (task_id) GROUP BY doc_id, style)"
_ISSUES_SQL = f"(SELECT * FROM (SELECT doc_id, style, 'self_check' AS \"check\", code FROM ({_SELF_SQL}) UNION ALL SELECT doc_id, style, 'quality_audit', code FROM ({_QUALITY_SQL}) UNION ALL SELECT doc_id, style, 'detail_audit', code FROM ({_DETAIL_SQL}) UNION ALL SELECT doc_id, {STYLE_SQL}, 'grounding_audit', 'unsupported: ' || term FROM ({ORACLES['jn_terms_contains']}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)) WHERE code IS NOT NULL)"
_CHECKS = ("self_check", "quality_audit", "detail_audit", "grounding_audit")


def _all_issues(spark, d):
    low = F.col(audits.LOW)
    codes = (cap.self_check(captions(spark, d), banned=("que", "les"), person=("that", "was"), low=low), cap.quality_check(("of the", "rat"), _TASTE, "^(the|in|on) ", banned=_BLEED, low=low), audits.detail_check({}, {}, (20, 2), low), audits.grounding_check(low))
    return audits.issue_table(_dictionaries(spark, d), dict(zip(_CHECKS, codes)), ["doc_id"])


query("agg_issue_report", f"SELECT doc_id, \"check\", code, (SELECT count(*) FROM {_ISSUES_SQL}) AS total FROM {_ISSUES_SQL} ORDER BY doc_id, \"check\", code LIMIT 50")(lambda s, d: audits.report(_all_issues(s, d).drop("style"), ["doc_id", "check", "code"], 50))
query("agg_gate", f"WITH i AS {_ISSUES_SQL}, n AS (SELECT v.c AS \"check\", count(i.code) AS n FROM (VALUES ('self_check'), ('quality_audit'), ('detail_audit'), ('grounding_audit')) v(c) LEFT JOIN i ON i.\"check\" = v.c GROUP BY v.c), k AS (SELECT \"check\", n = 0 AS passed, n || ' issues' AS message FROM n UNION ALL SELECT 'judge_score', n > 0 AND f >= 0.93, 'final ' || floor(f * 1000)::BIGINT || ' of 1000, ' || n || ' rows' FROM (SELECT avg((accuracy + style_match) / 2) AS f, count(*) AS n FROM {SCORES_SQL})) SELECT * FROM k UNION ALL SELECT 'gate', bool_and(passed), count(*) FILTER (NOT passed) || ' failed' FROM k")(
    lambda s, d: audits.quality_gate(_all_issues(s, d), _CHECKS, scores(s, d))
)


# --- windows -----------------------------------------------------------------------------------------------------


@query("win_failover", "WITH a AS (SELECT user_id, ts::DATE AS day, event_type, event_id, value, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS r FROM events) SELECT user_id, day, coalesce(arg_min(event_type, (r, event_id)) FILTER (event_type <> 'error'), 'fallback') AS provider, coalesce(arg_min(value, (r, event_id)) FILTER (event_type <> 'error'), -1.0) AS value FROM a GROUP BY user_id, day")
def _(spark, d):
    tries = attempts(spark, d)
    return sel.first_success(tries.select("user_id", "day").distinct(), tries, ["user_id", "day"], F.lit(-1.0), "value")


query("win_last", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")(lambda s, d: sel.last_by(read(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_type", "event_id"))
query("win_topn", "SELECT s_name, s_acctbal, place, s_nationkey = 7 AS own FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS place FROM supplier WHERE s_acctbal > 0 AND s_acctbal < 9000) WHERE place <= 3 OR s_nationkey = 7")(
    lambda s, d: sc.leaders(read(s, d, "supplier").filter("s_acctbal > 0 and s_acctbal < 9000"), "s_acctbal", "s_name", F.col("s_nationkey") == 7, 3).select("s_name", "s_acctbal", "place", "own")
)
query("win_bottomn", f"SELECT doc_id, (accuracy + style_match) / 2 AS final FROM {SCORES_SQL} ORDER BY 2, 1 LIMIT 5")(lambda s, d: scores(s, d).select("doc_id", ((F.col("accuracy") + F.col("style_match")) / 2).alias("final")).orderBy("final", "doc_id").limit(5))

# --- timelines ---------------------------------------------------------------------------------------------------

_SPAN_SQL = "(SELECT user_id, CASE WHEN max(epoch_us(ts)) > min(epoch_us(ts)) THEN (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 ELSE 60.0 END AS dur FROM events GROUP BY user_id)"


def _spans(spark, d):
    whole = (F.max(_micros()) - F.min(_micros())) / 1e6
    return read(spark, d, "events").groupBy("user_id").agg(tl.duration(whole).alias("dur"))


def _times(spark, d):
    return read(spark, d, "events").select("user_id", (F.pmod(_micros(), F.lit(1000000000)) / 1e6).alias("t"))


def _listed(times, most):
    """The first times of each user, no more than ``most``, as an array."""
    return sel.first_by(times, ["user_id"], F.col("t"), most=most).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("times"))


_TIMES_SQL = "(SELECT user_id, list_sort(list((epoch_us(ts) % 1000000000) / 1e6)) AS times FROM events GROUP BY user_id)"
query("tl_default_duration", f"SELECT user_id, dur FROM {_SPAN_SQL}")(lambda s, d: _spans(s, d))
query("tl_uniform", f"SELECT user_id, i, round_even(i * greatest(dur / 7, 0.1), 1) AS t FROM {_SPAN_SQL}, (SELECT unnest(range(1, 7)) AS i)")(lambda s, d: _spans(s, d).select("user_id", F.posexplode(tl.uniform(F.col("dur"), 6, 1)).alias("i", "t")).withColumn("i", (F.col("i") + 1).cast("long")))
query("tl_anchored", f"SELECT user_id, i, round_even(greatest(0.1, dur * (0.02 + 0.96 * (i - 1) / 5.0::DOUBLE)), 3) AS t FROM {_SPAN_SQL}, (SELECT unnest(range(1, 7)) AS i)")(lambda s, d: _spans(s, d).select("user_id", F.posexplode(tl.anchored(F.col("dur"), 6)).alias("i", "t")).withColumn("i", (F.col("i") + 1).cast("long")))


@query("tl_scene_cuts", "SELECT user_id, t FROM (SELECT user_id, epoch_us(ts) AS t, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) AS change FROM events) WHERE change > 35 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t) <= 5")
def _(spark, d):
    return tl.cuts(read(spark, d, "events").select("user_id", _micros().alias("at"), "value"), "user_id", "at", "value", 35.0, 5)


@query("tl_hybrid", f"SELECT user_id, unnest(range(1, len(times) + 1)) AS i, unnest(times) AS t FROM (SELECT user_id, (list_slice(times, 1, 4) || list_transform(range(1, 9 - least(len(times), 4)), lambda i: round_even(i * greatest(dur / (9 - least(len(times), 4)), 0.1), 3)))[1:8] AS times FROM {_TIMES_SQL} JOIN {_SPAN_SQL} USING (user_id))")
def _(spark, d):
    both = _listed(_times(spark, d), 4).join(_spans(spark, d), "user_id")  # a hybrid of 8 takes 4 cuts at most
    return both.select("user_id", F.posexplode(tl.hybrid(F.col("times"), F.col("dur"), 8)).alias("i", "t")).withColumn("i", (F.col("i") + 1).cast("long"))


query("tl_cut_offset", f"SELECT user_id, round(least(times[1] + 0.3, dur - 0.5), 6) AS t FROM {_TIMES_SQL} JOIN {_SPAN_SQL} USING (user_id)")(lambda s, d: _times(s, d).groupBy("user_id").agg(F.min("t").alias("t")).join(_spans(s, d), "user_id").select("user_id", F.round(tl.after_cut(F.col("t"), F.col("dur")), 6).alias("t")))
query("tl_gap_dedup", f"SELECT user_id, len(list_reduce(list_transform(times, lambda t: [t]), lambda k, t: CASE WHEN t[1] - k[-1] > 20 THEN k || t ELSE k END))::BIGINT AS kept FROM {_TIMES_SQL}")(lambda s, d: ordered.gap_dedup(_times(s, d), "user_id", "t", 20.0).groupBy("user_id").agg(F.count("*").alias("kept")))
query("tl_even_thin", f"SELECT user_id, array_to_string(CASE WHEN len(times) > 4 THEN list_transform(range(0, 4), lambda i: times[round_even(i * (len(times) - 1) / 3.0, 0)::BIGINT + 1]) ELSE times END, ',') AS times FROM {_TIMES_SQL}")(
    lambda s, d: _listed(ordered.even_thin(_times(s, d), "user_id", "t", 4), 4).select("user_id", F.array_join(F.transform("times", number), ",").alias("times"))
)

