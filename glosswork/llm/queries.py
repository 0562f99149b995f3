"""One query for each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, chat, decontam, divergence, linededup, minhash, mix, quality, setjoin, shard, tokens, toxicity
from .common import table

#: A shard holds no more than this part of the bytes of all texts.
SHARDS = 64
#: The ranks of a public byte-level BPE vocabulary, where the session doesn't name another file that all executors have.
RANKS, RANKS_SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.glosswork.bpe.ranks"
#: Likewise the two tokenizers that are aligned.
BYTE_LEVEL, BYTE_LEVEL_SETTING = "/opt/tokenizers/byte_bpe_50k.json", "spark.glosswork.bpe.json"
PIECES, PIECES_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.glosswork.pieces.model"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    probe = spark.sql(f"select -1L as conv_id, 0L as turn, 'user' as role, {said} as text union all select -1L, 1L, 'assistant', {said}")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.prefix_target_examples(conversations))


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shard.assign(docs, shard.share(docs, SHARDS))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_units(table(spark, sf_dir, "documents"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"), spark.conf.get(RANKS_SETTING, RANKS))


def op10_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), spark.conf.get(BYTE_LEVEL_SETTING, BYTE_LEVEL), spark.conf.get(PIECES_SETTING, PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_multiprobe_neighbours": op2_multiprobe_neighbours,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_source_mixing": op7_source_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_section_tokens": op9_section_tokens,
    "op10_toxicity_classifier": op10_toxicity_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_ESCAPED = "replace({0}, '\\', '\\\\')"
for _s in chat.Template().control:
    _ESCAPED = f"replace({_ESCAPED}, '{_s}', '{_s[0]}\\{_s[1:]}')"
_MARKS = sum(len(x) for x in (chat.Template().turn, chat.Template().body, chat.Template().end))

ORACLES: dict[str, str] = {
    "op1_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
        r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS size,
                     sum({_MARKS} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (sum(stop) FILTER (role = 'assistant' OR place = size))::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op4_benchmark_decontamination": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        s AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS st FROM i WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[st:st + 9], ' ') AS t FROM s),
        lens AS (SELECT DISTINCT l FROM win),
        p AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS st FROM w, lens WHERE len(ws) >= l),
        d AS (SELECT doc_id, st, l, array_to_string(ws[st:st + l - 1], ' ') AS t FROM p),
        hit AS (SELECT DISTINCT doc_id, st, l, item_id FROM d JOIN win USING (t, l)),
        pos AS (SELECT doc_id, unnest(range(st, st + l)) AS pos FROM (SELECT DISTINCT doc_id, st, l FROM hit)),
        cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM pos GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
               FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_extendible_sharding": f"""
        WITH k AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes,
                          md5(coalesce(doc_id::VARCHAR, 'null') || chr(10) || coalesce(text, '')) AS h FROM documents),
        a AS (SELECT doc_id, bytes, lpad(bin(('0x' || substr(h, 1, 15))::BIGINT), 60, '0') AS bits FROM k),
        d AS (SELECT doc_id, bytes, substr(bits, 1, depth) AS shard, depth FROM a, (SELECT unnest(range(0, 40))::INTEGER AS depth)),
        b AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM d GROUP BY depth, shard),
        f AS (SELECT d.*, shard_bytes, shard_rows FROM d JOIN b USING (depth, shard) WHERE shard_bytes <= (SELECT greatest(1, (sum(bytes)::BIGINT + {SHARDS - 1}) // {SHARDS}) FROM k) OR shard_rows = 1)
        SELECT doc_id, bytes, shard, depth, shard_bytes, shard_rows FROM f
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
    "op11_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        t AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
        a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, lang_n, v, total FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT *, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)) AS p, (1 + 1000000000::HUGEINT * (lang_n + 2) // (total + 2 * v)) AS q FROM a),
        pair AS (SELECT x.lang, x.source, y.source AS item, (sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)))::BIGINT AS value
                 FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
              FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
              UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM u QUALIFY part = 'pair' OR rank <= 10""",
}
