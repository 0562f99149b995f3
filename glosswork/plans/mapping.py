"""How the given tables stand for the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.io import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as captions: task from source, style from lang."""
    style = F.when(F.col("lang") == "en", "formal").when(F.col("lang") == "fr", "sarcastic").when(F.col("lang") == "de", "humorous_tech").otherwise("humorous_non_tech")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task_id"), style.alias("style"), F.col("text").alias("caption"))


def with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captions with facts: the first sentence is the summary, the next five the details, three more the objects, all others observations."""
    sentences = F.filter(F.transform(F.split("caption", "[.\n]"), lambda x: F.trim(x)), lambda x: x != "")
    facts = F.struct(F.get("_s", F.lit(0)).alias("summary"), F.slice("_s", 2, 5).alias("visual_details"), F.slice("_s", 7, 3).alias("salient_objects"), F.slice("_s", F.lit(10), F.greatest(F.size("_s") - 9, F.lit(0))).alias("fine_grained_observations"), F.col("task_id").alias("setting"))
    return captions(spark, sf_dir).withColumn("_s", sentences).withColumn("facts", facts).drop("_s")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as score rows: run from source, style from lang."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run"), "lang")
    labels = read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "run", "lang", F.col("quality").cast("double").alias("accuracy"), (F.lit(1.0) - F.col("toxic")).alias("style_match"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model attempts of a task (user, day); an error event is a failure."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 4).otherwise(5)
    return read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), rank.alias("provider_rank"), F.col("event_id").alias("model_rank"), (F.col("event_type") != "error").alias("ok"), "value")


STYLE_SQL = "CASE lang WHEN 'en' THEN 'formal' WHEN 'fr' THEN 'sarcastic' WHEN 'de' THEN 'humorous_tech' ELSE 'humorous_non_tech' END"
CAPTIONS_SQL = f"(SELECT doc_id, source AS task_id, {STYLE_SQL} AS style, text AS caption FROM documents)"
SCORES_SQL = "(SELECT d.doc_id, d.source AS run, d.lang, l.quality::DOUBLE AS accuracy, 1.0::DOUBLE - l.toxic AS style_match FROM documents d JOIN labels l USING (doc_id))"
SENTENCES_SQL = "list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), x -> trim(x)), x -> x <> '')"
STYLES = rules.STYLES
