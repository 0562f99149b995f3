"""Readers and writers of tasks, results, scores, clips, media, texts and pages. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = "task_id string, video_url string, styles array<string>"
RESULTS = "task_id string, captions map<string,string>"
SCORES = "task_id string, style string, caption string, accuracy double, style_match double, reason string, judge_model string"
CLIPS = "task_id string, video_url string, content_hint string"
FACTS = "summary string, setting string, subjects array<string>, actions array<string>, mood string, audio_hint string, tech_visible boolean, camera string, temporal_progression string, visual_details array<string>, fine_grained_observations array<string>, salient_objects array<string>, spatial_relations array<string>, uncertainties array<string>"
TRAINING = f"facts struct<{FACTS.replace(' string', ': string').replace(' array', ': array').replace(' boolean', ': boolean')}>, style string, caption string"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON arrays. A missing path gives an empty table; text that isn't JSON gives rows with ``_corrupt_record``."""
    schema = f"{schema}, _corrupt_record string"
    try:
        return spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task rows of JSON arrays; of a file that can't be read, one row with ``_corrupt_record``."""
    return json_array(spark, path, TASKS)


def task_files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The tasks of a path, and a status: 0, or 1 where there is nothing to read or a file is no JSON array; then there are no tasks."""
    raw = tasks(spark, path)
    seen = raw.agg(F.count("*").alias("n"), F.count("task_id"), F.count("_corrupt_record").alias("bad")).first()  # Spark wants a column beside the record
    failed = seen["bad"] > 0 or seen["n"] == 0
    return (raw.limit(0) if failed else raw).drop("_corrupt_record"), int(failed)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Rows task_id, style, caption."""
    return json_array(spark, path, RESULTS).filter("_corrupt_record is null").select("task_id", F.explode("captions").alias("style", "caption"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def scores(spark: SparkSession, paths: str | list[str], depth: int = 1) -> DataFrame:
    """Score rows with ``run``: the last part of the file's path, or the ``depth``-th from its end, such as a folder.

    A file with an unreadable record, without rows, or with a score that is no number is left out as a whole.
    """
    text = SCORES.replace("accuracy double", "accuracy string").replace("style_match double", "style_match string")
    raw = spark.read.schema(f"{text}, _corrupt_record string").option("multiLine", True).json(paths).withColumn("_file", F.col("_metadata.file_path"))
    number = lambda c: F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()
    good = raw.groupBy("_file").agg(F.bool_and(F.col("_corrupt_record").isNull() & number("accuracy") & number("style_match")).alias("good")).filter("good")
    rows = raw.join(good.select("_file"), "_file", "left_semi").withColumn("run", F.element_at(F.split("_file", "/"), -depth)).drop("_corrupt_record", "_file")
    return rows.withColumn("accuracy", F.col("accuracy").try_cast("double")).withColumn("style_match", F.col("style_match").try_cast("double"))


def clips(spark: SparkSession, path: str) -> DataFrame:
    """The clip manifest; of repeated ids the last counts, in the order of the files' paths and of the rows in a file."""
    rows = json_array(spark, path, CLIPS).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())).filter("_corrupt_record is null")
    return rows.groupBy("task_id").agg(F.max_by(F.struct("video_url", "content_hint"), "_at").alias("c")).select("task_id", "c.video_url", "c.content_hint")


def media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def text_files(spark: SparkSession, path: str, suffixes: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Whole files of the suffixes, without those whose path holds an excluded part; the path filter comes before the read."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    allowed = F.rlike("path", F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    out = files.filter(allowed)
    for part in excluded:
        out = out.filter(~F.contains(F.col("path"), F.lit(part)))
    return out


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of task_id to text, as rows task_id, scene."""
    value = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    return value.select(F.explode("m").alias("task_id", "scene"))


def write_rows(df: DataFrame, path: str, kind: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Replace a table; the commit protocol makes it visible at once."""
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def missing_ids(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.join(stored.select(key), key, "left_anti")


def append_missing(wanted: DataFrame, path: str, key: str, make) -> None:
    """Make and append the rows of ids that the Parquet table at ``path`` doesn't hold yet."""
    spark = wanted.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        make(wanted).write.parquet(path)
        return
    make(missing_ids(wanted, stored, key)).write.mode("append").parquet(path)


def secrets(docs: DataFrame, patterns: Sequence[str], allowed: str | None = None) -> DataFrame:
    """Documents with the first pattern that they match; those that hold the allowed example are exempt as a whole."""
    matches = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.rlike(F.col("text"), p))
    out = docs.withColumn("pattern", F.get(matches, F.lit(0))).filter("pattern is not null")
    return out.filter(~F.contains(F.col("text"), F.lit(allowed))) if allowed else out


def payload_fits(parts: Sequence[Column], cap: int) -> Column:
    """Whether the bytes of all parts are within the cap."""
    total = F.octet_length(parts[0])
    for p in parts[1:]:
        total = total + F.octet_length(p)
    return total <= cap


#: A table below so many bytes is dealt over all cores, where it has fewer splits than there are; a shuffle of more costs more than it gains.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer splits than there are cores, such as one file, dealt over all cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df
