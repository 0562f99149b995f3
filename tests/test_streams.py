"""Streams that stop between write and commit, and state that the watermark evicts."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from glosswork.streaming import stream

SCHEMA = "id long, arrived long, status string"


def test_results_survive_a_run_that_stops_before_its_commit(spark, tmp_path):
    base, seed = str(tmp_path), spark.range(8).withColumn("id", F.col("id"))
    for k in range(6):  # file k holds ids k and k + 1; later files may hold earlier arrivals
        rows = [(k, 10 + k, f"a{k}"), (k + 1, 20 - k, f"b{k}")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    columns = {"status": F.lit("fallback")}

    def run(wrote=None):
        done = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        return stream.incremental_results(done, f"{base}/out", f"{base}/checkpoint", ["id"], ["arrived"], wrote)

    def now():
        return {r["id"]: r["status"] for r in stream.results(spark, f"{base}/out", f"{base}/checkpoint", SCHEMA, seed, ["id"], ["arrived"], columns).collect()}

    assert stream.last_committed(spark, f"{base}/checkpoint") == -1
    assert now() == dict.fromkeys(range(8), "fallback")  # every seed has a row before anything has arrived

    def stop(number):
        if number == 1:
            raise RuntimeError("stopped after the write")

    with pytest.raises(StreamingQueryException):
        run(stop).awaitTermination()
    assert stream.last_committed(spark, f"{base}/checkpoint") == 0
    assert spark.read.parquet(f"{base}/out/batch=1").count() > 0
    first = now()
    seen = {r["id"] for r in spark.read.parquet(f"{base}/out/batch=0").collect()}
    assert {i for i, s in first.items() if s != "fallback"} == seen  # what isn't committed isn't seen

    numbers = []
    run(numbers.append).awaitTermination()
    assert numbers == [1, 2]
    last = {}
    for r in spark.read.schema(SCHEMA).parquet(f"{base}/in").collect():
        last[r["id"]] = max(last.get(r["id"], (-1, "")), (r["arrived"], r["status"]))
    assert now() == {i: last[i][1] if i in last else "fallback" for i in range(8)}
    run(numbers.append).awaitTermination()
    assert numbers == [1, 2]  # nothing new, nothing done


def test_keys_come_again_after_the_span(spark, tmp_path):
    base, schema = str(tmp_path), "key string, at timestamp"

    def send(*rows):
        spark.createDataFrame([(k, h * 3600) for k, h in rows], "key string, s long").select("key", F.timestamp_seconds("s").alias("at")).write.mode("append").parquet(f"{base}/in")
        before = spark.read.schema(schema).parquet(f"{base}/out").count() if (tmp_path / "out").exists() else 0
        once = stream.requests_once(spark.readStream.schema(schema).parquet(f"{base}/in"), "key", "at", "1 hour")
        run = stream.append(once, f"{base}/out", f"{base}/checkpoint")
        return spark.read.schema(schema).parquet(f"{base}/out").count() - before, run.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert send(("a", 100), ("b", 100)) == (2, 2)
    assert send(("a", 100), ("c", 101)) == (1, 3)  # a is repeated inside the span
    new, held = send(("d", 103))
    assert (new, held) == (1, 1)  # the watermark has passed the others, their state is gone
    assert send(("a", 103)) == (1, 2)  # after the span it comes again
    assert send(("b", 101)) == (0, 2)  # older than the watermark
    for hour in range(104, 110):
        assert send((f"k{hour}", hour))[1] <= 4
