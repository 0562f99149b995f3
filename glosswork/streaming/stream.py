"""Streaming twins: results overlaid on seeds, audits of arriving captions, requests taken once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import last_by, overlay


def incremental_results(done: DataFrame, path: str, checkpoint: str, keys: Sequence[str], arrival: Sequence[str], wrote: Callable[[int], None] | None = None) -> StreamingQuery:
    """Keep the last row of each id, by ``arrival``, of every batch at ``path``/batch=N; ``results`` overlays them on the seeds.

    A batch writes its own rows only, whatever has been written before. One that is repeated after a restart overwrites its own folder and
    nothing else; until Spark has committed it, ``results`` doesn't see it. ``wrote`` is called with the number of a written, not yet committed batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        last_by(batch, keys, *arrival).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if wrote:
            wrote(number)

    return done.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_committed(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a checkpoint names as committed, -1 if there is none. All batches before it are committed too."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def results(spark: SparkSession, path: str, checkpoint: str, schema: str, seed: DataFrame, keys: Sequence[str], arrival: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """The seed rows with the last committed row of each id, or the defaults; a row of a later batch that arrived earlier doesn't win."""
    try:
        found = spark.read.schema(f"{schema}, batch int").parquet(path).filter(F.col("batch") <= last_committed(spark, checkpoint)).drop("batch")
    except AnalysisException as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], schema)
    return overlay(seed, found, keys, arrival, columns)


def audit(captions: DataFrame, codes: Callable[[DataFrame], Column], check: str) -> DataFrame:
    """The row-level audits are stateless, so they run on a stream unchanged."""
    from ..operators.captions import issues

    return issues(captions, codes(captions), check)


def requests_once(requests: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Requests of a key once within a span of event time.

    A key is held until the watermark, ``within`` behind the latest event, has passed its first event by the span; then its state goes and
    the key counts as new. Events older than the watermark are dropped. So state holds no more than the keys of two spans.
    """
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files and stop."""
    run = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run
