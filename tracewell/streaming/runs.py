"""Running a streaming query over the data at hand, and replaying tables through one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import columns as X
from tracewell.sources import readers
from tracewell.sources.slicing import STREAM_ORDER, interleave
from tracewell.session import fresh_dir

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default keeps milliseconds only


def new_run(spark: SparkSession) -> str:
    """Fresh folder for a query's checkpoint and output; starting over means taking a new one."""
    return fresh_dir(spark, "stream")


def drain(stream: DataFrame, run: str, name: str = "out") -> DataFrame:
    """Processes everything available, appending to a parquet folder, and reads the folder back."""
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", f"{run}/checkpoint-{name}").start(f"{run}/{name}"))
    _finish(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run}/{name}")


def drain_batches(stream: DataFrame, run: str, each: Callable[[DataFrame, int], None], name: str = "batches",
                  mode: str = "append") -> None:
    """Processes everything available through a foreachBatch function."""
    query = (stream.writeStream.foreachBatch(each).outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", f"{run}/checkpoint-{name}").start())
    _finish(query)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def late_rows(query) -> int:
    """Rows a query dropped so far because they came after the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def _slices(access: DataFrame, txns: DataFrame, chunks: int) -> list[DataFrame]:
    """The interleaved events cut into consecutive time slices, oldest first."""
    events = interleave(access, txns)
    span = events.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).alias("s"))
    at = F.try_divide(X.gap_seconds("_s.lo", "timestamp"), X.gap_seconds("_s.lo", "_s.hi"))
    sliced = events.withColumn("_s", span.scalar()).withColumn(
        "slice", F.coalesce(F.least(F.floor(at * chunks), F.lit(chunks - 1)), F.lit(0)).cast("int"))
    return [sliced.where(F.col("slice") == i).select("topic", "payload", *STREAM_ORDER) for i in range(chunks)]


def write_replay(access: DataFrame, txns: DataFrame, path: str, chunks: int = 4) -> str:
    """Both tables as tagged JSON events in ``chunks`` consecutive time slices, written oldest first."""
    for i, rows in enumerate(_slices(access, txns, chunks)):
        rows.write.option("timestampFormat", JSON_TIME).json(f"{path}/slice={i:04d}")
    return path


def read_replay(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of replayed events."""
    return readers.read_event_stream(spark, f"{path}/slice=*", schemas.EVENT_LINES, "json", max_files)


def replay(access: DataFrame, txns: DataFrame, run: str, each: Callable[[DataFrame, int], None], chunks: int = 4,
           through: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Feeds the tables through a foreachBatch function slice by slice, in time order; ``through`` is applied to the stream before.

    A slice may be many files; each is written and then processed as one batch of the same query, so a batch
    never sees events older than the batches before it.
    """
    spark = access.sparkSession
    for i, rows in enumerate(_slices(access, txns, chunks)):
        rows.write.option("timestampFormat", JSON_TIME).json(f"{run}/events/slice={i:04d}")
        stream = read_replay(spark, f"{run}/events")
        drain_batches(through(stream) if through else stream, run, each)


def replay_slices(slices: list[DataFrame], run: str, each: Callable[[DataFrame, int], None], key: str) -> None:
    """Feeds tables through a foreachBatch function, one batch of the same query each. A table is written by as many tasks as there are
    cores, dealt by ``key``, right before its batch: a file for a batch would have to pass through one task."""
    for i, rows in enumerate(slices):
        spark = rows.sparkSession
        rows.repartition(spark.sparkContext.defaultParallelism, key).write.parquet(f"{run}/in/p={i}")
        drain_batches(readers.read_event_stream(spark, f"{run}/in/p=*", rows.schema, "parquet"), run, each)


def split_topics(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed access and transaction rows of a tagged event table, batch or streaming."""
    topic = X.route_topic("topic")
    access = events.where(topic == "access_events").select(
        F.col("event_key").cast("long").alias("event_id"), F.from_json("payload", schemas.ACCESS).alias("e")).select("event_id", "e.*")
    txns = readers.decode(events.where(topic == "transactions"), schemas.TRANSACTIONS, "payload")
    return access, txns
