"""Late payments: kept beside the stream, counted, and the results they change taken back and replaced.

A batch's rows that are more than ``delay_s`` behind the newest time of earlier batches are late, and counted. They are stored like
all rows, and the burst results of payments whose windows hold a row that came after them are worked out again. Results go to a log: ``+1`` for a result that
holds from this batch on, ``-1`` for one that no longer does. Summed over any number of batches, the log is the batch answer over
the rows that have come by then.

Rows and results are stored by day, and a batch reads the days its windows touch, of the accounts it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.operators import structuring as B

RESULT = ["transaction_id", "account_id", "cluster_count", "aggregate_amount", "rule_matched"]
LOG = "transaction_id string, account_id string, cluster_count int, aggregate_amount double, rule_matched boolean, sign int, day date, batch int"
MARKS = "n_rows long, n_late long, high timestamp, batch int"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; without rows while no batch has written it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def burst_log(spark: SparkSession, store: str, window_s: float = C.BURST_WINDOW_SECONDS, delay_s: float = 86400.0) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for payments in any order: stores rows, counts late ones, writes the log of burst results.

    A batch that runs again overwrites its own folders and reads only those of batches before it.
    """
    window = F.expr(f"interval {int(window_s)} seconds")

    def each(batch: DataFrame, batch_id: int) -> None:
        schema = batch.schema
        day = F.to_date("timestamp")
        batch.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{store}/rows/batch={batch_id}")
        shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        every = stored(spark, f"{store}/rows", f"{shown}, day date, batch int").where(F.col("batch") <= batch_id)
        new = every.where(F.col("batch") == batch_id)
        high = stored(spark, f"{store}/marks", MARKS).where(F.col("batch") < batch_id).agg(F.max("high")).head()[0]
        limit = F.lit(None).cast("timestamp") if high is None else F.lit(high) - F.expr(f"interval {int(delay_s)} seconds")
        late = F.coalesce(F.col("timestamp") < limit, F.lit(False))
        new.agg(F.count("*").alias("n_rows"), F.count_if(late).alias("n_late"), F.greatest(F.max("timestamp"), F.lit(high)).alias("high")).write.mode("overwrite").parquet(f"{store}/marks/batch={batch_id}")
        # Windows of new rows reach back. A row that is older than one before it, late or not, changes those whose windows hold it.
        behind = F.coalesce(F.col("timestamp") <= F.lit(high).cast("timestamp"), F.lit(False))
        touched = new.select(F.explode(F.sequence(F.to_date(F.col("timestamp") - window), F.to_date(F.when(behind, F.col("timestamp") + window).otherwise(F.col("timestamp"))))).alias("day"))
        days = [r[0] for r in touched.distinct().collect()]
        accounts = new.select("account_id").distinct()
        near = every.where(F.col("day").isin(days)).join(accounts, "account_id", "left_semi")
        flagged = near.withColumns({"_new": F.col("batch") == batch_id, "_us": X.micros("timestamp")})
        back = Window.partitionBy("account_id").orderBy("_us").rangeBetween(-int(window_s * 1e6), 0)
        asked = flagged.withColumn("_asked", F.max(F.col("_new").cast("int")).over(back) == 1).drop("_us", "_new")
        result = B.burst_rule(asked, window_s).where("_asked").select(*RESULT, "day")
        log = stored(spark, f"{store}/log", LOG).where((F.col("batch") < batch_id) & F.col("day").isin(days))
        before = current(log).select(F.col("transaction_id").alias("_id"), F.struct(*RESULT).alias("_before"))
        both = result.withColumn("_after", F.struct(*RESULT)).join(before, F.col("transaction_id") == F.col("_id"), "left")
        differs = both.where(F.col("_before").isNull() | (F.col("_before") != F.col("_after")))
        entry = lambda c, sign: F.struct(c.alias("r"), F.lit(sign).alias("sign"))
        ops = F.when(F.col("_before").isNull(), F.array(entry(F.col("_after"), 1))).otherwise(F.array(entry(F.col("_before"), -1), entry(F.col("_after"), 1)))
        out = differs.select("day", F.explode(ops).alias("_op")).select("_op.r.*", "_op.sign", "day")
        out.write.mode("overwrite").partitionBy("day").parquet(f"{store}/log/batch={batch_id}")

    return each


def current(log: DataFrame) -> DataFrame:
    """The results that hold: those of which one more was added than taken back."""
    return log.groupBy(*RESULT).agg(F.sum("sign").alias("_n")).where("_n > 0").drop("_n")


def counts(spark: SparkSession, store: str) -> DataFrame:
    """Rows and late rows of each batch."""
    return stored(spark, f"{store}/marks", MARKS).select("batch", "n_rows", "n_late")
