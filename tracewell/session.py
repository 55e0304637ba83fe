"""Session set-up, shared folders and size checks."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions that run in Python workers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["tracewell"])

# Inputs whose estimated size is below this may be handled by one task or broadcast.
SINGLE_TASK_BYTES = 64 << 20

# One state store for every stream of a session: large state stays off the heap, and restarts find what they left.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_DEFAULTS = {
    STATE_STORE[0]: STATE_STORE[1],
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and UTC time; extra settings by keyword (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Pin the zone in which ``timestamp_ntz`` columns become instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a scratch folder on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tracewell-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder that :func:`fresh_dir` named and nothing reads any more."""
    if not path.startswith(shared_dir(spark).rstrip("/")):
        raise ValueError(f"{path} is not in the shared folder")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is written or checkpointed inside leaves no shuffle files behind: each action's are removed as it ends. They would stay on
    the executors' disks until the driver has collected its garbage, which Python hands over to the JVM with a delay."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of an executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the result, or None where it cannot be read."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def setting(spark: SparkSession, name: str, default: int) -> int:
    """Integer tuning value, overridable as ``spark.tracewell.<name>``."""
    return int(spark.conf.get(f"spark.tracewell.{name}", str(default)))


def fits_one_task(df: DataFrame) -> bool:
    """True when the estimated size is known and small enough for a single task or a broadcast."""
    limit = setting(df.sparkSession, "singleTaskBytes", SINGLE_TASK_BYTES)
    size = plan_bytes(df)
    return size is not None and size <= limit
