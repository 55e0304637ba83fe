"""A sink with a commit list, for batch and stream: what is read back is what was committed, once.

Each task writes a file under a name of its own and reports it; the driver then writes one commit file that lists the files that count.
Readers go by the commit files, so rows of a task that failed, ran twice or belongs to a job that was given up are never seen, and
are removed where that is still possible. A stream's commit carries the batch's number: a batch that runs again finds its commit
and leaves it as it is. Paths are those that ``pyarrow.fs`` opens, in a folder all executors reach.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "committed_files"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Files:
    """What batch and stream writers share."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.job = path.rstrip("/"), schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _open(self.path)
        context = TaskContext.get()
        name = f"{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}.parquet"
        store.create_dir(f"{base}/data", recursive=True)
        writer, rows = None, 0
        for batch in iterator:
            if len(batch):
                writer = writer or pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
                rows += len(batch)
        if writer:
            writer.close()
        return Written(name if rows else "", rows)

    def _remove(self, messages: list) -> None:
        store, base = _open(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{base}/data/{m.file}").is_file:
                store.delete_file(f"{base}/data/{m.file}")

    def _list(self, messages: list, name: str) -> None:
        """Makes the files count, unless a commit of that name stands."""
        store, base = _open(self.path)
        store.create_dir(f"{base}/commits", recursive=True)
        if store.get_file_info(f"{base}/commits/{name}.json").is_file:
            return self._remove(messages)
        lines = "".join(json.dumps({"file": m.file, "rows": m.rows}) + "\n" for m in messages if m is not None and m.file)
        temp = f"{base}/commits/_{name}.{self.job}"  # readers pass over names that begin so
        with store.open_output_stream(temp) as out:
            out.write(lines.encode())
        store.move(temp, f"{base}/commits/{name}.json")


class _Batch(_Files, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._list(messages, self.job)

    def abort(self, messages: list) -> None:
        self._remove(messages)


class _Stream(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._list(messages, f"batch-{batchId:09d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._remove(messages)


class CommittedFiles(DataSource):
    """``df.write.format("committed_files").mode("append").save(path)``, or ``writeStream`` with ``option("path", path)``; appends only."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("this sink only appends")
        return _Batch(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedFiles)


def write(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format(FORMAT).mode("append").save(path)


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Starts a stream into ``path`` that ends when everything available is in."""
    register(df.sparkSession)
    return df.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The committed rows; none while nothing has been committed."""
    path = path.rstrip("/")
    try:
        files = [r["file"] for r in spark.read.schema("file string, rows long").json(f"{path}/commits").collect()]  # a row for each file
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in files]) if files else spark.createDataFrame([], schema)
