"""The sink with a commit list: nothing twice, nothing of a failed job, read back as written."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import detect
from tracewell.sources import committed
from tracewell.streaming import runs

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# Tasks may be tried three times; each fails once after it has written some of its rows.
RETRY = """
import os, sys
sys.path.insert(0, {repo!r})
from tracewell.session import build_session
from tracewell.sources import committed
spark = build_session("retry", "local[2,3]", spark__ui__enabled="false", spark__sql__execution__arrow__maxRecordsPerBatch="10")
spark.sparkContext.setLogLevel("OFF")
marks = {marks!r}

def once(batches):
    from pyspark import TaskContext
    mark = f"{{marks}}/{{TaskContext.get().partitionId()}}"
    first = not os.path.exists(mark)
    for k, batch in enumerate(batches):
        if first and k == 2:
            open(mark, "w").close()
            raise RuntimeError("this task fails once")
        yield batch

committed.write(spark.range(0, 400, 1, 4).mapInArrow(once, "id long"), {out!r})
rows = [r.id for r in committed.read(spark, {out!r}, "id long").collect()]
print(sorted(rows) == list(range(400)), len(os.listdir(marks)), len(os.listdir({out!r} + "/data")) >= 4)
"""


def test_tasks_that_fail_once_leave_nothing_twice(tmp_path):
    marks, out = str(tmp_path / "marks"), str(tmp_path / "out")
    os.mkdir(marks)
    done = subprocess.run([sys.executable, "-c", RETRY.format(repo=REPO, marks=marks, out=out)], capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["True", "4", "True"], done.stderr[-2000:]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write(spark.range(10), path)

    def fails(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield batch
            if TaskContext.get().partitionId() == 1:
                raise RuntimeError("no")

    with pytest.raises(Exception):
        committed.write(spark.range(0, 100, 1, 2).mapInArrow(fails, "id long"), path)
    assert sorted(r.id for r in committed.read(spark, path, "id long").collect()) == list(range(10))
    assert len(os.listdir(f"{path}/commits")) >= 1


def test_alerts_come_back_as_they_are(spark, tables, tmp_path):
    alerts = detect.alerts(*tables[:2])
    path = str(tmp_path / "alerts")
    committed.write(alerts, path)
    back = committed.read(spark, path, alerts.schema)
    show = lambda df: sorted(map(str, df.select(F.to_json(F.struct(*[c for c in df.columns if c not in ("module_scores",)])), F.array_sort(F.map_entries("module_scores"))).collect()))
    assert show(back) == show(alerts) and back.count() > 0


def test_streams_commit_each_batch_once(spark, tables, tmp_path):
    t = tables[1].select("transaction_id", "amount")
    path, run = str(tmp_path / "out"), runs.new_run(spark)
    for k in range(3):
        t.where(F.pmod(F.crc32("transaction_id"), F.lit(3)) == k).coalesce(1).write.parquet(f"{run}/in/p={k}")
    stream = lambda: spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in/p=*")
    committed.write_stream(stream(), path, f"{run}/c").awaitTermination()
    first = sorted(os.listdir(f"{path}/commits"))
    # A second query without the first one's checkpoint takes the same batches again: their commits stand.
    committed.write_stream(stream(), path, f"{run}/again").awaitTermination()
    assert sorted(os.listdir(f"{path}/commits")) == first and len([f for f in first if f.endswith(".json")]) == 3
    back = committed.read(spark, path, t.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


def test_nothing_committed_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    assert committed.read(spark, path, schemas.TRANSACTIONS).count() == 0
    committed.write(spark.range(0), path)
    assert committed.read(spark, path, "id long").count() == 0
