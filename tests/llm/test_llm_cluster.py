"""Executors of a cluster have no copy of the package: all queries run where workers can't import it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tracewell.session import build_session
spark = build_session("apart", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__driver__memory="2g")
spark.sparkContext.setLogLevel("OFF")

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("tracewell") is not None]}})

assert not any(r.found for r in spark.range(1).mapInArrow(importable, "found boolean").collect()), "the workers see the package"
import __spark_entry__ as entry
for name in {names!r}:
    print(name, len(entry.queries()[name](spark, "/root/testdata/sf0.001").collect()), flush=True)
"""


@pytest.mark.parametrize("part", range(2))
def test_queries_run_where_workers_have_no_package(tmp_path, part):
    from tracewell.llm.queries import QUERIES

    names = [*sorted(QUERIES), "pipeline"][part::2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith(("op", "pipeline"))] == names
