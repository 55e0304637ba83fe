import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tuned(spark):
    """Sets tuning values for one test."""
    names = []

    def set_(**values):
        for name, value in values.items():
            spark.conf.set(f"spark.tracewell.{name}", str(value))
            names.append(f"spark.tracewell.{name}")

    yield set_
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(scope="session")
def tables(spark):
    from tracewell.sources import views

    return views.access_view(spark, SF), views.transactions_view(spark, SF), views.ledger_view(spark, SF)
