from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pulsegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of one expression over a list of values."""

    def evaluate(values, expression, schema="t string"):
        df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
        return [r[0] for r in df.coalesce(1).select(expression.alias("x")).collect()]

    return evaluate
