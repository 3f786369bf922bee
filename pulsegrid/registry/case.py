"""A checked query: how Spark runs it, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testbed import domain, mapping_sql, raw


class Bed:
    """The mapped tables of one scale, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return domain(self.spark, self.sf_dir, name)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)


class Case(NamedTuple):
    run: Callable[[Bed], DataFrame]
    sql: str | None = None


def with_tables(names: str, body: str, extra: str = "") -> str:
    """``body`` over the mapped tables ``names`` (blank-separated), ``extra`` CTEs between."""
    parts = [mapping_sql(n) for n in names.split()] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body


def stamp(c: str | Column, name: str | None = None) -> Column:
    """A time as text, as both engines print it."""
    column = F.col(c) if isinstance(c, str) else c
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or str(c))


def day(c: str | Column, name: str) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.date_format(column, "yyyy-MM-dd").alias(name)


def joined(c: str | Column, name: str, sep: str = "|") -> Column:
    return F.array_join(c, sep).alias(name)


def time_sql(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def day_sql(c: str, name: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name}"
