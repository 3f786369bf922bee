"""The monitoring run over tables in place: each stage is a batch, and a run goes on where it failed.

The log of a table tells which stages of which run it has, and what they read. A stage that is
there isn't computed again; the versions that the run began with are read until the end, except for
what the run itself has written, so a run that was broken off ends in the tables of one that was not.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.bucketed import BucketedTable
from .full_scan import Stage, stages

#: What a stage reads besides its own table, if there is any.
NEEDS = {"captures": "scrapes", "news": "search_hits"}


def stored_scan(
    tables: Mapping[str, BucketedTable], inputs: Mapping[str, DataFrame], as_of, run: str, performed_by: str = "scan",
    without: Collection[str] = (), given: Mapping[str, tuple[str, Stage]] | None = None,
) -> DataFrame:
    """Run the stages in order, each written to its table before the next begins; gives ``stage, outcome, rows, version, error``.

    ``inputs`` are what comes from outside (``scrapes``, ``search_hits``). A stage's outcome is
    ``success``, ``earlier`` (found in its table from a call before), ``skip`` (no input, or named in
    ``without``) or ``failure``; after a failure the rest is ``open``, and calling again with the same
    ``run`` goes on there. ``given`` replaces the stages.
    """
    planned = stages(as_of) if given is None else given
    versions = {name: t.version() for name, t in tables.items()}
    logs = {name: tables[table].done(f"{run}-{name}") for name, (table, _) in planned.items() if table in tables}
    for name, (table, _) in planned.items():  # what the stages found so far began with, and left
        if logs.get(name):
            versions = {**versions, **logs[name]["read"], table: logs[name]["version"]}
    summary: list[tuple[str, str, int | None, int | None, str]] = []
    broken = False
    for name, (table, stage) in planned.items():
        if name in without or table not in tables or NEEDS.get(name, table) not in (*tables, *inputs):
            summary.append((name, "skip", None, None, ""))
        elif logs[name]:
            summary.append((name, "earlier", logs[name]["rows"], logs[name]["version"], ""))
        elif broken:
            summary.append((name, "open", None, None, ""))
        else:
            state = {n: t.read(version=versions[n]) for n, t in tables.items()} | dict(inputs)
            try:
                added = cut_lineage(stage(state).drop("id").withColumn("performed_by", F.lit(performed_by)))
                rows = added.count()
                entry = tables[table].append(f"{run}-{name}", added, {"rows": rows, "read": dict(versions)}, kept=True)
            except (PySparkException, Py4JJavaError) as error:
                summary.append((name, "failure", None, None, str(error)))
                broken = True
                continue
            versions[table] = entry["version"]
            summary.append((name, "success", rows, entry["version"], ""))
    spark = next(iter(tables.values())).spark
    return spark.createDataFrame(summary, "stage string, outcome string, rows bigint, version bigint, error string")
