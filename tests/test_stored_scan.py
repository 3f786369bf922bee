from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.plans.full_scan import full_scan, stages
from pulsegrid.plans.stored_scan import stored_scan
from pulsegrid.sources.bucketed import BucketedTable

AS_OF = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 1, 20)
GROWING = {"snapshots": "snapshots", "change_records": "change_records", "news_articles": "news_articles", "company_statuses": "company_statuses"}


def beginning(spark):
    companies = spark.createDataFrame([(k, f"Initech{k}", f"https://initech{k}.example") for k in range(1, 7)], "id long, name string, homepage_url string")
    snapshots = spark.createDataFrame(
        [(10 * v + k, k, f"https://initech{k}.example", f"page {k} {'lawsuit bankruptcy' * (v == 1)}", f"c{k}{v * (k % 2)}", 200, NOW + dt.timedelta(days=v)) for v in range(2) for k in range(1, 7)],
        "id long, company_id long, url string, content_markdown string, content_checksum string, status_code int, captured_at timestamp_ntz")
    scrapes = spark.createDataFrame([(k, f"https://initech{k}.example", f"new page {k} data breach", "<html></html>", 200) for k in range(1, 4)],
                                    "company_id long, url string, markdown string, html string, status_code int")
    hits = spark.createDataFrame([(k, f"Initech{k} shuts down", f"https://initech{k}.example/press", f"Initech{k} announced closure", "2024-01-30T10:00:00+00:00") for k in range(1, 5)],
                                 "company_id long, title string, url string, snippet string, published string")
    frames = {"companies": companies, "snapshots": snapshots}
    return frames, {"scrapes": scrapes.withColumn("metadata", F.create_map(F.lit("a"), F.lit("b"))).withColumn("error", F.lit(None).cast("string")), "search_hits": hits.withColumn("id", F.col("company_id"))}


def tables(spark, place, frames):
    made = {n: BucketedTable(spark, f"{place}/{n}", n, 4) for n in ("companies", *GROWING)}
    for n, df in frames.items():
        made[n].append("start", df)
    return made


def content(table, *without):
    kept = [c for c in table.read().columns if c not in without]
    return sorted(map(str, table.read().select(*kept).collect()))


def outcomes(summary):
    return [(r.stage, r.outcome) for r in summary.collect()]


@pytest.mark.parametrize("failing", ["changes", "news", "status"])
def test_a_run_goes_on_where_it_failed(spark, tmp_path, failing):
    frames, inputs = beginning(spark)
    whole, broken = (tables(spark, f"file:{tmp_path}/{n}", frames) for n in ("whole", "broken"))
    assert {o for _, o in outcomes(stored_scan(whole, inputs, AS_OF, "jan"))} == {"success"}

    def lost(state):
        return state["companies"].select(F.raise_error(F.lit("lost")).alias("x"), "id")

    bad = {n: (t, lost if n == failing else s) for n, (t, s) in stages(AS_OF).items()}
    first = dict(outcomes(stored_scan(broken, inputs, AS_OF, "jan", given=bad)))
    order = list(bad)
    assert [first[n] for n in order] == ["success"] * order.index(failing) + ["failure"] + ["open"] * (3 - order.index(failing))
    kept = {n: broken[n].version() for n in GROWING}
    second = dict(outcomes(stored_scan(broken, inputs, AS_OF, "jan")))
    assert [second[n] for n in order] == ["earlier"] * order.index(failing) + ["success"] * (4 - order.index(failing))
    for n in order[:order.index(failing)]:
        assert broken[stages(AS_OF)[n][0]].version() == kept[stages(AS_OF)[n][0]]
    for n in GROWING:
        assert content(broken[n], "id") == content(whole[n], "id"), n
        assert broken[n].read().select("id").distinct().count() == broken[n].read().count() == whole[n].read().count() > 0
    # A third call finds all stages, and writes nothing.
    assert {o for _, o in outcomes(stored_scan(broken, inputs, AS_OF, "jan"))} == {"earlier"}
    assert {n: broken[n].version() for n in GROWING} == {n: whole[n].version() for n in GROWING}


def test_rows_equal_those_of_the_scan_on_frames(spark, tmp_path):
    frames, inputs = beginning(spark)
    whole = tables(spark, f"file:{tmp_path}", frames)
    stored_scan(whole, inputs, AS_OF, "jan")
    empty = {n: schemas.empty(spark, n) for n in GROWING if n not in frames}
    full = {n: spark.createDataFrame([], schemas.schema(n)).unionByName(df, allowMissingColumns=True) for n, df in frames.items()}
    state, _ = full_scan({**full, **empty, **inputs}, AS_OF)
    for n in GROWING:
        rows = whole[n].read().columns
        assert content(whole[n], "id") == sorted(map(str, state[n].select(*[c for c in rows if c != "id"]).collect())), n


def test_what_others_write_meanwhile_is_not_read(spark, tmp_path):
    frames, inputs = beginning(spark)
    made = tables(spark, f"file:{tmp_path}", frames)
    planned = stages(AS_OF)
    seen = {}

    def lost(state):
        raise __import__("pyspark.errors", fromlist=["PySparkException"]).PySparkException("lost")

    def looking(state):
        seen["companies"] = state["companies"].count()
        return planned["status"][1](state)

    stored_scan(made, inputs, AS_OF, "jan", given={"changes": planned["changes"], "status": ("company_statuses", lost)})
    made["companies"].append("later", spark.createDataFrame([(99, "Late", None)], "id long, name string, homepage_url string"))
    stored_scan(made, inputs, AS_OF, "jan", given={"changes": planned["changes"], "status": ("company_statuses", looking)})
    assert seen == {"companies": 6} and made["companies"].read().count() == 7


def test_skips(spark, tmp_path):
    frames, inputs = beginning(spark)
    made = tables(spark, f"file:{tmp_path}", frames)
    said = outcomes(stored_scan(made, {}, AS_OF, "r", without=("status",)))
    assert said == [("captures", "skip"), ("changes", "success"), ("news", "skip"), ("status", "skip")]


def test_page_texts_are_not_shuffled_for_few_companies(spark):
    """The newest pairs are few and their size is known, so texts meet them where they lie."""
    frames, _ = beginning(spark)
    full = {n: spark.createDataFrame([], schemas.schema(n)).unionByName(df, allowMissingColumns=True) for n, df in frames.items()}
    state = {**{n: schemas.empty(spark, n) for n in GROWING if n not in frames}, **full}
    for name in ("changes", "status"):
        plan = stages(AS_OF)[name][1](state)._jdf.queryExecution().optimizedPlan()
        joins = [line for line in plan.toString().split("\n") if "Join LeftSemi" in line and "(company_id" in line]
        assert joins
        sizes = [int(p.stats().sizeInBytes()) for p in _right_sides(plan)]
        assert sizes and max(sizes) < 10 << 20


def _right_sides(plan):
    """What semi joins on a company and an id look rows up in."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftSemi" and "id#" in node.condition().toString().replace("company_id#", ""):
            found.append(node.right())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_first_loads_are_not_shuffled(spark, tmp_path):
    """Each task writes its own files for each bucket, and rows are the same as dealt anew."""
    rows = spark.range(0, 400, 1, 4).selectExpr("id", "id % 40 AS company_id", "concat('u', id) AS url")
    whole, spread = (BucketedTable(spark, f"file:{tmp_path}/{n}", "snapshots", 2) for n in ("whole", "spread"))
    whole.append("start", rows)
    spread.append("start", rows, spread=True)
    assert content(whole) == content(spread)
    assert [len(list(tmp_path.glob(f"{n}/**/*.parquet"))) for n in ("whole", "spread")] == [2, 8]
