"""Operators run on empty tables of the declared schemas and give rows that fit them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.operators.changes import change_records, social_change_records
from pulsegrid.operators.dashboards import companies_list
from pulsegrid.operators.latest import earliest_without_baseline
from pulsegrid.operators.quality import check_constraints, table_rules
from pulsegrid.operators.status import analyze_status, newest_texts, posting_activity
from pulsegrid.session import shared_dir

AS_OF = "2024-02-01 00:00:00"


def fits(df, table):
    known = dict(schemas.empty(df.sparkSession, table).dtypes)
    return [(c, t) for c, t in df.dtypes if c in known and known[c] != t]


def test_results_fit_their_tables(spark):
    t = {name: schemas.empty(spark, name) for name in schemas.TABLES}
    assert fits(change_records(t["snapshots"], AS_OF), "change_records") == []
    assert fits(social_change_records(t["social_media_snapshots"], AS_OF), "social_media_change_records") == []
    rows, _ = analyze_status(t["companies"], t["snapshots"], t["company_statuses"], AS_OF, t["social_media_snapshots"],
                             t["news_articles"], t["leadership_changes"])
    assert fits(rows, "company_statuses") == [] and rows.count() == 0
    assert companies_list(t, AS_OF).count() == 0
    for name, rules in table_rules(AS_OF).items():
        assert check_constraints(t[name], rules).count() == 0


def test_stored_texts_stay_where_they_lie(spark):
    """Tables bucketed by company: these plans have no exchange, broadcasts off."""
    name = f"snapshots_{uuid.uuid4().hex[:8]}"
    rows = spark.range(60).selectExpr("id", "id % 7 AS company_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS captured_at",
                                      "concat('text ', id) AS content_markdown", "cast(id AS string) AS content_checksum")
    schemas.store(rows, "snapshots", name, buckets=4, path=f"{shared_dir(spark)}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.table(name)
        assert table.columns == schemas.schema("snapshots").names
        sources = table.withColumn("source_url", F.col("content_checksum")).withColumn("source_type", F.lit("blog"))
        for df in (newest_texts(table), earliest_without_baseline(table), posting_activity(sources, AS_OF)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
            assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
