from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.dates import latest_post_date
from pulsegrid.functions.text import acquisition_mention, copyright_year
from pulsegrid.operators import status as S
from pulsegrid.operators.social import social_digest

AS_OF = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 2, 1)


def by_rules(p, n, u, previous):
    sure = min(1.0, 0.4 * (p + n) + 0.2 * u)
    if n == 0:
        return "operational" if previous == "uncertain" and p >= 2 else previous or "operational"
    if sure < 0.4:
        return "uncertain"
    if sure >= 0.7:
        return "likely_closed"
    return "operational" if p > n else "likely_closed" if n > p else "uncertain"


def test_decisions(spark):
    cases = list(itertools.product(range(4), range(4), range(4), (None, "operational", "uncertain", "likely_closed")))
    df = spark.createDataFrame(cases, "p int, n int, u int, prev string").coalesce(1)
    sure = S.confidence(F.col("p"), F.col("n"), F.col("u"))
    got = [r[0] for r in df.select(S.decide_status(sure, F.col("p"), F.col("n"), F.col("prev"))).collect()]
    assert got == [by_rules(*c) for c in cases]


@pytest.mark.parametrize(("text", "year"), [
    ("(c) 2019", 2019), ("Copyright 2018-2023 x © 2020", 2023), ("© 2017 – 2021", 2021), ("in 2024 we", None), ("(C)2022", 2022)])
def test_copyright_year(rows, text, year):
    assert rows([text], copyright_year("t")) == [year]


@pytest.mark.parametrize(("text", "found"), [
    ("It was Acquired By Big Co.", "It was Acquired By Big Co."), ("goods sold to customers daily", None),
    ("sold to   the public; later sold to Big Co", "sold to   the public; later sold to Big Co"), ("X is now available", None),
    ("merged with A after being acquired by B", "merged with A after being acquired by B"), ("SOLD TO end-users", None)])
def test_acquisition(rows, text, found):
    assert rows([text], acquisition_mention("t")) == [found]


@pytest.mark.parametrize(("text", "date"), [
    ("2024-01-15 and 2024-02-30", "2024-01-15"), ("Feb 30, 2023", None), ("1999-12-31", None), ("2024-02-02", "2024-02-02"),
    ("2024-02-03", None), ("January 5, 2024", "2024-01-05"), ("5 sept 2023", "2023-09-05"), ("3 days ago", "2024-01-29"),
    ("2 weeks ago", "2024-01-18"), ("1 month ago", "2024-01-02"), ("99999999999 days ago", None), ("", None), ("12 May 2023 or June 1 2023", "2023-06-01")])
def test_post_dates(rows, text, date):
    got = rows([text], latest_post_date("t", AS_OF))[0]
    assert (got and got.strftime("%Y-%m-%d")) == date


def tables(spark):
    companies = spark.createDataFrame([(i, f"C{i}") for i in range(1, 7)], "id long, name string")
    snapshots = spark.createDataFrame([
        (1, 1, NOW, "fine (c) 2024", None), (2, 2, NOW, "acquired by X", None), (3, 3, NOW, None, "err"), (4, 4, NOW, "page", None), (5, 5, NOW, "page", None)],
        "id long, company_id long, captured_at timestamp_ntz, content_markdown string, error_message string")
    statuses = spark.createDataFrame([
        (1, 1, "uncertain", False), (2, 4, "operational", True), (3, 5, "operational", True), (4, 5, "uncertain", False)],
        "id long, company_id long, status string, is_manual_override boolean")
    news = spark.createDataFrame([
        (1, 5, NOW - dt.timedelta(days=2), "T", "s.org", "significant", "negative", 0.8, ["closure", "x"]),
        (2, 5, NOW - dt.timedelta(days=1), "U", "s.org", "significant", "negative", 0.5, ["closure"]),
        (3, 1, NOW - dt.timedelta(days=89), "V", None, "significant", "positive", 0.9, [])],
        "id long, company_id long, published_at timestamp_ntz, title string, source string, significance_classification string, "
        "significance_sentiment string, significance_confidence double, matched_categories array<string>")
    return companies, snapshots, statuses, news


def test_whole_analysis(spark):
    companies, snapshots, statuses, news = tables(spark)
    rows, signals = S.analyze_status(companies, snapshots, statuses, AS_OF, news=news)
    got = {r.company_id: r for r in rows.collect()}
    assert set(got) == {1, 2, 5}  # 3 has no text, 4 is set by hand, 6 was never captured
    assert (got[1].status, got[1].confidence, got[1].positive_count) == ("operational", 0.8, 2)
    assert (got[2].status, got[2].confidence) == ("likely_closed", 0.4)
    assert (got[5].status, got[5].confidence) == ("likely_closed", 0.95)
    assert got[5].status_reason == "news_veto: s.org -- T [closure, conf=0.80]"
    assert signals.count() == sum(r.positive_count + r.negative_count + r.neutral_count for r in got.values())


def test_a_company_of_very_many_signals_loses_none(spark):
    companies, snapshots, statuses, news = tables(spark)
    many = spark.range(1001).selectExpr(
        "id", "1L AS company_id", "timestamp_ntz '2024-01-20 00:00:00' AS published_at", "concat('t', id) AS title", "'s' AS source",
        "'significant' AS significance_classification", "'positive' AS significance_sentiment", "0.9D AS significance_confidence",
        "cast(array() AS array<string>) AS matched_categories")
    rows, signals = S.analyze_status(companies, snapshots, statuses, AS_OF, news=many)
    assert {r.company_id: r.positive_count for r in rows.collect()}[1] == 1002
    assert signals.filter("company_id = 1").count() == 1002


def test_override_and_clearing(spark):
    _, _, statuses, _ = tables(spark)
    asked = spark.createDataFrame([(1, "likely_closed"), (2, "nonsense")], "company_id long, status string")
    log, refused = S.manual_override(statuses, asked, AS_OF, "me")
    assert refused.collect()[0].status == "nonsense" and log.count() == 5
    assert log.filter("performed_by = 'me'").first().indicators[0].type == "manual_override"
    cleared = S.clear_override(statuses, asked.limit(1).selectExpr("cast(4 as long) as company_id"), AS_OF, "me")
    last = cleared.filter("performed_by = 'me'").first()
    assert (last.company_id, last.status, last.is_manual_override) == (4, "operational", False)
    now = {r.company_id: (r.status, r.is_manual_override) for r in S.current_status(cleared).collect()}
    assert now[4] == ("operational", False)
    now = {r.company_id: (r.status, r.is_manual_override) for r in S.current_status(log).collect()}
    assert now[1] == ("likely_closed", True) and log.filter("id is null").count() == 0


def test_digest_has_every_source_with_its_whole_text(spark):
    data = [(i, 1, f"https://s/{i}", "blog", "text", "c", NOW, NOW) for i in range(130)] + [(500, 2, "https://s", "medium", "x" * 3000, "c", NOW, None)]
    df = spark.createDataFrame(data, "id long, company_id long, source_url string, source_type string, content_markdown string, content_checksum string, captured_at timestamp_ntz, latest_post_date timestamp_ntz")
    rows = social_digest(df, AS_OF).collect()
    assert sum(r.company_id == 1 for r in rows) == 130
    (one,) = [r for r in rows if r.company_id == 2]
    assert one.state == "INACTIVE (no posting date found)" and one.content == "x" * 3000


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_zone(spark, rows, zone):
    from pulsegrid.functions.dates import days_since
    from pulsegrid.functions.text import parse_http_date, parse_iso

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [str(x) for x in rows(["2024-11-03T06:30:00+00:00", "2024-03-10T02:30:00Z"], parse_iso("t"))] == ["2024-11-03 06:30:00", "2024-03-10 02:30:00"]
        assert str(rows(["Sun, 03 Nov 2024 06:30:00 GMT"], parse_http_date("t"))[0]) == "2024-11-03 06:30:00"
        days = days_since(F.col("t").cast("timestamp_ntz"), "2024-03-11 00:00:00")
        assert rows(["2024-03-09 00:00:00", "2024-03-09 00:00:01", "2024-03-12 00:00:00", "2024-03-10 23:00:00"], days) == [2, 1, -1, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
