from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as A
from pulsegrid.operators import latest as L
from pulsegrid.operators import quality as R
from pulsegrid.operators import tables as W
from pulsegrid.operators.changes import change_records
from pulsegrid.session import cut_lineage, shared_dir
from pulsegrid.sources import feeds as X
from pulsegrid.streaming.streams import ChangeFeed, with_bucket

NOW = dt.datetime(2024, 2, 1)
AS_OF = "2024-02-01 00:00:00"


@pytest.fixture
def place(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex[:10]}"


def test_insert_is_idempotent(spark, place):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1)], "id long, u string, c long")
    empty = rows.limit(0)
    once = W.insert_ignore(empty, rows, ["c", "u"], ["id"])
    assert sorted(r.id for r in once.collect()) == [1, 3]
    assert W.insert_ignore(once, rows, ["c", "u"], ["id"]).count() == 2
    W.append_new(empty, rows, ["c", "u"], ["id"], place)
    W.append_new(spark.read.parquet(place), rows, ["c", "u"], ["id"], place)
    assert spark.read.parquet(place).count() == 2


def test_upsert_matches_null_homepages(spark):
    schema = "id long, name string, homepage_url string, source_sheet string, updated_at timestamp_ntz"
    old = spark.createDataFrame([(1, "A", None, "x", NOW), (2, "B", "u", "x", NOW)], schema)
    new = spark.createDataFrame([(9, "A", None, "y", NOW), (8, "B", "v", "y", NOW), (7, "B", "v", "z", NOW)], schema)
    got = {(r.id, r.name, r.source_sheet) for r in W.upsert_companies(old, new, "2025-01-01").collect()}
    assert got == {(1, "A", "y"), (2, "B", "x"), (8, "B", "y")}


def test_delete_and_audit(spark):
    links = spark.createDataFrame([(1, 1), (2, 1), (1, None)], "id long, company_id long")
    rest, audit = W.delete_row(links, 1, 1, "link", AS_OF, "me")
    assert rest.count() == 2 and audit.first().error_message == "link 1 removed from company 1"
    tables = W.delete_cascade({"companies": links.select("id"), "snapshots": links}, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in tables["companies"].collect()] == [2] and tables["snapshots"].count() == 1


def test_shared_folder_comes_from_the_session(spark, place):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir() is not None


def test_report_is_json(spark, place):
    X.write_report(spark.createDataFrame([("a", 1)], "k string, v int"), place)
    text = spark.read.text(place).first()[0]
    assert json.loads(text) == {"k": "a", "v": 1}


def test_constraints(spark):
    df = spark.createDataFrame([(1, " ", "S", "ftp://x", True, None), (2, "A", "S", "https://x", False, None)],
                               "id long, name string, source_sheet string, homepage_url string, flagged_for_review boolean, flag_reason string")
    rules = R.table_rules(AS_OF)["companies"]
    assert {r.rule for r in R.check_constraints(df, rules).collect()} == {"name_filled", "homepage_url_valid", "flag_reason_given"}
    assert {r.rule: r.violations for r in R.violation_rates(df, rules).collect()}["name_filled"] == 1


def test_cutoff_days_count_by_date(spark):
    changes = spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 2, 0, 0, 1), True, "significant"), (2, 1, dt.datetime(2024, 1, 1, 23, 59), True, "significant")],
        "id long, company_id long, detected_at timestamp_ntz, has_changed boolean, significance_classification string")
    assert changes.filter(A.on_or_after("detected_at", "2024-02-01 12:00:00", 30)).count() == 1


def test_no_scan_before_gives_zeros(spark):
    snapshots = spark.createDataFrame([(NOW,)], "captured_at timestamp_ntz")
    changes = spark.createDataFrame([(1, NOW, True, "major", "significant")], "company_id long, detected_at timestamp_ntz, has_changed boolean, change_magnitude string, significance_classification string")
    row = A.changes_since_last_scan(snapshots, changes).first()
    assert (row.total_changes, row.major, str(row.scan_date)) == (0, 0, "2024-02-01")


def test_documents_find_companies(spark):
    companies = spark.createDataFrame([(1, "A", "https://a.com"), (2, "B", "https://a.com/b"), (3, "C", "https://c.com"), (4, "D", None)],
                                      "id long, name string, homepage_url string")
    docs = spark.createDataFrame([("https://a.com",), ("https://a.com/b/c",), ("https://r.net/?u=https://c.com/x",), ("https://z.com",), (None,)], "url string")
    matched, unmatched, missing = X.match_documents(docs, companies)
    assert {(r.url, r.company_id) for r in matched.collect()} == {("https://a.com", 1), ("https://a.com/b/c", 1), ("https://r.net/?u=https://c.com/x", 3)}
    assert unmatched.count() == 2 and [r.id for r in missing.collect()] == [2]


def test_any_homepage_is_found_inside_a_url(spark):
    import random

    rng = random.Random(9)
    bit = lambda n: "".join(rng.choice("ab./") for _ in range(rng.randrange(n)))
    homes = [*{bit(9) for _ in range(60)} - {""}, "initech.example", "https://initech.example", "www.initech.example/"]
    urls = [*{bit(30) for _ in range(300)}, "https://www.initech.example/a", "x", ""]
    companies = spark.createDataFrame([(k, h) for k, h in enumerate(homes)], "id long, homepage_url string")
    docs = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {(r.url, r.homepage_url) for r in X.containing(docs, companies.select("homepage_url")).collect()}
    assert got == {(u, h) for u in urls for h in homes if h in u}
    everywhere = spark.createDataFrame([(1, "N", "")], "id long, name string, homepage_url string")
    assert X.match_documents(docs, everywhere)[0].count() == len(urls)


def test_nothing_that_grows_with_homepages_is_broadcast(spark):
    companies = spark.range(50).selectExpr("id", "'N' AS name", "concat('https://c', id, '.example.com') AS homepage_url")
    docs = spark.range(200).selectExpr("concat('https://r.net/?u=https://c', id, '.example.com/x') AS url")
    for result, rows in zip(X.match_documents(docs, companies), (50, 150, 0)):
        assert result.count() == rows
        assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()


SNAPSHOT = "id long, company_id long, captured_at timestamp_ntz, content_markdown string, content_checksum string, error_message string"


@pytest.mark.parametrize("buckets", [None, 3])
def test_stream_equals_batch_and_reruns(spark, place, buckets):
    data = [(i, i % 4, NOW + dt.timedelta(hours=i), f"text {i % 5} lawsuit" * (i % 3), str(i % 5), None) for i in range(60)]
    archive = spark.createDataFrame(data, SNAPSHOT)
    stored = with_bucket(archive, buckets) if buckets else archive
    feed = ChangeFeed(spark, f"{place}/records", f"{place}/state", lambda: stored, compact_every=2, buckets=buckets)
    for n in range(5):
        feed.process(archive.filter(f"id div 12 = {n}"), n)
    feed.process(archive.filter("id div 12 = 4"), 4)  # the last batch again
    feed.process(archive.filter("id < 10"), 5)  # all late
    columns = ["company_id", "snapshot_id_old", "snapshot_id_new", "has_changed", "change_magnitude", "significance_classification"]
    stream = {tuple(r) for r in spark.read.parquet(f"{place}/records").select(*columns).collect()}
    batch = change_records(archive, AS_OF, pairing="all").select(*columns).collect()
    assert len(batch) == 56 and stream == {tuple(r) for r in batch}
    assert spark.read.parquet(f"{place}/records").count() == 56
    late = spark.read.parquet(f"{place}/records-late")
    assert {r.id for r in late.filter("batch = 5").collect()} == set(range(10))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_at_scale(spark):
    snapshots = spark.createDataFrame([], SNAPSHOT)
    pairs = plan(L.snapshot_pairs(snapshots))
    assert "WindowGroupLimit" in pairs and "content_markdown" not in pairs.split("Scan")[0]
    assert "WindowGroupLimit" in plan(W.first_per_key(snapshots, ["company_id"], ["id"]))
    for df in (L.latest_with_ties(snapshots, ["company_id"], "captured_at"), X.match_documents(
            snapshots.selectExpr("content_markdown as url"), snapshots.selectExpr("id", "error_message as name", "content_checksum as homepage_url"))[0]):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_tier_counts_sum_to_companies(spark):
    companies = spark.createDataFrame([(i, f"C{i}") for i in range(9)], "id long, name string")
    snapshots = spark.createDataFrame([(i, NOW - dt.timedelta(days=d)) for i, d in enumerate((0, 7, 8, 30, 31, 90, 91))], "company_id long, captured_at timestamp_ntz")
    statuses = spark.createDataFrame([(1, 8, "likely_closed", True)], "id long, company_id long, status string, is_manual_override boolean")
    counts = {r.tier: r.companies for r in A.freshness_counts(A.freshness_tiers(companies, snapshots, statuses, AS_OF)).collect()}
    assert counts == {"fresh": 2, "recent": 2, "stale": 2, "very_stale": 1, "never": 1, "manually_closed": 1}


def test_appended_rows_get_ids_above_all_others(spark):
    target = spark.createDataFrame([(7, 1, "x"), (3, 2, "y")], "id long, company_id long, status string")
    rows = spark.range(25).selectExpr("id AS company_id", "'new' AS status").repartition(5)
    log = W.append_log(target, rows, "me")
    ids = [r.id for r in log.filter("performed_by = 'me'").collect()]
    assert sorted(ids) == list(range(8, 33))
    again = W.append_log(target.limit(0), rows.limit(2), "me")
    assert sorted(r.id for r in again.collect()) == [1, 2]
    assert W.append_log(target, rows.limit(0), "me").count() == 2


def test_news_urls_are_known_for_ever(spark, place):
    from pulsegrid.streaming.streams import stream_dedupe_news

    schema = "content_url string, discovered_at timestamp_ntz, title string"
    for n, (day, urls) in enumerate(((1, "ab"), (400, "bc"), (1, "ad"))):
        rows = [(u, NOW + dt.timedelta(days=day, hours=h), f"{u}{n}{h}") for u in urls for h in (1, 0)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{place}/inbox")
        stream = spark.readStream.schema(schema).parquet(f"{place}/inbox")
        stream_dedupe_news(stream, f"{place}/out", f"{place}/progress", availableNow=True).awaitTermination()
    got = {r.content_url: r.title for r in spark.read.parquet(f"{place}/out").collect()}
    assert got == {"a": "a00", "b": "b00", "c": "c10", "d": "d20"}
    assert spark.read.parquet(f"{place}/out").count() == 4


def test_a_batch_reads_little_of_a_grown_memory(spark, place):
    """New URLs open next to nothing, known ones their buckets; ten times the history is no more to read."""
    from pulsegrid.streaming.streams import UrlMemory

    memory = UrlMemory(spark, f"{place}/known", buckets=16, bits=1 << 17, compact_every=3)
    frame = lambda rows: spark.createDataFrame([(u,) for u in rows], "content_url string")
    opened, batch = {}, 0
    for size in (1, 10):
        memory.add(frame([f"https://n.example/{batch}/{k}" for k in range(size * 300)]), batch)
        batch += 1
        assert memory.known(frame([f"https://new.example/{size}/{k}" for k in range(40)]), batch) is None or len(memory.opened) <= 3
        opened[size] = len(memory.opened)
        again = memory.known(frame(["https://n.example/0/7", "https://n.example/0/8", "https://new.example"]), batch)
        assert {r.content_url for r in again.collect()} == {"https://n.example/0/7", "https://n.example/0/8"} and len(memory.opened) <= 3
    assert opened[10] <= opened[1] + 3
    # A batch that is run again knows what came before it only, and replaces what it wrote.
    memory.add(frame(["x", "y"]), batch)
    memory.add(frame(["x", "y"]), batch)
    assert memory.known(frame(["x"]), batch) is None or memory.known(frame(["x"]), batch).count() == 0
    assert {r.content_url for r in memory.known(frame(["x", "z"]), batch + 1).collect()} == {"x"}
    for n in range(batch + 1, batch + 4):  # past a compaction of the filters
        memory.add(frame([f"late{n}"]), n)
    assert {r.content_url for r in memory.known(frame(["x", f"late{n}", "none"]), n + 1).collect()} == {"x", f"late{n}"}


def test_remembered_urls_are_not_doubled_by_their_filter_places(spark, tmp_path):
    from pulsegrid.streaming.streams import UrlMemory

    memory = UrlMemory(spark, f"file:{tmp_path}/known", buckets=4, bits=1 << 16)
    rows = spark.range(500).selectExpr("concat('https://n.org/', id) AS content_url")
    one, two = memory.bucketed(rows), memory.placed(rows)
    assert one.count() == 500 and two.count() == 1000
    assert one.join(two, ["content_url", "bucket"]).count() == 1000
