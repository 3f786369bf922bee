"""Whole runs: backfill, streams, the full scan; and header functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.changes import backfill_significance
from ..operators.latest import current_status, snapshot_pairs
from ..plans.full_scan import full_scan, stages
from ..plans.stored_scan import stored_scan
from ..session import shared_dir
from ..sources.bucketed import BucketedTable
from ..sources.feeds import write_report
from ..sources.testbed import CAPTURES_AS_OF
from ..streaming.keyed import KeyedChangeFeed
from ..streaming.streams import ChangeFeed, stream_dedupe_news, with_bucket
from .case import Case, joined, stamp, with_tables
from .signals import (
    DEFAULT_OPTIONS, KEPT, RECORD, STATUS_CTES, STATUS_TABLES, changes_sql, hits_sql, late_news, notices, records, terms_sql, verdict_sql)
from .stores import INSERT_SQL, LINK_KEYS

MAGNITUDE = "CASE new_id % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'moderate' ELSE 'major' END"


def open_changes(b):
    """A change per pair of captures, not classified yet."""
    nothing = {c: F.lit(None).cast(t) for c, t in (
        ("significance_classification", "string"), ("significance_sentiment", "string"), ("significance_confidence", "double"),
        ("matched_keywords", "array<string>"), ("matched_categories", "array<string>"), ("significance_notes", "string"),
        ("evidence_snippets", "array<string>"))}
    pairs = snapshot_pairs(b["snapshots"].select("company_id", "id", "captured_at"), mode="all", carry=())
    return pairs.selectExpr(
        "new_id AS id", "company_id", "old_id AS snapshot_id_old", "new_id AS snapshot_id_new", "true AS has_changed",
        f"{MAGNITUDE} AS change_magnitude", "new_captured_at AS detected_at").withColumns(nothing)


BACKFILL_SQL = f"""pairs AS (SELECT id AS new_id, content_markdown AS new_text, lag(id) OVER w AS old_id, coalesce(lag(content_markdown) OVER w, '') AS old_text FROM snapshots
      WINDOW w AS (PARTITION BY company_id ORDER BY captured_at, id)),
    docs AS (SELECT new_id, {MAGNITUDE} AS lvl, array_to_string(list_filter(string_split(new_text, chr(10)), lambda x: NOT list_contains(string_split(old_text, chr(10)), x)), chr(10)) AS subject
      FROM pairs WHERE old_id IS NOT NULL AND coalesce(new_text, '') <> ''),
    {terms_sql(KEPT)}, {hits_sql('docs', 'new_id', 'subject', DEFAULT_OPTIONS)}, {verdict_sql('docs', 'new_id', 'd.lvl')},
    done AS (SELECT v.* FROM verdicts v JOIN docs d ON d.new_id = v.k WHERE trim(subject, chr(32) || chr(10) || chr(9) || chr(13)) <> '')"""


def fresh_dir(spark, name: str) -> str:
    """A folder of its own for one run, where all executors can reach it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def streamed_changes(b):
    """The captures arriving in three parts by time, as change records."""
    place = fresh_dir(b.spark, "changes")
    captures = b["snapshots"].drop("baseline_classification", "baseline_sentiment", "http_last_modified")
    inbox = f"{place}/inbox"
    feed = ChangeFeed(b.spark, f"{place}/records", f"{place}/state", lambda: b.spark.read.parquet(inbox), terms=KEPT, buckets=8)
    for part in range(3):
        due = captures.filter(F.floor((F.datediff("captured_at", F.lit("2024-01-01").cast("date"))) / 11) == part)
        with_bucket(due, 8).write.mode("append").partitionBy("bucket").parquet(inbox)
        stream = b.spark.readStream.schema(captures.schema).parquet(inbox)
        feed.start(stream, f"{place}/progress", availableNow=True).awaitTermination()
    return records(b.spark.read.parquet(f"{place}/records"), "company_id")


def keyed_changes(b):
    """The captures arriving in two parts that each span the whole time, as change records; then one of a later day, after which none is waited for."""
    place = fresh_dir(b.spark, "keyed")
    captures = b["snapshots"].drop("baseline_classification", "baseline_sentiment", "http_last_modified")
    inbox = f"{place}/inbox"
    feed = KeyedChangeFeed(b.spark, f"{place}/records", lambda: captures, terms=KEPT, delay="40 days", partitions=2)
    late = [captures.limit(1).selectExpr(*(
        f"-{d} AS id" if c == "id" else "CAST(-1 AS BIGINT) AS company_id" if c == "company_id" else
        f"captured_at + INTERVAL '{d}' DAY AS captured_at" if c == "captured_at" else c for c in captures.columns)) for d in (200,)]
    for part in (captures.filter("id % 2 = 1"), captures.filter("id % 2 = 0"), *late):
        part.write.mode("append").parquet(inbox)
        stream = b.spark.readStream.schema(captures.schema).parquet(inbox)
        feed.start(stream, f"{place}/progress", availableNow=True).awaitTermination()
    return records(b.spark.read.parquet(f"{place}/records").filter("company_id >= 0"), "company_id")


def streamed_news(b):
    """News arriving twice as a stream, each URL once."""
    place = fresh_dir(b.spark, "news")
    news = b["news_articles"].select("company_id", "content_url", F.col("published_at").alias("discovered_at"))
    inbox = f"{place}/inbox"
    for _ in range(2):
        news.write.mode("append").parquet(inbox)
        stream = b.spark.readStream.schema(news.schema).parquet(inbox)
        stream_dedupe_news(stream, f"{place}/out", f"{place}/progress", availableNow=True).awaitTermination()
    return b.spark.read.parquet(f"{place}/out").select("content_url")


def scanned(b):
    tables = b.tables("companies", "company_statuses", "news_articles", "social_media_snapshots", "leadership_changes", "search_hits")
    tables["snapshots"] = b["snapshots"].drop("baseline_classification", "baseline_sentiment")
    tables["change_records"] = b["change_records"]
    tables["news_articles"] = tables["news_articles"].withColumn("matched_categories", T.json_array("matched_categories"))
    tables["scrapes"] = b["scrapes"].withColumn("metadata", F.create_map(F.lit("last-modified"), F.col("last_modified")))
    return full_scan(tables, CAPTURES_AS_OF)[1].select("stage", "outcome", "rows")


def merged_in_place(b):
    """Links in a table in place: inserted, patched and deleted, each batch twice."""
    links = b["social_media_links"].select("id", "company_id", "profile_url", "platform")
    table = BucketedTable(b.spark, fresh_dir(b.spark, "links"), "social_media_links", 16)
    table.append("start", links.filter("id % 4 = 0"))
    patch = links.filter("id % 5 = 0").selectExpr("id", "'patched' AS platform")
    for _ in range(2):
        table.insert_ignore("more", links.filter("id % 4 <> 0"), LINK_KEYS, ["id"])
        table.update_by_key("patch", patch, ["id"], ["platform"])
        table.delete("less", links.filter("id % 7 = 3").select("id"))
    return table.read().select("id", "company_id", "profile_url", "platform")


def upserted_in_place(b):
    """Companies in a table in place, fed twice with half of them, some by a new name."""
    table = BucketedTable(b.spark, fresh_dir(b.spark, "companies"), "companies", 16)
    table.append("start", b["companies"])
    fed = b["companies"].filter("id % 2 = 0").selectExpr(
        "id + 1000000 AS id", "CASE WHEN id % 4 = 0 THEN name ELSE concat('New ', name) END AS name", "homepage_url", "'IMPORT' AS source_sheet")
    for _ in range(2):
        table.upsert("feed", fed, ["name", "homepage_url"], ["source_sheet"], ["id"])
    return table.read().select("id", "name", "homepage_url", "source_sheet")


def resumed(b):
    """The tables of a run whose last stage failed at first, and which then went on."""
    place = fresh_dir(b.spark, "scan")
    frames = {
        "companies": b["companies"], "snapshots": notices(b), "company_statuses": b["company_statuses"], "change_records": None,
        "social_media_snapshots": b["social_media_snapshots"], "news_articles": late_news(b).withColumn("matched_categories", T.json_array("matched_categories")), "leadership_changes": b["leadership_changes"]}
    tables = {n: BucketedTable(b.spark, f"{place}/{n}", n, 8) for n in frames}
    for name, df in frames.items():
        if df is not None:
            tables[name].append("start", df, spread=True)
    lost = {n: (t, (lambda state: state["companies"].select(F.raise_error(F.lit("lost")).alias("x"))) if n == "status" else s)
            for n, (t, s) in stages(CAPTURES_AS_OF).items()}
    for given in (lost, None):
        stored_scan(tables, {}, CAPTURES_AS_OF, "night", given=given)
    return tables


def written_report(b):
    """Statuses of the companies as a report, read back from where it was written; written twice, the second one counts."""
    place = fresh_dir(b.spark, "report")
    for rows in (b["company_statuses"].limit(3), b["company_statuses"]):
        write_report(rows.groupBy("status").agg(F.count("*").alias("checks"), F.max("last_checked").cast("string").alias("last_checked")), place)
    return b.spark.read.schema("status string, checks bigint, last_checked string").json(place)


HEADERS = "map('CONTENT-type', CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' Application/XHTML+xml' ELSE 'image/png' END, 'x', 'y')"

CASES = {
    "backfill_significance": Case(
        lambda b: backfill_significance(open_changes(b), b["snapshots"], KEPT).select(
            "id", "significance_classification", "significance_sentiment", F.round("significance_confidence", 6).alias("significance_confidence"),
            F.coalesce(F.array_join("matched_keywords", "|"), F.lit("none")).alias("matched_keywords")),
        with_tables("snapshots", """SELECT p.new_id AS id, classification AS significance_classification, sentiment AS significance_sentiment,
            confidence AS significance_confidence, coalesce(keywords, 'none') AS matched_keywords FROM pairs p LEFT JOIN done v ON v.k = p.new_id
            WHERE p.old_id IS NOT NULL""", BACKFILL_SQL)),
    "stream_changes": Case(
        streamed_changes,
        with_tables("snapshots", f"SELECT company_id, {RECORD} FROM records", changes_sql("snapshots", "company_id", False, True))),
    "stream_changes_keyed": Case(
        keyed_changes,
        with_tables("snapshots", f"SELECT company_id, {RECORD} FROM records", changes_sql("snapshots", "company_id", False, True))),
    "stream_dedupe_news": Case(
        streamed_news, with_tables("news_articles", "SELECT DISTINCT content_url FROM news_articles")),
    "full_scan": Case(scanned),
    "merge_into_store": Case(
        merged_in_place,
        with_tables("social_media_links", """SELECT a.id, a.company_id, a.profile_url, CASE WHEN a.id % 5 = 0 THEN 'patched' ELSE l.platform END AS platform
            FROM (SELECT * FROM old UNION ALL SELECT * FROM added) a JOIN social_media_links l ON l.id = a.id WHERE a.id % 7 <> 3""", INSERT_SQL)),
    "upsert_into_store": Case(
        upserted_in_place,
        with_tables("companies", """SELECT id, name, homepage_url, CASE WHEN id % 4 = 0 THEN 'IMPORT' ELSE source_sheet END AS source_sheet FROM companies
            UNION ALL SELECT id + 1000000, concat('New ', name), homepage_url, 'IMPORT' FROM companies WHERE id % 4 = 2""")),
    "resumed_scan": Case(
        lambda b: current_status(resumed(b)["company_statuses"].read()).select("company_id", "status"),
        with_tables(STATUS_TABLES, """SELECT company_id, status FROM decided UNION ALL
            SELECT company_id, status FROM latest WHERE company_id NOT IN (SELECT company_id FROM decided)""", STATUS_CTES)),
    "written_report": Case(
        written_report,
        with_tables("company_statuses", "SELECT status, count(*) AS checks, strftime(max(last_checked), '%Y-%m-%d %H:%M:%S') AS last_checked FROM company_statuses GROUP BY status")),
    "content_types": Case(
        lambda b: b.raw("pages").selectExpr("page_id", f"{HEADERS} AS h").select(
            "page_id", T.content_type("h").alias("type"), T.is_html(T.content_type("h")).alias("html")),
        """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'Application/XHTML+xml' ELSE 'image/png' END AS type,
            page_id % 3 <> 2 AS html FROM pages"""),
    "json_arrays": Case(
        lambda b: b["news_articles"].select("id", joined(T.json_array(F.when(F.col("id") % 5 == 0, "{oops").otherwise(F.col("matched_categories"))), "categories")),
        with_tables("news_articles", """SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE CASE matched_categories WHEN '["closure"]' THEN 'closure'
            WHEN '[]' THEN '' ELSE 'acquisition|partnerships' END END AS categories FROM news_articles""")),
    "snippets": Case(
        lambda b: b.raw("documents").select("doc_id", T.snippet("text", F.lit(20), F.lit(30), 8).alias("snippet")),
        r"""SELECT doc_id, concat('...', trim(substr(text, 13, 26), chr(32) || chr(10) || chr(9) || chr(13)), CASE WHEN length(text) > 38 THEN '...' ELSE '' END) AS snippet FROM documents"""),
    "iso_times": Case(
        lambda b: b.raw("events").select("event_id", stamp(T.parse_iso(F.when(F.col("event_id") % 4 == 0, "yesterday").otherwise(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("")))), "at")),
        """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END,
            '%Y-%m-%d %H:%M:%S') END AS at FROM events"""),
}
