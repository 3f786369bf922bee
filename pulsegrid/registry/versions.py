"""Latest rows, version pairs, exclusion sets, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest as L
from ..sources.testbed import CAPTURES_AS_OF
from .case import Case, day, day_sql, stamp, time_sql, with_tables

NEWEST_STATUS = (
    "latest AS (SELECT * FROM company_statuses QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id DESC) = 1)")


def pending(b):
    changes = b["change_records"]
    open_ = F.when(F.col("significance_classification") != "uncertain", F.col("significance_classification"))
    return changes.withColumn("significance_classification", open_)


def excluded(b):
    return L.exclude(b["change_records"], L.skippable(b["company_statuses"]))


CASES = {
    "latest_status": Case(
        lambda b: L.current_status(b["company_statuses"]).select("company_id", "id", "status"),
        with_tables("company_statuses", "SELECT company_id, id, status FROM latest", NEWEST_STATUS)),
    "latest_three_captures": Case(
        lambda b: L.latest_per_key(b["snapshots"].select("company_id", "id", "captured_at"), ["company_id"],
                                   ["captured_at", "id"], 3, "place").select("company_id", "id", "place"),
        with_tables("snapshots", """SELECT company_id, id, place FROM (SELECT company_id, id,
            row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, id DESC) AS place FROM snapshots)
            WHERE place <= 3""")),
    "latest_checks_with_ties": Case(
        lambda b: L.latest_with_ties(b["company_statuses"], ["company_id"], "last_checked").select("company_id", "id", "status"),
        with_tables("company_statuses", """SELECT company_id, id, status FROM company_statuses
            QUALIFY rank() OVER (PARTITION BY company_id ORDER BY last_checked DESC) = 1""")),
    "snapshot_pairs_latest": Case(
        lambda b: L.snapshot_pairs(b["snapshots"]).select("company_id", "old_id", "new_id"),
        with_tables("snapshots", """SELECT company_id, old_id, new_id FROM (SELECT company_id, id AS new_id,
            lead(id) OVER w AS old_id, row_number() OVER w AS place FROM snapshots
            WINDOW w AS (PARTITION BY company_id ORDER BY captured_at DESC, id DESC))
            WHERE place = 1 AND old_id IS NOT NULL""")),
    "snapshot_pairs_all": Case(
        lambda b: L.snapshot_pairs(b["snapshots"], mode="all").select("company_id", "old_id", "new_id"),
        with_tables("snapshots", """SELECT company_id, old_id, new_id FROM (SELECT company_id, id AS new_id,
            lag(id) OVER (PARTITION BY company_id ORDER BY captured_at, id) AS old_id FROM snapshots)
            WHERE old_id IS NOT NULL""")),
    "social_pairs_latest": Case(
        lambda b: L.snapshot_pairs(b["social_media_snapshots"], ["company_id", "source_url"]).select(
            "company_id", "source_url", "old_id", "new_id"),
        with_tables("social_media_snapshots", """SELECT company_id, source_url, old_id, new_id FROM (SELECT company_id,
            source_url, id AS new_id, lead(id) OVER w AS old_id, row_number() OVER w AS place FROM social_media_snapshots
            WINDOW w AS (PARTITION BY company_id, source_url ORDER BY captured_at DESC, id DESC))
            WHERE place = 1 AND old_id IS NOT NULL""")),
    "earliest_without_baseline": Case(
        lambda b: L.earliest_without_baseline(b["snapshots"]).select("company_id", "id"),
        with_tables("snapshots", """SELECT s.company_id, s.id FROM snapshots s JOIN (
              SELECT company_id, min(captured_at) AS first_at FROM snapshots
              WHERE baseline_classification IS NULL AND content_markdown IS NOT NULL GROUP BY company_id) f
            ON s.company_id = f.company_id AND s.captured_at = f.first_at
            WHERE s.baseline_classification IS NULL AND s.content_markdown IS NOT NULL
              AND s.company_id NOT IN (SELECT company_id FROM snapshots WHERE baseline_classification IS NOT NULL)""")),
    "manually_closed": Case(
        lambda b: L.manually_closed(b["company_statuses"]),
        with_tables("company_statuses", "SELECT company_id FROM latest WHERE status = 'likely_closed' AND is_manual_override", NEWEST_STATUS)),
    "skippable_companies": Case(
        lambda b: L.skippable(b["company_statuses"]),
        with_tables("company_statuses", """SELECT company_id FROM latest
            WHERE (status = 'likely_closed' AND is_manual_override) OR status = 'no_homepage_url'""", NEWEST_STATUS)),
    "exclude_companies": Case(
        lambda b: excluded(b)[0].groupBy("company_id").agg(F.count("*").alias("changes")),
        with_tables("company_statuses change_records", """SELECT company_id, count(*) AS changes FROM change_records
            WHERE company_id NOT IN (SELECT company_id FROM latest WHERE (status = 'likely_closed' AND is_manual_override)
              OR status = 'no_homepage_url') GROUP BY company_id""", NEWEST_STATUS)),
    "exclude_report": Case(
        lambda b: excluded(b)[1],
        with_tables("company_statuses change_records", """SELECT count(*) AS total, count(s.company_id) AS excluded,
            count(*) - count(s.company_id) AS remaining FROM (SELECT DISTINCT company_id FROM change_records) c
            LEFT JOIN (SELECT company_id FROM latest WHERE (status = 'likely_closed' AND is_manual_override)
              OR status = 'no_homepage_url') s USING (company_id)""", NEWEST_STATUS)),
    "captured_since": Case(
        lambda b: L.captured_since(b["snapshots"], "2024-01-30"),
        with_tables("snapshots", "SELECT DISTINCT company_id FROM snapshots WHERE captured_at >= TIMESTAMP '2024-01-30 00:00:00'")),
    "stale_logos": Case(
        lambda b: L.stale_logos(b["companies"], b["company_logos"], CAPTURES_AS_OF, 3).select("id", "name"),
        with_tables("companies company_logos", """SELECT c.id, c.name FROM companies c LEFT JOIN (SELECT company_id,
            max(extracted_at) AS newest FROM company_logos GROUP BY company_id) l ON c.id = l.company_id
            WHERE newest IS NULL OR newest < TIMESTAMP '2024-01-28 00:00:00'""")),
    "without_significance": Case(
        lambda b: L.without_significance(pending(b)).select("id", stamp("detected_at")),
        with_tables("change_records", f"""SELECT id, {time_sql('detected_at')} FROM change_records
            WHERE has_changed AND significance_classification = 'uncertain'""")),
    "news_between": Case(
        lambda b: L.news_between(b["news_articles"], "2001-01-01", "2001-06-30").select("id", stamp("published_at")),
        with_tables("news_articles", f"""SELECT id, {time_sql('published_at')} FROM news_articles
            WHERE published_at BETWEEN TIMESTAMP '2001-01-01 00:00:00' AND TIMESTAMP '2001-06-30 00:00:00'""")),
    "multi_version_keys": Case(
        lambda b: L.multi_version_keys(b["social_media_snapshots"], ["company_id", "source_url"]),
        with_tables("social_media_snapshots", """SELECT company_id, source_url, count(*) AS versions
            FROM social_media_snapshots GROUP BY company_id, source_url HAVING count(*) >= 2""")),
    "snapshot_profile": Case(
        lambda b: L.snapshot_profile(b["snapshots"]).select("company_id", "snapshot_count", stamp("oldest"), "has_baseline"),
        with_tables("snapshots", """SELECT company_id, count(*) AS snapshot_count,
            strftime(min(captured_at), '%Y-%m-%d %H:%M:%S') AS oldest,
            bool_or(baseline_classification IS NOT NULL) AS has_baseline FROM snapshots GROUP BY company_id""")),
    "search_window": Case(
        lambda b: L.search_window(b["snapshots"], b["companies"], CAPTURES_AS_OF).select(
            "company_id", day("after_date", "after_date"), day("before_date", "before_date")),
        with_tables("snapshots companies", f"""SELECT c.id AS company_id,
            {day_sql("coalesce(CAST(oldest AS DATE), DATE '2024-01-31' - 90)", 'after_date')}, '2024-01-31' AS before_date
            FROM companies c LEFT JOIN (SELECT company_id, min(captured_at) AS oldest FROM snapshots GROUP BY company_id) s
            ON c.id = s.company_id""")),
    "distinct_sheets": Case(
        lambda b: L.distinct_values(b["companies"], "source_sheet"),
        with_tables("companies", "SELECT DISTINCT source_sheet FROM companies")),
    "company_page": Case(
        lambda b: L.page(b["companies"].select("id", "name"), ["name", "id"], 3, 20),
        with_tables("companies", "SELECT id, name FROM companies ORDER BY name, id LIMIT 20 OFFSET 40")),
    "company_page_info": Case(
        lambda b: L.page_info(b["companies"], 3, 20),
        with_tables("companies", """SELECT count(*) AS total, 3 AS page, 20 AS per_page,
            CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM companies""")),
    "newest_news": Case(
        lambda b: L.top_n(b["news_articles"], [F.col("published_at").desc(), F.col("id").desc()], 25).select("id", stamp("published_at")),
        with_tables("news_articles", f"""SELECT id, {time_sql('published_at')} FROM (SELECT * FROM news_articles
            ORDER BY published_at DESC, id DESC LIMIT 25)""")),
    "sorted_company_page": Case(
        lambda b: L.page(b["companies"].select("id", "name"), L.sort_columns("unheard of", "desc"), 1, 15),
        with_tables("companies", "SELECT id, name FROM companies ORDER BY name DESC, id LIMIT 15")),
}
