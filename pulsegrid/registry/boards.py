"""Dashboard aggregates and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dashboards as Q
from ..operators import latest as L
from ..operators import status as S
from ..operators import timelines as G
from ..operators.people import leadership_departures, leadership_overview
from ..sources.testbed import CAPTURES_AS_OF, NEWS_AS_OF
from .case import Case, day, joined, stamp, time_sql, with_tables
from .versions import NEWEST_STATUS

TIER = """CASE WHEN s.status = 'likely_closed' AND s.is_manual_override THEN 'manually_closed'
    WHEN l.last_snapshot IS NULL THEN 'never'
    WHEN CAST(l.last_snapshot AS DATE) >= DATE '2024-01-20' - 7 THEN 'fresh'
    WHEN CAST(l.last_snapshot AS DATE) >= DATE '2024-01-20' - 30 THEN 'recent'
    WHEN CAST(l.last_snapshot AS DATE) >= DATE '2024-01-20' - 90 THEN 'stale' ELSE 'very_stale' END"""
# Captures are thinned so that several tiers occur.
OLD_CAPTURES = "old AS (SELECT company_id, captured_at - (company_id * 6) * INTERVAL '1' DAY AS captured_at FROM snapshots)"
LAST_OLD = "(SELECT company_id, max(captured_at) AS last_snapshot FROM old GROUP BY company_id)"
TIERS_AT = "2024-01-20"


def old_captures(b):
    return b["snapshots"].selectExpr("company_id", "captured_at - (company_id * 6) * INTERVAL '1' DAY AS captured_at")


def tiers(b):
    return A.freshness_tiers(b["companies"], old_captures(b), b["company_statuses"], TIERS_AT)


def board_tables(b):
    t = b.tables("companies", "change_records", "company_statuses", "social_media_links", "news_articles",
                 "company_leadership", "leadership_changes")
    t["snapshots"] = old_captures(b)
    return t


def outcomes(b):
    return b["change_records"].selectExpr(
        "company_id", "CASE WHEN significance_classification = 'uncertain' THEN 'failure' WHEN has_changed THEN 'success' ELSE 'skip' END AS outcome",
        "concat('Company ', CAST(company_id AS STRING), ': event ', lpad(CAST(id AS STRING), 9, '0')) AS error")


OUTCOMES_SQL = """outcomes AS (SELECT company_id, CASE WHEN significance_classification = 'uncertain' THEN 'failure'
    WHEN has_changed THEN 'success' ELSE 'skip' END AS outcome,
    concat('Company ', company_id, ': event ', lpad(CAST(id AS VARCHAR), 9, '0')) AS error FROM change_records)"""

LIST_SQL = f"""lst AS (SELECT c.id, c.name, coalesce(s.status, 'unknown') AS status, s.status AS raw_status,
    coalesce(s.is_manual_override, false) AS is_manual_override, lc.last_change_date, l.last_snapshot, c.source_sheet,
    c.flagged_for_review, coalesce(sc.n, 0) AS social_count, coalesce(nc.n, 0) AS news_count, {TIER} AS tier
    FROM companies c LEFT JOIN latest s ON c.id = s.company_id
    LEFT JOIN (SELECT company_id, max(detected_at) AS last_change_date FROM change_records WHERE has_changed GROUP BY company_id) lc ON c.id = lc.company_id
    LEFT JOIN {LAST_OLD} l ON c.id = l.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM social_media_links GROUP BY company_id) sc ON c.id = sc.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM news_articles GROUP BY company_id) nc ON c.id = nc.company_id)"""
LIST_TABLES = "companies company_statuses change_records snapshots social_media_links news_articles"
LIST_CTES = f"{NEWEST_STATUS}, {OLD_CAPTURES}, {LIST_SQL}"
LIST_COLUMNS = f"""id, name, status, is_manual_override, {time_sql('last_change_date')}, {time_sql('last_snapshot')},
    social_count, news_count"""


def company_list(b, **filters):
    return Q.companies_list(board_tables(b), TIERS_AT, **filters).select(
        "id", "name", "status", "is_manual_override", stamp("last_change_date"), stamp("last_snapshot"),
        "social_count", "news_count")


def changed_groups(b):
    return Q.changes_by_company(board_tables(b), CAPTURES_AS_OF, sentiment="positive", number=2, per_page=10)


GROUPS_SQL = """hits AS (SELECT * FROM change_records WHERE has_changed AND significance_sentiment = 'positive'
    AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 180),
    grp AS (SELECT h.company_id, c.name AS company_name, max(detected_at) AS latest_change, count(*) AS change_count
      FROM hits h JOIN companies c ON c.id = h.company_id GROUP BY h.company_id, c.name
      ORDER BY latest_change DESC, h.company_id LIMIT 10 OFFSET 10)"""

FEED_SQL = """feed AS (
    SELECT 'change' AS event_type, id AS event_id, detected_at AS event_date, company_id,
      significance_classification AS classification, significance_sentiment AS sentiment, change_magnitude AS magnitude,
      NULL AS title FROM change_records WHERE has_changed AND significance_classification = 'significant'
    UNION ALL SELECT 'news', id, published_at, company_id, significance_classification, significance_sentiment, NULL, title FROM news_articles
    UNION ALL SELECT 'leadership', id, discovered_at, company_id, NULL, NULL, NULL, concat(person_name, ' - ', title)
      FROM company_leadership WHERE is_current),
    named AS (SELECT f.*, c.name AS company_name FROM feed f JOIN companies c ON c.id = f.company_id)"""
FEED_COLUMNS = f"event_type, event_id, {time_sql('event_date')}, company_id, classification, sentiment, magnitude, title, company_name"


def feed(b):
    return G.activity_feed(b["change_records"], b["news_articles"], b["company_leadership"], b["companies"])


def feed_columns(df):
    return df.select("event_type", "event_id", stamp("event_date"), "company_id", "classification", "sentiment",
                     "magnitude", "title", "company_name")


def social_changes(b):
    return b["change_records"].withColumn("source_type", F.lit("blog"))


SUMMARY_SQL = """SELECT section, count(*) AS records FROM (
    SELECT 'company' AS section FROM companies
    UNION ALL SELECT 'status' FROM (SELECT DISTINCT company_id FROM company_statuses)
    UNION ALL SELECT 'changes' FROM (SELECT 1 FROM change_records)
    UNION ALL SELECT 'social_links' FROM social_media_links
    UNION ALL SELECT 'news' FROM (SELECT 1 FROM news_articles)
    UNION ALL SELECT 'leadership' FROM company_leadership
    UNION ALL SELECT 'latest_snapshot' FROM (SELECT DISTINCT company_id FROM snapshots)
    UNION ALL SELECT 'snapshot_count' FROM (SELECT DISTINCT company_id FROM snapshots)) GROUP BY section"""


def summary_tables(b):
    return b.tables("companies", "change_records", "company_statuses", "social_media_links", "news_articles",
                    "company_leadership", "snapshots")


CASES = {
    "overview_stats": Case(
        lambda b: A.overview_stats(b.tables("companies", "snapshots", "change_records", "social_media_links",
                                            "news_articles", "company_leadership"), CAPTURES_AS_OF).withColumn(
            "last_scan_date", stamp("last_scan_date")),
        with_tables("companies snapshots change_records social_media_links news_articles company_leadership", """SELECT
            (SELECT count(*) FROM companies) AS total_companies, (SELECT count(homepage_url) FROM companies) AS companies_with_homepage,
            (SELECT count(*) FROM snapshots) AS total_snapshots,
            (SELECT strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') FROM snapshots) AS last_scan_date,
            (SELECT count(*) FROM change_records WHERE has_changed AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 30) AS recent_changes,
            (SELECT count(*) FROM change_records WHERE significance_classification = 'significant'
              AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 30) AS significant_changes,
            (SELECT count(*) FROM social_media_links) AS total_social_links, (SELECT count(*) FROM news_articles) AS total_news,
            (SELECT count(*) FROM company_leadership WHERE is_current) AS total_leadership""")),
    "status_counts": Case(
        lambda b: A.status_counts(b["company_statuses"]),
        with_tables("company_statuses", """SELECT status, count(DISTINCT company_id) AS companies FROM (SELECT * FROM company_statuses
            QUALIFY last_checked = max(last_checked) OVER (PARTITION BY company_id)) GROUP BY status""")),
    "changes_since_last_scan": Case(
        lambda b: A.changes_since_last_scan(b["snapshots"], b["change_records"]).withColumn("scan_date", day("scan_date", "scan_date")),
        with_tables("snapshots change_records", """SELECT count(*) AS total_changes,
            count(*) FILTER (m = 0) AS minor, count(*) FILTER (m = 1) AS moderate, count(*) FILTER (m = 2) AS major,
            count(*) FILTER (s = 0) AS insignificant, count(*) FILTER (s = 1) AS uncertain, count(*) FILTER (s = 2) AS significant,
            (SELECT strftime(max(d), '%Y-%m-%d') FROM dates) AS scan_date
            FROM (SELECT company_id, max(CASE change_magnitude WHEN 'major' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) AS m,
              max(CASE significance_classification WHEN 'significant' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END) AS s
              FROM change_records WHERE has_changed AND CAST(detected_at AS DATE) >= (SELECT min(d) FROM dates) GROUP BY company_id)""",
            "dates AS (SELECT DISTINCT CAST(captured_at AS DATE) AS d FROM snapshots ORDER BY d DESC LIMIT 2)")),
    "alerts_summary": Case(
        lambda b: A.alerts_summary(b["change_records"], b["companies"], CAPTURES_AS_OF).select(
            "negative_significant_count", "uncertain_count", "flagged_count",
            joined(F.transform("flagged_companies", lambda x: x["name"]), "flagged"), "total_alerts"),
        with_tables("change_records companies", """SELECT neg AS negative_significant_count, unc AS uncertain_count, flagged_count, flagged,
            neg + unc + flagged_count AS total_alerts FROM (SELECT
              count(*) FILTER (significance_classification = 'significant' AND significance_sentiment = 'negative') AS neg,
              count(*) FILTER (significance_classification = 'uncertain') AS unc
              FROM change_records WHERE CAST(detected_at AS DATE) >= DATE '2024-01-31' - 30),
            (SELECT string_agg(name, '|' ORDER BY name, id) AS flagged FROM
              (SELECT name, id FROM companies WHERE flagged_for_review ORDER BY name, id LIMIT 5)),
            (SELECT count(*) AS flagged_count FROM companies WHERE flagged_for_review)""")),
    "weekly_trend": Case(
        lambda b: A.weekly_trend(b["change_records"], b["news_articles"], b["company_leadership"], NEWS_AS_OF).withColumn(
            "week_start", day("week_start", "week_start")),
        with_tables("change_records news_articles company_leadership", """SELECT strftime(start, '%Y-%m-%d') AS week_start,
            strftime(start, '%m-%d') AS label,
            (SELECT count(*) FROM change_records WHERE has_changed AND significance_classification = 'significant'
              AND CAST(detected_at AS DATE) BETWEEN start AND start + 6) AS significant_changes,
            (SELECT count(*) FROM news_articles WHERE CAST(published_at AS DATE) BETWEEN start AND start + 6) AS news_articles,
            (SELECT count(*) FROM company_leadership WHERE CAST(discovered_at AS DATE) BETWEEN start AND start + 6) AS leadership_discoveries
            FROM (SELECT DATE '2001-11-05' - CAST(w * 7 + 6 AS INT) AS start FROM range(12) r(w))""")),
    "weekly_trend_of_changes": Case(
        lambda b: A.weekly_trend(b["change_records"], b["news_articles"], b["company_leadership"], CAPTURES_AS_OF, 5).select(
            "label", "significant_changes", "news_articles"),
        with_tables("change_records news_articles", """SELECT strftime(start, '%m-%d') AS label,
            (SELECT count(*) FROM change_records WHERE has_changed AND significance_classification = 'significant'
              AND CAST(detected_at AS DATE) BETWEEN start AND start + 6) AS significant_changes,
            (SELECT count(*) FROM news_articles WHERE CAST(published_at AS DATE) BETWEEN start AND start + 6) AS news_articles
            FROM (SELECT DATE '2024-01-31' - CAST(w * 7 + 6 AS INT) AS start FROM range(5) r(w))""")),
    "freshness_tiers": Case(
        lambda b: tiers(b).select("company_id", "name", stamp("last_snapshot"), "tier"),
        with_tables("companies snapshots company_statuses", f"""SELECT c.id AS company_id, c.name, {time_sql('last_snapshot')}, {TIER} AS tier
            FROM companies c LEFT JOIN {LAST_OLD} l ON c.id = l.company_id LEFT JOIN latest s ON c.id = s.company_id""",
            f"{NEWEST_STATUS}, {OLD_CAPTURES}")),
    "freshness_counts": Case(
        lambda b: A.freshness_counts(tiers(b)),
        with_tables("companies snapshots company_statuses", f"""SELECT tier, count(t) AS companies FROM
            (VALUES ('fresh'), ('recent'), ('stale'), ('very_stale'), ('never'), ('manually_closed')) v(tier)
            LEFT JOIN (SELECT {TIER} AS t FROM companies c LEFT JOIN {LAST_OLD} l ON c.id = l.company_id
            LEFT JOIN latest s ON c.id = s.company_id) ON t = tier GROUP BY tier""", f"{NEWEST_STATUS}, {OLD_CAPTURES}")),
    "monthly_sentiment": Case(
        lambda b: A.monthly_sentiment(b["news_articles"], NEWS_AS_OF),
        with_tables("news_articles", """SELECT company_id, strftime(published_at, '%Y-%m') AS month,
            count(*) FILTER (significance_sentiment = 'positive') AS positive,
            count(*) FILTER (significance_sentiment = 'negative') AS negative, count(*) AS total FROM news_articles
            WHERE significance_classification = 'significant' AND CAST(published_at AS DATE) >= DATE '2001-11-05' - 360
            GROUP BY company_id, month""")),
    "change_rate_anomalies": Case(
        lambda b: A.change_rate_anomalies(b["change_records"], b["companies"], CAPTURES_AS_OF, 5, 60),
        with_tables("change_records companies", """SELECT company_id, c.name AS company_name, recent_count, baseline_count,
            round(baseline_count * (5 / 60.0), 2) AS expected_count,
            round(recent_count / (baseline_count * (5 / 60.0)), 2) AS ratio,
            CASE WHEN recent_count / (baseline_count * (5 / 60.0)) >= 2 THEN 'spike' ELSE 'drought' END AS direction
            FROM (SELECT company_id, CAST(count(*) FILTER (CAST(detected_at AS DATE) >= DATE '2024-01-31' - 5) AS BIGINT) AS recent_count,
              count(*) AS baseline_count FROM change_records WHERE has_changed AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 60
              GROUP BY company_id) JOIN companies c ON c.id = company_id
            WHERE recent_count / (baseline_count * (5 / 60.0)) >= 2 OR recent_count / (baseline_count * (5 / 60.0)) <= 0.1""")),
    "report_breakdowns": Case(
        lambda b: A.breakdowns(b["change_records"].filter("has_changed"), {
            "significance": "significance_classification", "sentiment": "significance_sentiment", "magnitude": "change_magnitude"}),
        with_tables("change_records", """SELECT breakdown, value, count(c.id) AS n FROM (VALUES ('significance', 'significant'),
            ('significance', 'insignificant'), ('significance', 'uncertain'), ('sentiment', 'positive'), ('sentiment', 'negative'),
            ('sentiment', 'mixed'), ('sentiment', 'neutral'), ('magnitude', 'major'), ('magnitude', 'moderate'), ('magnitude', 'minor')) v(breakdown, value)
            LEFT JOIN (SELECT * FROM change_records WHERE has_changed) c ON (breakdown = 'significance' AND c.significance_classification = value)
              OR (breakdown = 'sentiment' AND c.significance_sentiment = value) OR (breakdown = 'magnitude' AND c.change_magnitude = value)
            GROUP BY breakdown, value""")),
    "link_breakdowns": Case(
        lambda b: A.breakdowns(b["social_media_links"], {"platform": "platform", "html_location": "html_location"}),
        with_tables("social_media_links", """SELECT 'platform' AS breakdown, platform AS value, count(*) AS n FROM social_media_links GROUP BY platform
            UNION ALL SELECT 'html_location', coalesce(html_location, 'unknown'), count(*) FROM social_media_links GROUP BY 2""")),
    "run_summary": Case(
        lambda b: A.run_summary(outcomes(b)),
        with_tables("change_records", """SELECT count(*) AS processed, count(*) FILTER (outcome = 'success') AS successful,
            count(*) FILTER (outcome = 'failure') AS failed, count(*) FILTER (outcome = 'skip') AS skipped FROM outcomes""", OUTCOMES_SQL)),
    "run_errors": Case(
        lambda b: A.run_errors(outcomes(b), ["company_id"]),
        with_tables("change_records", "SELECT company_id, error FROM outcomes WHERE outcome = 'failure'", OUTCOMES_SQL)),
    "run_summary_by_company": Case(
        lambda b: A.run_summary(outcomes(b), ["company_id"]),
        with_tables("change_records", """SELECT o.company_id, count(*) AS processed, count(*) FILTER (outcome = 'success') AS successful,
            count(*) FILTER (outcome = 'failure') AS failed, count(*) FILTER (outcome = 'skip') AS skipped
            FROM outcomes o GROUP BY o.company_id""", OUTCOMES_SQL)),
    "merged_run_summary": Case(
        lambda b: A.merge_summaries(A.run_summary(outcomes(b), ["company_id"])),
        with_tables("change_records", """SELECT count(*) AS processed, count(*) FILTER (outcome = 'success') AS successful,
            count(*) FILTER (outcome = 'failure') AS failed, count(*) FILTER (outcome = 'skip') AS skipped FROM outcomes""", OUTCOMES_SQL)),
    "activity_feed": Case(
        lambda b: feed_columns(feed(b)),
        with_tables("change_records news_articles company_leadership companies", f"SELECT {FEED_COLUMNS} FROM named", FEED_SQL)),
    "activity_feed_page": Case(
        lambda b: feed_columns(G.feed_page(feed(b), 30, 15)),
        with_tables("change_records news_articles company_leadership companies",
                    f"SELECT {FEED_COLUMNS} FROM (SELECT * FROM named ORDER BY event_date DESC, event_type, event_id DESC LIMIT 30 OFFSET 15)", FEED_SQL)),
    "change_timeline": Case(
        lambda b: G.change_timeline(b["change_records"], social_changes(b)).withColumn("detected_at", stamp("detected_at")),
        with_tables("change_records", f"""SELECT source, company_id, id, {time_sql('detected_at')}, has_changed, change_magnitude,
            significance_classification, significance_sentiment FROM (SELECT 'HOMEPAGE' AS source, * FROM change_records
            UNION ALL SELECT 'BLOG', * FROM change_records)""")),
    "related_news": Case(
        lambda b: G.related_news(b["news_articles"], 7).select("id", stamp("published_at"), "title"),
        with_tables("news_articles", f"""SELECT id, {time_sql('published_at')}, title FROM news_articles WHERE company_id = 7""")),
    "companies_list": Case(
        lambda b: company_list(b), with_tables(LIST_TABLES, f"SELECT {LIST_COLUMNS} FROM lst", LIST_CTES)),
    "companies_list_filtered": Case(
        lambda b: company_list(b, search="CUSTOMER#0000", flagged=False, freshness="never", manual_override=False, status="operational"),
        with_tables(LIST_TABLES, f"""SELECT {LIST_COLUMNS} FROM lst WHERE name ILIKE '%CUSTOMER#0000%' AND NOT flagged_for_review
            AND tier = 'never' AND NOT is_manual_override AND raw_status = 'operational'""", LIST_CTES)),
    "companies_list_changed": Case(
        lambda b: company_list(b, has_changes=True, source_sheet="BUILDING"),
        with_tables(LIST_TABLES, f"SELECT {LIST_COLUMNS} FROM lst WHERE last_change_date IS NOT NULL AND source_sheet = 'BUILDING'", LIST_CTES)),
    "companies_list_page": Case(
        lambda b: L.page(Q.companies_list(board_tables(b), TIERS_AT), L.sort_columns("news_count", "desc"), 2, 10).select("id", "news_count"),
        with_tables(LIST_TABLES, "SELECT id, news_count FROM lst ORDER BY news_count DESC, id LIMIT 10 OFFSET 10", LIST_CTES)),
    "changes_by_company": Case(
        lambda b: changed_groups(b)[0].select(
            "company_id", "company_name", "company_status", "company_status_manual", stamp("latest_change"), "change_count"),
        with_tables("change_records companies company_statuses", f"""SELECT g.company_id, g.company_name,
            coalesce(any_value(s.status), 'unknown') AS company_status, coalesce(any_value(s.is_manual_override), false) AS company_status_manual,
            strftime(any_value(g.latest_change), '%Y-%m-%d %H:%M:%S') AS latest_change, any_value(g.change_count) AS change_count
            FROM grp g LEFT JOIN latest s ON g.company_id = s.company_id
            GROUP BY g.company_id, g.company_name""", f"{NEWEST_STATUS}, {GROUPS_SQL}")),
    "changes_by_company_rows": Case(
        lambda b: changed_groups(b)[1].select("company_id", "id", "change_magnitude"),
        with_tables("change_records companies", """SELECT company_id, id, change_magnitude FROM hits
            WHERE company_id IN (SELECT company_id FROM grp)""", GROUPS_SQL)),
    "company_summary_sections": Case(
        lambda b: Q.company_summaries(summary_tables(b)).groupBy("section").agg(F.count("*").alias("records")),
        with_tables("companies company_statuses change_records social_media_links news_articles company_leadership snapshots", SUMMARY_SQL)),
    "company_summary": Case(
        lambda b: Q.company_summary(summary_tables(b), 7).select(
            "section", F.coalesce(F.get_json_object("record", "$.id"), F.get_json_object("record", "$.snapshot_count")).alias("key")),
        with_tables("companies company_statuses change_records social_media_links news_articles company_leadership snapshots", """
            SELECT 'company' AS section, CAST(id AS VARCHAR) AS key FROM companies WHERE id = 7
            UNION ALL SELECT 'status', CAST(max(id) AS VARCHAR) FROM company_statuses WHERE company_id = 7
            UNION ALL SELECT 'changes', CAST(id AS VARCHAR) FROM (SELECT id FROM change_records WHERE company_id = 7)
            UNION ALL SELECT 'social_links', CAST(id AS VARCHAR) FROM social_media_links WHERE company_id = 7
            UNION ALL SELECT 'news', CAST(id AS VARCHAR) FROM (SELECT id FROM news_articles WHERE company_id = 7)
            UNION ALL SELECT 'leadership', CAST(id AS VARCHAR) FROM company_leadership WHERE company_id = 7
            UNION ALL SELECT 'latest_snapshot', CAST(id AS VARCHAR) FROM (SELECT id FROM snapshots WHERE company_id = 7 ORDER BY captured_at DESC, id DESC LIMIT 1)
            UNION ALL SELECT 'snapshot_count', CAST(count(*) AS VARCHAR) FROM snapshots WHERE company_id = 7""")),
    "company_lookup": Case(
        lambda b: Q.company_lookup(board_tables(b), name="CUSTOMER#000000042").select("id", "name", "status", stamp("last_checked")),
        with_tables("companies company_statuses", f"""SELECT c.id, c.name, s.status, {time_sql('s.last_checked', 'last_checked')}
            FROM companies c LEFT JOIN latest s ON s.company_id = c.id WHERE lower(c.name) = 'customer#000000042'""", NEWEST_STATUS)),
    "risk_contradictions": Case(
        lambda b: Q.risk_view(board_tables(b), NEWS_AS_OF)["contradictions"].select("company_id", "news_id", stamp("news_published_at")),
        with_tables("companies company_statuses news_articles", f"""SELECT company_id, news_id, {time_sql('news_published_at')} FROM (
            SELECT n.company_id, n.id AS news_id, n.published_at AS news_published_at FROM news_articles n JOIN latest s ON s.company_id = n.company_id
            JOIN companies c ON c.id = n.company_id WHERE s.status = 'operational' AND n.significance_classification = 'significant'
              AND n.significance_sentiment = 'negative' AND CAST(n.published_at AS DATE) >= DATE '2001-11-05' - 30
            )""", NEWEST_STATUS)),
    "status_news_contradictions": Case(
        lambda b: S.status_news_contradictions(b["companies"], b["company_statuses"], b["news_articles"], NEWS_AS_OF, 300).select(
            "company_id", "company_name", "status_confidence", "news_id", "news_title", stamp("news_published_at")),
        with_tables("companies company_statuses news_articles", f"""SELECT n.company_id, c.name AS company_name, s.confidence AS status_confidence,
            n.id AS news_id, n.title AS news_title, {time_sql('n.published_at', 'news_published_at')} FROM news_articles n
            JOIN latest s ON s.company_id = n.company_id JOIN companies c ON c.id = n.company_id
            WHERE s.status = 'operational' AND n.significance_classification = 'significant' AND n.significance_sentiment = 'negative'
              AND CAST(n.published_at AS DATE) >= DATE '2001-11-05' - 300""", NEWEST_STATUS)),
    "health_grid": Case(
        lambda b: S.health_grid(b["companies"], b["company_statuses"]),
        with_tables("companies company_statuses", """SELECT c.id AS company_id, c.name, coalesce(s.status, 'unknown') AS status,
            coalesce(s.is_manual_override, false) AS is_manual_override, s.confidence FROM companies c LEFT JOIN latest s ON s.company_id = c.id""", NEWEST_STATUS)),
    "leadership_departures": Case(
        lambda b: leadership_departures(b["leadership_changes"], b["companies"], CAPTURES_AS_OF, 10).select(
            "id", "company_id", "company_name", "change_type", stamp("detected_at")),
        with_tables("leadership_changes companies", f"""SELECT l.id, l.company_id, c.name AS company_name, change_type, {time_sql('detected_at')}
            FROM leadership_changes l JOIN companies c ON c.id = l.company_id WHERE severity = 'critical'
            AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 10""")),
    "leadership_overview": Case(
        lambda b: leadership_overview(b["company_leadership"], b["companies"], b["linkedin_snapshots"]).select(
            "id", "company_id", "company_name", "person_name", "title", stamp("last_snapshot_at"), "latest_vision_data"),
        with_tables("company_leadership companies linkedin_snapshots", f"""SELECT p.id, p.company_id, c.name AS company_name, p.person_name, p.title,
            {time_sql('l.captured_at', 'last_snapshot_at')}, l.vision_data_json AS latest_vision_data FROM company_leadership p
            JOIN companies c ON c.id = p.company_id LEFT JOIN (SELECT * FROM linkedin_snapshots WHERE url_type = 'person'
              QUALIFY row_number() OVER (PARTITION BY linkedin_url ORDER BY captured_at DESC, id DESC) = 1) l
            ON l.linkedin_url = p.linkedin_profile_url AND l.company_id = p.company_id WHERE p.is_current""")),
}
