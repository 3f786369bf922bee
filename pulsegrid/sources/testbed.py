"""Domain tables read from the generic test tables.

Each mapping is a list of expressions over one table (or one join) that Spark and DuckDB
both evaluate, so the checked queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Moments the mapped tables end at.
CAPTURES_AS_OF = "2024-01-31 00:00:00"
STATUS_AS_OF = "2001-08-01 00:00:00"
NEWS_AS_OF = "2001-11-05 00:00:00"

FIRST = "CASE {k} % 7 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Bert' WHEN 2 THEN 'Clara' WHEN 3 THEN 'David' WHEN 4 THEN 'Emma' WHEN 5 THEN 'Frank' ELSE 'Grace' END"
LAST = "CASE {k} % 11 WHEN 0 THEN 'Adams' WHEN 1 THEN 'Brown' WHEN 2 THEN 'Clark' WHEN 3 THEN 'Davis' WHEN 4 THEN 'Evans' WHEN 5 THEN 'Fisher' WHEN 6 THEN 'Green' WHEN 7 THEN 'Harris' WHEN 8 THEN 'Irving' WHEN 9 THEN 'Jones' ELSE 'King' END"
LINE_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000"
CAPTURED = "TIMESTAMP '2024-01-31 00:00:00' - (doc_id % 720) * INTERVAL '1' HOUR"
HOMEPAGE = "CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE concat('https://', lower(replace(c_name, '#', '-')), '.example.com') END"
LEADER_TITLE = "CASE {k} % 6 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Founder' WHEN 2 THEN 'CTO' WHEN 3 THEN 'COO' WHEN 4 THEN 'CFO' ELSE 'VP of Product' END"
# Profile URLs in the many spellings they are found in.
PROFILE_URL = (
    "CASE o_orderkey % 16 "
    "WHEN 0 THEN concat('https://www.linkedin.com/company/c', CAST(o_custkey AS VARCHAR(20)), '/about/') "
    "WHEN 1 THEN concat('http://LinkedIn.com/in/p', CAST(o_orderkey % 5 AS VARCHAR(20)), '?trk=1') "
    "WHEN 2 THEN concat('https://Twitter.com/c', CAST(o_custkey AS VARCHAR(20)), '/') "
    "WHEN 3 THEN concat('https://x.com/c', CAST(o_custkey AS VARCHAR(20)), '/status/', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 4 THEN concat('https://www.youtube.com/@c', CAST(o_custkey AS VARCHAR(20)), '/videos') "
    "WHEN 5 THEN 'https://www.youtube.com/watch?v=abc_D-1' "
    "WHEN 6 THEN concat('https://bsky.app/profile/c', CAST(o_custkey AS VARCHAR(20)), '.example.com') "
    "WHEN 7 THEN concat('https://facebook.com/c', CAST(o_custkey AS VARCHAR(20)), '#top') "
    "WHEN 8 THEN concat('https://instagram.com/Customer', CAST(o_custkey AS VARCHAR(20))) "
    "WHEN 9 THEN concat('https://github.com/c', CAST(o_custkey AS VARCHAR(20)), '/repo', CAST(o_orderkey % 3 AS VARCHAR(20))) "
    "WHEN 10 THEN concat('https://www.tiktok.com/@c', CAST(o_custkey AS VARCHAR(20))) "
    "WHEN 11 THEN concat('https://medium.com/@c', CAST(o_custkey AS VARCHAR(20)), '/post-', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 12 THEN concat('https://mastodon.social/@c', CAST(o_custkey AS VARCHAR(20))) "
    "WHEN 13 THEN concat('https://www.threads.net/@c', CAST(o_custkey AS VARCHAR(20))) "
    "WHEN 14 THEN 'https://github.com/login' "
    "ELSE concat('https://www.pinterest.com/c', CAST(o_custkey AS VARCHAR(20)), '//') END"
)
BLOG_URL = (
    "CASE o_orderkey % 7 "
    "WHEN 0 THEN concat('https://Blog.c', CAST(o_custkey AS VARCHAR(20)), '.example.com/2024/post-', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 1 THEN concat('https://c', CAST(o_custkey AS VARCHAR(20)), '.example.com/News/item?id=', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 2 THEN concat('https://c', CAST(o_custkey AS VARCHAR(20)), '.substack.com/p/', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 3 THEN concat('https://medium.com/@c', CAST(o_custkey AS VARCHAR(20)), '/', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 4 THEN concat('https://c', CAST(o_custkey AS VARCHAR(20)), '.wordpress.com/', CAST(o_orderkey AS VARCHAR(20))) "
    "WHEN 5 THEN concat('https://c', CAST(o_custkey AS VARCHAR(20)), '.example.com/articles/') "
    "ELSE concat('https://c', CAST(o_custkey AS VARCHAR(20)), '.example.com/about') END"
)

# name: (source, expressions)
MAPPINGS: dict[str, tuple[str, tuple[str, ...]]] = {
    "companies": ("customer", (
        "c_custkey AS id", "c_name AS name", f"{HOMEPAGE} AS homepage_url", "c_mktsegment AS source_sheet",
        "c_acctbal < 0 AS flagged_for_review",
        "CASE WHEN c_custkey % 3 = 0 THEN 'low balance' END AS flag_reason",
        "CASE WHEN c_custkey % 4 = 0 THEN 'seed' END AS performed_by",
        "TIMESTAMP '2000-01-01 00:00:00' AS updated_at",
    )),
    "snapshots": ("documents", (
        "doc_id AS id", "CAST(substr(source, 4) AS BIGINT) AS company_id",
        "concat('https://c', substr(source, 4), '.example.com/', lang) AS url",
        "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS content_markdown",
        "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE md5(text) END AS content_checksum",
        "CASE WHEN doc_id % 17 = 0 THEN concat('timeout ', CAST(doc_id % 2 AS VARCHAR(20))) END AS error_message",
        f"{CAPTURED} AS captured_at",
        "CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 = 0 AND doc_id % 3 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'significant' ELSE 'insignificant' END END AS baseline_classification",
        "CASE WHEN doc_id % 5 = 1 THEN 'positive' WHEN doc_id % 5 = 2 THEN 'negative' END AS baseline_sentiment",
        f"CASE WHEN doc_id % 3 = 0 THEN {CAPTURED} - (doc_id % 500) * INTERVAL '1' DAY END AS http_last_modified",
        "CASE WHEN doc_id % 13 = 0 THEN 999 ELSE 200 END AS status_code",
    )),
    "social_media_snapshots": ("documents", (
        "doc_id AS id", "CAST(substr(source, 4) AS BIGINT) AS company_id",
        "concat('https://blog.example.com/', lang) AS source_url", "'blog' AS source_type",
        "text AS content_markdown", "md5(text) AS content_checksum",
        "CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS error_message",
        f"{CAPTURED} AS captured_at",
        f"CASE WHEN doc_id % 4 <> 0 THEN {CAPTURED} - (doc_id % 600) * INTERVAL '1' DAY END AS latest_post_date",
    )),
    "change_records": ("events", (
        "event_id AS id", "user_id AS company_id", "event_id * 2 AS snapshot_id_old", "event_id * 2 + 1 AS snapshot_id_new",
        "event_type <> 'view' AS has_changed",
        "CASE WHEN value < 50 THEN 'minor' WHEN value < 200 THEN 'moderate' ELSE 'major' END AS change_magnitude",
        "ts AS detected_at",
        "CASE event_type WHEN 'purchase' THEN 'significant' WHEN 'signup' THEN 'significant' WHEN 'error' THEN 'uncertain' ELSE 'insignificant' END AS significance_classification",
        "CASE WHEN event_type = 'signup' THEN 'positive' WHEN event_type = 'purchase' AND value >= 100 THEN 'negative' WHEN event_type = 'purchase' THEN 'mixed' ELSE 'neutral' END AS significance_sentiment",
        "0.5 + value / 1000 AS significance_confidence",
    )),
    "company_statuses": ("orders", (
        "o_orderkey AS id", "o_custkey AS company_id",
        "CASE o_orderstatus WHEN 'O' THEN 'operational' WHEN 'F' THEN 'likely_closed' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'no_homepage_url' ELSE 'uncertain' END END AS status",
        "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence", "o_orderdate AS last_checked",
        "o_orderpriority = '1-URGENT' AS is_manual_override",
    )),
    "news_articles": ("lineitem JOIN orders ON l_orderkey = o_orderkey", (
        f"{LINE_ID} AS id", "o_custkey AS company_id",
        "concat('https://s', CAST(l_suppkey AS VARCHAR(20)), '.example.org/', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_linenumber AS VARCHAR(20))) AS content_url",
        "concat('Item ', CAST(l_partkey AS VARCHAR(20))) AS title",
        "concat('s', CAST(l_suppkey AS VARCHAR(20)), '.example.org') AS source",
        "l_shipdate AS published_at",
        "CASE WHEN l_linestatus = 'O' THEN 'significant' ELSE 'insignificant' END AS significance_classification",
        "CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END AS significance_sentiment",
        "l_discount * 10 AS significance_confidence",
        """CASE l_linenumber % 3 WHEN 0 THEN '["closure"]' WHEN 1 THEN '["acquisition","partnerships"]' ELSE '[]' END AS matched_categories""",
    )),
    "company_leadership": ("supplier", (
        "s_suppkey AS id", "CAST(s_nationkey AS BIGINT) AS company_id",
        f"concat({FIRST.format(k='s_suppkey')}, ' ', {LAST.format(k='s_suppkey')}) AS person_name",
        f"{LEADER_TITLE.format(k='s_suppkey')} AS title",
        "concat('https://linkedin.com/in/', lower(replace(s_name, '#', '-'))) AS linkedin_profile_url",
        "s_suppkey % 5 <> 0 AS in_previous", "s_suppkey % 7 <> 0 AS in_current", "s_suppkey % 4 <> 0 AS is_current",
        "TIMESTAMP '2001-10-01 00:00:00' + (s_suppkey % 40) * INTERVAL '1' DAY AS discovered_at",
    )),
    "leadership_changes": ("events", (
        "event_id AS id", "user_id AS company_id",
        "CASE event_id % 5 WHEN 0 THEN 'ceo_departure' WHEN 1 THEN 'new_ceo' WHEN 2 THEN 'cto_departure' WHEN 3 THEN 'new_leadership' ELSE 'executive_departure' END AS change_type",
        f"concat({FIRST.format(k='event_id')}, ' ', {LAST.format(k='event_id')}) AS person_name",
        f"{LEADER_TITLE.format(k='event_id')} AS title",
        "concat('https://linkedin.com/in/p', CAST(event_id AS VARCHAR(20))) AS linkedin_profile_url",
        "CASE WHEN event_id % 5 IN (0, 2) THEN 'critical' ELSE 'notable' END AS severity",
        "ts AS detected_at",
    )),
    "leadership_mentions": ("orders", (
        "o_orderkey AS id", "o_custkey % 25 AS company_id",
        f"concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Dr. ' ELSE '' END, {FIRST.format(k='o_orderkey')}, CASE WHEN o_orderkey % 2 = 0 THEN ' Q. ' ELSE ' ' END, {LAST.format(k='o_orderkey')}) AS person_name",
        f"{LEADER_TITLE.format(k='o_orderkey')} AS title_context",
        "CAST(1 + o_orderkey % 4 AS INT) AS priority", "CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence",
    )),
    "linkedin_snapshots": ("lineitem", (
        f"{LINE_ID} AS id", "l_suppkey % 25 AS company_id",
        "concat('https://linkedin.com/in/supplier-', lpad(CAST(l_suppkey AS VARCHAR(20)), 9, '0')) AS linkedin_url",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'company' ELSE 'person' END AS url_type",
        "concat('v', CAST(l_partkey AS VARCHAR(20))) AS vision_data_json", "l_shipdate AS captured_at",
    )),
    "social_media_links": ("orders", (
        "o_orderkey AS id", "o_custkey AS company_id", f"{PROFILE_URL} AS profile_url",
        "CASE o_orderkey % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'twitter' ELSE 'medium' END AS platform",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS similarity_score",
        "CASE o_orderkey % 5 WHEN 0 THEN 'footer' WHEN 1 THEN 'main' WHEN 2 THEN 'header' WHEN 3 THEN 'aside' END AS html_location",
        "CASE WHEN o_orderkey % 6 = 0 THEN 0.9 ELSE 0.5 END AS logo_similarity",
    )),
    "blog_links": ("orders", (
        "o_orderkey AS id", "o_custkey AS company_id", f"{BLOG_URL} AS blog_url", "o_orderkey % 5 <> 0 AS is_active",
        "'company_blog' AS blog_type",
    )),
    "company_logos": ("documents", (
        "doc_id AS id", "CAST(substr(source, 4) AS BIGINT) AS company_id",
        "concat(substr(md5(source), 1, 14), substr(md5(text), 1, 2)) AS perceptual_hash",
        f"{CAPTURED} AS extracted_at",
    )),
    "search_hits": ("lineitem JOIN orders ON l_orderkey = o_orderkey", (
        f"{LINE_ID} AS id", "o_custkey AS company_id",
        "concat('Story ', CAST(l_partkey AS VARCHAR(20)), CASE l_linenumber % 3 WHEN 0 THEN ' about a data breach and a lawsuit' ELSE ' about nothing' END) AS title",
        "CASE l_linenumber % 5 "
        "WHEN 0 THEN concat('https://customer-', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '.example.com/press/', CAST(l_orderkey AS VARCHAR(20))) "
        "WHEN 1 THEN concat('https://www.customer-', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '.example.org/', CAST(l_orderkey AS VARCHAR(20))) "
        "WHEN 2 THEN '' "
        "ELSE concat('https://paper.example.net/', CAST(l_orderkey % 1000 AS VARCHAR(20)), '/', CAST(l_linenumber AS VARCHAR(20))) END AS url",
        "CASE l_linenumber % 4 "
        "WHEN 0 THEN concat('Yesterday Customer#', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), ' announced a new product') "
        "WHEN 1 THEN concat('See customer-', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '.example.com for Customer#', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), ' and its funding round') "
        "WHEN 2 THEN concat('Customer#', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), ' went fishing') "
        "ELSE 'No name here, just revenue' END AS snippet",
        "CASE WHEN l_linenumber = 7 THEN 'soon' ELSE '2001-11-01T10:00:00+00:00' END AS published",
    )),
    "directory": ("orders", (
        "concat('rec', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS record_id",
        "CASE o_orderkey % 8 WHEN 0 THEN 'Homepage' WHEN 1 THEN 'LinkedIn - Corporate' WHEN 2 THEN 'LinkedIn - Person' WHEN 3 THEN 'Twitter' WHEN 4 THEN 'Blog' WHEN 5 THEN 'Crunchbase' WHEN 6 THEN 'GitHub' ELSE 'Myspace' END AS Resource",
        "concat('com', CAST(o_custkey AS VARCHAR(20))) AS company_ref",
        f"CASE o_orderkey % 8 WHEN 4 THEN {BLOG_URL} ELSE {PROFILE_URL} END AS url",
    )),
    "directory_names": ("customer", (
        "concat('com', CAST(c_custkey AS VARCHAR(20))) AS record_id",
        "CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE concat('  ', lower(c_name), ' ') END AS name",
    )),
    "scrapes": ("pages", (
        "page_id AS id", "page_id % 50 AS company_id", "url",
        "CASE WHEN page_id % 6 = 0 THEN '' ELSE html END AS markdown", "html",
        "CAST(200 + page_id % 5 AS INT) AS status_code",
        "CASE WHEN page_id % 6 = 0 THEN 'timeout' END AS error",
        "CASE page_id % 4 WHEN 0 THEN 'Wed, 21 Oct 2015 07:28:00 GMT' WHEN 1 THEN 'rubbish' WHEN 2 THEN NULL ELSE '1 Mar 2020 00:00:01 +0000' END AS last_modified",
    )),
    # Pages with the marks link discovery looks for put around the given markup.
    "linked_pages": ("pages", (
        "page_id", "page_id % 50 AS company_id", "url",
        "concat('<html><head><meta name=\"twitter:site\" content=\"@c', CAST(page_id % 50 AS VARCHAR(20)), '\"><meta property=\"og:url\" content=\"https://c', CAST(page_id % 50 AS VARCHAR(20)), '.example.com/\">', "
        "'<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"logo\": \"https://c', CAST(page_id % 50 AS VARCHAR(20)), '.example.com/l.png\", \"sameAs\": [\"https://www.linkedin.com/company/c', CAST(page_id % 50 AS VARCHAR(20)), '/about\", \"ftp://no\"]}</script></head>', "
        "html, '<footer class=\"site-foot\"><a href=\"https://github.com/c', CAST(page_id % 50 AS VARCHAR(20)), '/repo', CAST(page_id AS VARCHAR(20)), '\">code</a>', "
        "CASE WHEN page_id % 3 = 0 THEN '<a href=\"https://twitter.com/fan/status/1\">tweet</a><a href=\"https://twitter.com/fan\">fan</a>' ELSE '' END, "
        "'<a aria-label=\"Our YouTube\" href=\"https://www.youtube.com/@c', CAST(page_id % 50 AS VARCHAR(20)), '/videos\">v</a>', "
        "'<a href=\"/blog/', CAST(page_id AS VARCHAR(20)), '\">blog</a></footer></html>') AS html",
        "concat('See [us](https://x.com/c', CAST(page_id % 50 AS VARCHAR(20)), ' \"X\") or https://bsky.app/profile/c', CAST(page_id % 50 AS VARCHAR(20)), ' now') AS markdown",
    )),
    # Pages with a logo of their own, somebody else's, or none, in ten arrangements around the given markup.
    "logo_pages": ("pages", (
        "page_id", "url", "CAST(page_id % 10 AS INT) AS kind",
        "concat(CASE page_id % 10 "
        "WHEN 0 THEN concat('<script type=\"application/ld+json\">{\"@graph\": [{\"@type\": \"WebSite\", \"publisher\": {\"@type\": [\"Thing\", \"Organization\"], \"logo\": {\"url\": \"/p', CAST(page_id AS VARCHAR(20)), '.png\"}}}]}</script>') "
        "WHEN 1 THEN concat('<script type=\"application/ld+json\">{\"@type\": \"Corporation\", \"logo\": \"/yc-logo.png\"}</script><header><a href=\"/about\"><img src=\"/no.png\"></a><a href=\"/\"><b><img src=\"/h', CAST(page_id AS VARCHAR(20)), '.png\"></b></a></header>') "
        "WHEN 2 THEN concat('</div><nav><ul><li><img class=\"Brand\" src=\"/n', CAST(page_id AS VARCHAR(20)), '.png\"></nav>') "
        "WHEN 3 THEN concat('<section><h2>Trusted  by</h2><div><img class=\"logo\" src=\"/w.png\"></div></section><main><img alt=\"our logo\" src=\"/b', CAST(page_id AS VARCHAR(20)), '.png\"></main>') "
        "WHEN 4 THEN '<section><div><img class=\"logo\" src=\"/w.png\"><p>unclosed</div><h3>Our partners</h3></section><link rel=\"icon\" href=\"/i.ico\"><link rel=\"apple-touch-icon\" href=\"/touch.png\">' "
        "WHEN 5 THEN '<div id=\"logo-wall\"><span><img class=\"logo\" src=\"/w.png\"></span></div><meta property=\"og:image\" content=\"/og.png\">' "
        "WHEN 6 THEN concat('<section><h2>Used by</h2><ul><li><p><a><b><i><img class=\"logo\" src=\"/f', CAST(page_id AS VARCHAR(20)), '.png\"></i></b></a></p></li></ul></section>') "
        "WHEN 7 THEN '<header><a href=\"/\"><img alt=\"Google Play\" src=\"/g.png\"><img src=\"/second.png\"></a></header><link rel=\"shortcut icon\" href=\"/s.ico\">' "
        "WHEN 8 THEN '<div><span>Backed</span><span>by</span><img class=\"logo\" src=\"/w.png\"></div><div><p>Backed<b>by</b></p><img class=\"logo\" src=\"/glued.png\"></div>' "
        "ELSE '<img src=\"/plain.png\">' END, html) AS html",
    )),
}
SOURCES = {"lineitem JOIN orders ON l_orderkey = o_orderkey": ("lineitem", "orders", "l_orderkey", "o_orderkey")}


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table mapped from the test tables under ``sf_dir``."""
    source, expressions = MAPPINGS[name]
    if source in SOURCES:
        left, right, a, b = SOURCES[source]
        base = raw(spark, sf_dir, left).join(raw(spark, sf_dir, right), F.col(a) == F.col(b))
    else:
        base = raw(spark, sf_dir, source)
    return base.selectExpr(*expressions)


def mapping_sql(name: str) -> str:
    """The same mapping as SQL."""
    source, expressions = MAPPINGS[name]
    return f"{name} AS (SELECT {', '.join(expressions)} FROM {source})"
