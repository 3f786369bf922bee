"""News matching, ingest and queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import company_description
from ..operators import news as N
from ..operators.tables import first_per_key
from ..sources.feeds import prepare_articles
from ..sources.testbed import NEWS_AS_OF
from .case import Case, joined, stamp, time_sql, with_tables
from .links import domain, host
from .signals import DEFAULT_OPTIONS, hits_sql, terms_sql, verdict_sql
from ..functions.keywords import default_terms
from .. import fixed

ARTICLES_SQL = f"""art AS (SELECT id, company_id, title, url, snippet, {domain('url')} AS source,
    coalesce(try_strptime(published, '%Y-%m-%dT%H:%M:%S+00:00'), TIMESTAMP '2001-11-05 00:00:00') AS published FROM search_hits WHERE url <> '')"""
EDGE = r"(^|[^a-zA-Z0-9.\-])"
NAMED = "|".join(fixed.BUSINESS_WORDS)
# Every mapped snippet is shorter than the 200 characters looked at on each side of a name.
MATCH_SQL = ARTICLES_SQL + rf""", own AS (SELECT a.*, c.name, coalesce({domain('c.homepage_url')}, '') AS dom FROM art a JOIN companies c ON c.id = a.company_id),
    flags AS (SELECT *, dom <> '' AND (regexp_matches(lower(url), '{EDGE}' || replace(dom, '.', '\.') || '([^a-zA-Z0-9\-]|$)')
        OR regexp_matches(lower(snippet), '{EDGE}' || replace(dom, '.', '\.') || '([^a-zA-Z0-9\-]|$)')) AS by_domain,
      contains(lower(snippet), lower(name)) AND regexp_matches(lower(snippet), '{NAMED}') AS by_context,
      regexp_replace(source, '\.[^.]*$', '') AS sn, regexp_replace(dom, '\.[^.]*$', '') AS dn FROM own),
    rated AS (SELECT *, NOT by_domain AND dom <> '' AND source <> dom AND sn <> '' AND dn <> ''
        AND (sn = dn OR ((starts_with(sn, dn) OR starts_with(dn, sn)) AND least(length(sn), length(dn)) >= 3)) AS competing FROM flags),
    base AS (SELECT *, CASE WHEN by_domain THEN 0.35 WHEN competing THEN -0.07 ELSE 0 END + CASE WHEN by_context THEN 0.25 ELSE 0 END AS b FROM rated),
    asked AS (SELECT *, id % 3 = 0 AND greatest(b, 0) < 0.4 AS confirmed FROM base),
    scored AS (SELECT *, greatest(0, least(1, b + CASE WHEN confirmed THEN 0.4 ELSE 0 END))::DOUBLE AS match_confidence FROM asked)"""
EVIDENCE = """array_to_string(list_filter([CASE WHEN by_domain THEN 'Domain match: ' || dom END,
    CASE WHEN by_context THEN 'Name in business context: ' || name END, CASE WHEN confirmed THEN 'LLM verification: because' END], lambda e: e IS NOT NULL), '|')"""
INGEST_SQL = MATCH_SQL + f""", known AS (SELECT DISTINCT url AS u FROM art WHERE id % 11 = 0 UNION SELECT content_url FROM news_articles),
    good AS (SELECT *, snippet || ' ' || title AS subject FROM scored WHERE match_confidence >= 0.4 AND url NOT IN (SELECT u FROM known)),
    {terms_sql(default_terms())}, {hits_sql('good', 'id', 'subject', DEFAULT_OPTIONS)}, {verdict_sql('good', 'id', "'minor'")},
    stored AS (SELECT g.*, v.classification, v.sentiment, v.confidence FROM good g JOIN verdicts v ON v.k = g.id
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY company_id, title) = 1)"""


def articles(b):
    return prepare_articles(b["search_hits"], NEWS_AS_OF)



def first_articles(b):
    """One article per company and URL, and a verdict on each."""
    every = first_per_key(articles(b), ["company_id", "url"], ["id"])
    votes = every.select("company_id", "url", (F.col("id") % 3 == 0).alias("is_match"), F.lit("because").alias("reasoning"))
    return every, votes


def matched(b):
    every, votes = first_articles(b)
    return N.match_articles(every, b["companies"], votes)


def ingested(b):
    every, votes = first_articles(b)
    existing = b["news_articles"].unionByName(
        articles(b).filter("id % 11 = 0").select(F.col("url").alias("content_url")), allowMissingColumns=True)
    return N.ingest_news(every, b["companies"], existing, NEWS_AS_OF, votes)


FIRST_ARTICLES = ARTICLES_SQL.replace("art AS (", "hits0 AS (") + ", art AS (SELECT * FROM hits0 QUALIFY row_number() OVER (PARTITION BY company_id, url ORDER BY id) = 1)"
FIRST_MATCH = MATCH_SQL.replace(ARTICLES_SQL, FIRST_ARTICLES)
FIRST_INGEST = INGEST_SQL.replace(ARTICLES_SQL, FIRST_ARTICLES).replace("FROM art WHERE id % 11 = 0", "FROM hits0 WHERE id % 11 = 0")

CASES = {
    "prepare_articles": Case(
        lambda b: articles(b).select("id", "title", "url", "source", stamp("published")),
        with_tables("search_hits", f"SELECT id, title, url, source, {time_sql('published')} FROM art", ARTICLES_SQL)),
    "match_articles": Case(
        lambda b: matched(b).select("id", F.round("match_confidence", 6).alias("match_confidence"), joined("match_evidence", "match_evidence"), "is_match"),
        with_tables("search_hits companies", f"""SELECT id, round(match_confidence, 6) AS match_confidence, {EVIDENCE} AS match_evidence,
            match_confidence >= 0.4 AS is_match FROM scored""", FIRST_MATCH)),
    "competing_domains": Case(
        lambda b: articles(b).join(b["companies"].selectExpr("id AS company_id", "homepage_url"), "company_id").select(
            "id", N.competing_domain("url", F.coalesce(N.url_domain("homepage_url"), F.lit(""))).alias("competing")),
        with_tables("search_hits companies", """SELECT id, dom <> '' AND source <> dom AND sn <> '' AND dn <> ''
            AND (sn = dn OR ((starts_with(sn, dn) OR starts_with(dn, sn)) AND least(length(sn), length(dn)) >= 3)) AS competing FROM flags""", MATCH_SQL)),
    "ingest_news": Case(
        lambda b: ingested(b)[0].select("company_id", "content_url", "title", F.round("match_confidence", 6).alias("match_confidence"),
                                        "significance_classification", "significance_sentiment"),
        with_tables("search_hits companies news_articles", """SELECT company_id, url AS content_url, title, round(match_confidence, 6) AS match_confidence,
            classification AS significance_classification, sentiment AS significance_sentiment FROM stored""", FIRST_INGEST)),
    "ingest_news_counts": Case(
        lambda b: ingested(b)[1],
        with_tables("search_hits companies news_articles", """SELECT company_id, count(*) AS found, count(g.id) AS verified, count(s.id) AS stored FROM art a
            LEFT JOIN (SELECT id FROM good) g ON g.id = a.id LEFT JOIN (SELECT id FROM stored) s ON s.id = a.id GROUP BY company_id""", FIRST_INGEST)),
    "significant_news": Case(
        lambda b: N.significant_news(b["news_articles"], b["companies"], NEWS_AS_OF, 30, "negative").select("id", "company_name", stamp("published_at")),
        with_tables("news_articles companies", f"""SELECT n.id, c.name AS company_name, {time_sql('published_at')} FROM news_articles n
            JOIN companies c ON c.id = n.company_id WHERE significance_classification = 'significant' AND significance_sentiment = 'negative'
            AND CAST(published_at AS DATE) >= DATE '2001-11-05' - 30""")),
    "news_filtered": Case(
        lambda b: N.news_filtered(b["news_articles"], b["companies"], NEWS_AS_OF, 60, sentiment="positive").select("id", "company_name"),
        with_tables("news_articles companies", """SELECT n.id, c.name AS company_name FROM news_articles n JOIN companies c ON c.id = n.company_id
            WHERE significance_sentiment = 'positive' AND CAST(published_at AS DATE) >= DATE '2001-11-05' - 60""")),
    "recent_news_of_company": Case(
        lambda b: N.recent_by_company(b["news_articles"], 11).select("id", "title"),
        with_tables("news_articles", "SELECT id, title FROM news_articles WHERE company_id = 11")),
    "company_description": Case(
        lambda b: b["snapshots"].select("id", company_description("content_markdown").alias("description")),
        with_tables("snapshots", r"""SELECT id, trim(substr(array_to_string(list_filter(list_transform(string_split(coalesce(content_markdown, ''), chr(10)),
            lambda l: trim(l, chr(32) || chr(9) || chr(13))), lambda l: length(l) >= 20 AND NOT regexp_full_match(l, '!?\[.*?\]\(.*?\)')
            AND NOT regexp_full_match(l, 'https?://\S+') AND NOT (regexp_matches(l, '^#{1,6}\s+')
              AND length(trim(regexp_extract(l, '^#{1,6}\s+(.*)', 1))) < 20)), ' '), 1)) AS description FROM snapshots""")),
}
