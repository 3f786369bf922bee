"""Inserts, upserts, repair, checks, feeds, and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_company_name, parse_http_date
from ..operators import quality as R
from ..operators import tables as A
from ..sources import feeds as X
from ..sources.testbed import CAPTURES_AS_OF
from .case import Case, stamp, with_tables
from .links import blog, blog_home, platform, profile

LINK_KEYS = ["company_id", "profile_url"]


def halves(b):
    links = b["social_media_links"].select("id", "company_id", "profile_url")
    return links.filter("id % 4 = 0"), links.filter("id % 4 <> 0")


INSERT_SQL = """old AS (SELECT id, company_id, profile_url FROM social_media_links WHERE id % 4 = 0),
    added AS (SELECT id, company_id, profile_url FROM social_media_links WHERE id % 4 <> 0
      AND (company_id, profile_url) NOT IN (SELECT (company_id, profile_url) FROM old)
      QUALIFY row_number() OVER (PARTITION BY company_id, profile_url ORDER BY id) = 1)"""


def incoming_companies(b):
    return b["companies"].filter("id % 2 = 0").selectExpr(
        "id + 1000000 AS id", "CASE WHEN id % 4 = 0 THEN name ELSE concat('New ', name) END AS name", "homepage_url", "'IMPORT' AS source_sheet",
        "flagged_for_review", "flag_reason", "performed_by", "updated_at")


UPSERT_SQL = """inc AS (SELECT id + 1000000 AS id, CASE WHEN id % 4 = 0 THEN name ELSE concat('New ', name) END AS name, homepage_url FROM companies WHERE id % 2 = 0)"""


def removed(b):
    return A.delete_cascade(b.tables("companies", "snapshots", "change_records", "company_statuses"), b["companies"].filter("id % 10 = 3").select("id"))


def patched(b):
    patch = b["change_records"].filter("id % 5 = 0").selectExpr("id", "'reviewed' AS significance_classification", "id AS reviewer")
    return A.update_by_key(b["change_records"], patch, ["id"], ["significance_classification", "reviewer"])


# Snapshots whose URL belongs, more or less exactly, to some company's homepage.
OFFSET = "concat('https://customer-', lpad(CAST(doc_id % 1600 AS VARCHAR(20)), 9, '0'), '.example.com', CASE doc_id % 3 WHEN 0 THEN '/' ELSE '' END)"
MISPLACED = f"SELECT doc_id AS id, doc_id % 97 AS company_id, {OFFSET} AS url, {{captured}} AS captured_at FROM {{documents}}"
CAPTURED = "TIMESTAMP '2024-01-31 00:00:00' - (doc_id % 720) * INTERVAL '1' HOUR"
SITES = "SELECT id, name, source_sheet, CASE WHEN id % 7 = 2 THEN ' ' || homepage_url WHEN id % 50 = 1 THEN 'https://customer-000000002.example.com' ELSE homepage_url END AS homepage_url FROM {companies}"
SITES_SQL = "sites AS (" + SITES.replace("{companies}", "companies") + ")"
MISPLACED_SQL = "misplaced AS (" + MISPLACED.format(captured=CAPTURED, documents="documents") + ")"
REMAP_SQL = SITES_SQL + ", " + MISPLACED_SQL + r""", ex AS (SELECT homepage_url AS u, min(id) AS o FROM sites WHERE homepage_url IS NOT NULL GROUP BY 1),
    tr AS (SELECT trim(homepage_url) AS u, min(id) AS o FROM sites WHERE homepage_url IS NOT NULL GROUP BY 1),
    found AS (SELECT m.*, e.o AS e, s.o AS s, t.o AS t FROM misplaced m LEFT JOIN ex e ON e.u = m.url LEFT JOIN ex s ON s.u = regexp_replace(m.url, '/+$', '')
      LEFT JOIN tr t ON t.u = m.url),
    remapped AS (SELECT id, coalesce(e, s, t, company_id) AS company_id, CASE WHEN coalesce(e, s, t) <> company_id THEN
      CASE WHEN e IS NOT NULL THEN 'exact_match' WHEN s IS NOT NULL THEN 'trailing_slash' ELSE 'whitespace_trim' END END AS remap_phase FROM found)"""


def misplaced(b):
    return b.spark.sql(MISPLACED.replace("{captured}", CAPTURED), documents=b.raw("documents"))


def sites(b):
    return b.spark.sql(SITES, companies=b["companies"])


def remapped(b):
    return R.remap_snapshots(misplaced(b), sites(b))


def changes_of_snapshots(b):
    return b["change_records"].withColumn("snapshot_id_old", F.expr("id % 900"))


def merged(b):
    pairs = b["companies"].filter("id % 10 = 9").selectExpr("id AS keeper_id", "id - 1 AS duplicate_id")
    return R.merge_companies({
        "companies": b["companies"], "social_media_links": b["social_media_links"].select("id", "company_id", "profile_url"),
        "news_articles": b["news_articles"].select("id", "company_id", "content_url")}, pairs)


def integrity_tables(b):
    return {"companies": sites(b), "snapshots": misplaced(b), "change_records": changes_of_snapshots(b), "social_media_links": b["social_media_links"]}


SNAPSHOT_RULES = {
    "company_id_positive": "company_id > 0", "status_code_range": "status_code BETWEEN 100 AND 599", "error_message_short": "error_message IS NULL OR length(error_message) <= 2000",
    "captured_at_past": "captured_at <= TIMESTAMP '2024-01-20 00:01:00'", "content_or_error": "coalesce(content_markdown, error_message) IS NOT NULL",
    "content_checksum_md5": r"content_checksum IS NULL OR regexp_matches(lower(content_checksum), '^[0-9a-f]{32}$')",
    "checksum_given": "content_markdown IS NULL OR content_checksum IS NOT NULL", "url_valid": "starts_with(url, 'https://c')",
}


def snapshot_rules():
    every = R.table_rules("2024-01-20 00:00:00")["snapshots"]
    return {k: v for k, v in every.items() if k in SNAPSHOT_RULES}


DIRECTORY_SQL = rf"""dir AS (SELECT d.*, lower(Resource) AS kind, n.name AS nm FROM directory d LEFT JOIN directory_names n ON n.record_id = d.company_ref),
    owned AS (SELECT d.*, c.id AS company_id FROM dir d LEFT JOIN (SELECT lower(name) AS k, min(id) AS id FROM companies GROUP BY 1) c ON c.k = lower(trim(d.nm))),
    prof AS (SELECT *, coalesce({platform('url')}, split_part(kind, ' - ', 1)) AS platform, {profile('url')} AS profile_url FROM owned
      WHERE company_id IS NOT NULL AND kind IN ('linkedin - corporate', 'linkedin - person', 'twitter', 'github')),
    kept AS (SELECT company_id, platform, profile_url, CASE kind WHEN 'linkedin - person' THEN 'personal' WHEN 'linkedin - corporate' THEN 'company' END AS account_type, record_id
      FROM prof QUALIFY row_number() OVER (PARTITION BY company_id, profile_url ORDER BY record_id) = 1),
    posts AS (SELECT company_id, coalesce({blog('url')}, 'company_blog') AS blog_type, {blog_home('url')} AS blog_url, record_id FROM owned WHERE company_id IS NOT NULL AND kind = 'blog'
      QUALIFY row_number() OVER (PARTITION BY company_id, {blog_home('url')} ORDER BY record_id) = 1)"""


def directory(b):
    return b["directory"].withColumnRenamed("company_ref", "company_name").withColumn("company_name", F.array("company_name"))


def imported(b):
    return X.import_profile_links(directory(b), b["directory_names"], b["companies"], CAPTURES_AS_OF)


TITLED = "array_to_string(list_transform(regexp_extract_all({0}, '[a-zA-Z]+|[^a-zA-Z]+'), lambda s: upper(s[1]) || lower(s[2:])), '')"

# Documents at a homepage, below one, behind a redirect, and elsewhere.
DOCUMENTS = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('https://customer-', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '.example.com')
    WHEN 1 THEN concat('https://customer-', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '.example.com/about')
    WHEN 2 THEN concat('https://r.example.net/?to=https://customer-', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '.example.com&x=1') ELSE concat('https://other.example.net/', CAST(o_orderkey AS VARCHAR(20))) END AS url
    FROM {orders}"""
DOCUMENTS_SQL = "docs AS (" + DOCUMENTS.replace("{orders}", "orders") + """), home AS (SELECT homepage_url AS u, id AS o FROM companies WHERE homepage_url IS NOT NULL),
    hit AS (SELECT d.id, d.url, h.o, h.u FROM docs d JOIN home h ON h.u = CASE d.id % 4 WHEN 0 THEN d.url WHEN 1 THEN replace(d.url, '/about', '')
      WHEN 2 THEN replace(replace(d.url, 'https://r.example.net/?to=', ''), '&x=1', '') END)"""


# Homepages without a scheme; one in ten by its first label alone.
BARE = "CASE WHEN id % 10 = 3 THEN split_part(replace(homepage_url, 'https://', ''), '.', 1) ELSE replace(homepage_url, 'https://', '') END"


def bare_homepages(b):
    return b["companies"].withColumn("homepage_url", F.expr(BARE))


def matched_documents(b):
    return X.match_documents(b.spark.sql(DOCUMENTS, orders=b.raw("orders")), b["companies"])


def scrapes(b):
    return b["scrapes"].withColumn("metadata", F.create_map(F.lit("Last-Modified"), F.col("last_modified")))


def _sizes(tables):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


CASES = {
    "insert_ignore": Case(
        lambda b: A.insert_ignore(*halves(b), LINK_KEYS, ["id"]),
        with_tables("social_media_links", "SELECT * FROM old UNION ALL SELECT * FROM added", INSERT_SQL)),
    "new_rows": Case(
        lambda b: A.new_rows(*halves(b), LINK_KEYS, ["id"]),
        with_tables("social_media_links", "SELECT * FROM added", INSERT_SQL)),
    "upsert_companies": Case(
        lambda b: A.upsert_companies(b["companies"], incoming_companies(b), CAPTURES_AS_OF).select("id", "name", "homepage_url", "source_sheet", stamp("updated_at")),
        with_tables("companies", f"""SELECT c.id, c.name, c.homepage_url, CASE WHEN c.id % 4 = 0 THEN 'IMPORT' ELSE source_sheet END AS source_sheet,
            CASE WHEN c.id % 4 = 0 THEN '2024-01-31 00:00:00' ELSE '2000-01-01 00:00:00' END AS updated_at FROM companies c
            UNION ALL SELECT id, name, homepage_url, 'IMPORT', '2024-01-31 00:00:00' FROM inc WHERE starts_with(name, 'New ')""", UPSERT_SQL)),
    "append_log": Case(
        lambda b: A.append_log(b["company_statuses"], b["company_statuses"], "me").groupBy("performed_by", "status").agg(F.count("*").alias("n")),
        with_tables("company_statuses", """SELECT performed_by, status, count(*) AS n FROM (SELECT NULL AS performed_by, status FROM company_statuses
            UNION ALL SELECT 'me', status FROM company_statuses) GROUP BY ALL""")),
    "update_by_key": Case(
        lambda b: patched(b).select("id", "significance_classification", F.coalesce("reviewer", F.lit(-1)).alias("reviewer")),
        with_tables("change_records", """SELECT id, CASE WHEN id % 5 = 0 THEN 'reviewed' ELSE significance_classification END AS significance_classification,
            CASE WHEN id % 5 = 0 THEN id ELSE -1 END AS reviewer FROM change_records""")),
    "delete_cascade": Case(
        lambda b: _sizes(removed(b)),
        with_tables("companies snapshots change_records company_statuses", """SELECT 'companies' AS name, count(*) AS n FROM companies WHERE id % 10 <> 3
            UNION ALL SELECT 'snapshots', count(*) FROM snapshots WHERE company_id % 10 <> 3
            UNION ALL SELECT 'change_records', count(*) FROM change_records WHERE company_id % 10 <> 3
            UNION ALL SELECT 'company_statuses', count(*) FROM company_statuses WHERE company_id NOT IN (SELECT id FROM companies WHERE id % 10 = 3)""")),
    "delete_row_audit": Case(
        lambda b: A.delete_row(b["social_media_links"], 7, 7, "social_media_links", CAPTURES_AS_OF, "me")[0].agg(F.count("*").alias("n")),
        with_tables("social_media_links", "SELECT count(*) AS n FROM social_media_links WHERE NOT (id = 7 AND company_id = 7)")),
    "backfill_operator": Case(
        lambda b: A.backfill_operator(b.tables("companies"), "me")["companies"].groupBy("performed_by").agg(F.count("*").alias("n")),
        with_tables("companies", "SELECT coalesce(performed_by, 'me') AS performed_by, count(*) AS n FROM companies GROUP BY 1")),
    "constraint_violations": Case(
        lambda b: R.check_constraints(b["snapshots"].withColumn("content_html", F.lit(None).cast("string")), snapshot_rules()),
        with_tables("snapshots", " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM snapshots WHERE NOT coalesce({c}, false)" for n, c in SNAPSHOT_RULES.items()))),
    "violation_rates": Case(
        lambda b: R.violation_rates(b["snapshots"].withColumn("content_html", F.lit(None).cast("string")), snapshot_rules()).withColumn("rate", F.round("rate", 6)),
        with_tables("snapshots", " UNION ALL ".join(
            f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({c}, false)) AS violations, round(count(*) FILTER (NOT coalesce({c}, false)) / count(*), 6)::DOUBLE AS rate FROM snapshots"
            for n, c in SNAPSHOT_RULES.items()))),
    "company_violations": Case(
        lambda b: R.check_constraints(b["companies"], R.table_rules(CAPTURES_AS_OF)["companies"]),
        with_tables("companies", "SELECT id, 'flag_reason_given' AS rule FROM companies WHERE flagged_for_review AND flag_reason IS NULL")),
    "change_record_violations": Case(
        lambda b: R.check_constraints(b["change_records"].withColumn("checksum_old", F.lit("x")).withColumn("checksum_new", F.md5(F.lit("y"))),
                                      R.table_rules(CAPTURES_AS_OF)["change_records"]).groupBy("rule").agg(F.count("*").alias("n")),
        with_tables("change_records", """SELECT 'checksum_old_md5' AS rule, count(*) AS n FROM change_records
            UNION ALL SELECT 'confidence_share', count(*) AS n FROM change_records WHERE significance_confidence > 1 HAVING count(*) > 0""")),
    "remap_snapshots": Case(
        lambda b: remapped(b).select("id", "company_id", "remap_phase"),
        with_tables("companies", "SELECT id, company_id, remap_phase FROM remapped", REMAP_SQL)),
    "remap_counts": Case(
        lambda b: R.remap_counts(remapped(b)),
        with_tables("companies", "SELECT remap_phase, count(*) AS snapshots FROM remapped WHERE remap_phase IS NOT NULL GROUP BY 1", REMAP_SQL)),
    "realign_changes": Case(
        lambda b: R.realign_changes(changes_of_snapshots(b), misplaced(b)).select("id", "company_id"),
        with_tables("change_records", """SELECT c.id, coalesce(m.company_id, c.company_id) AS company_id FROM change_records c
            LEFT JOIN misplaced m ON m.id = c.id % 900""", MISPLACED_SQL)),
    "merge_companies": Case(
        lambda b: merged(b)["companies"].select("id", "name", "homepage_url"),
        with_tables("companies", """SELECT c.id, c.name, CASE WHEN c.id % 10 = 9 THEN coalesce(nullif(c.homepage_url, ''), d.homepage_url) ELSE c.homepage_url END AS homepage_url
            FROM companies c LEFT JOIN companies d ON d.id = c.id - 1 WHERE NOT (c.id % 10 = 8 AND c.id + 1 IN (SELECT id FROM companies))""")),
    "merge_company_links": Case(
        lambda b: merged(b)["social_media_links"],
        with_tables("companies social_media_links", """SELECT id, owner AS company_id, profile_url FROM (SELECT l.*, CASE WHEN company_id % 10 = 8 AND company_id + 1 IN (SELECT id FROM companies)
            THEN company_id + 1 ELSE company_id END AS owner FROM social_media_links l) QUALIFY row_number() OVER (PARTITION BY owner, profile_url ORDER BY owner <> company_id, id) = 1""")),
    "integrity_report": Case(
        lambda b: R.integrity_report(integrity_tables(b)),
        with_tables("companies change_records social_media_links", """SELECT 'wrong_company_url' AS check_name, count(*) AS rows FROM misplaced m WHERE EXISTS
              (SELECT 1 FROM sites s WHERE s.homepage_url = m.url AND s.id <> m.company_id)
            UNION ALL SELECT 'url_mismatch', count(*) FROM misplaced m JOIN sites s ON s.id = m.company_id WHERE m.url <> s.homepage_url
            UNION ALL SELECT 'misaligned_change', count(*) FROM change_records c JOIN misplaced m ON m.id = c.id % 900 WHERE c.company_id <> m.company_id
            UNION ALL SELECT 'duplicate_url', count(*) FROM (SELECT homepage_url FROM sites WHERE homepage_url IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
            UNION ALL SELECT 'orphan_snapshot', count(*) FROM misplaced WHERE company_id NOT IN (SELECT id FROM sites)
            UNION ALL SELECT 'orphan_change', count(*) FROM change_records WHERE company_id NOT IN (SELECT id FROM sites)
            UNION ALL SELECT 'companies', count(*) FROM sites UNION ALL SELECT 'snapshots', count(*) FROM misplaced
            UNION ALL SELECT 'change_records', count(*) FROM change_records UNION ALL SELECT 'social_media_links', count(*) FROM social_media_links""", SITES_SQL + ", " + MISPLACED_SQL)),
    "load_companies": Case(
        lambda b: X.load_companies(directory(b), b["directory_names"])[0],
        with_tables("directory directory_names companies", f"""SELECT record_id, {TITLED.format('trim(nm)')} AS name, url AS homepage_url, 'Online Presence' AS source_sheet
            FROM dir WHERE kind = 'homepage' AND coalesce(nm, '') <> ''""", DIRECTORY_SQL)),
    "load_companies_counts": Case(
        lambda b: X.load_companies(directory(b), b["directory_names"])[1],
        with_tables("directory directory_names companies", """SELECT count(*) AS processed, count(*) FILTER (kind = 'homepage' AND coalesce(nm, '') <> '') AS stored,
            count(*) FILTER (NOT (kind = 'homepage' AND coalesce(nm, '') <> '')) AS skipped FROM dir""", DIRECTORY_SQL)),
    "import_profiles": Case(
        lambda b: imported(b)[0].select("company_id", "platform", "profile_url", "account_type", "record_id"),
        with_tables("directory directory_names companies", "SELECT company_id, platform, profile_url, account_type, record_id FROM kept", DIRECTORY_SQL)),
    "import_blogs": Case(
        lambda b: imported(b)[1].select("company_id", "blog_type", "blog_url", "record_id"),
        with_tables("directory directory_names companies", "SELECT company_id, blog_type, blog_url, record_id FROM posts", DIRECTORY_SQL)),
    "import_counts": Case(
        lambda b: imported(b)[2],
        with_tables("directory directory_names companies", """SELECT count(*) AS processed, count(*) FILTER (p) AS profiles, count(*) FILTER (q) AS blogs,
            count(*) FILTER (NOT p AND NOT q) AS skipped FROM (SELECT company_id IS NOT NULL AND kind IN ('linkedin - corporate', 'linkedin - person', 'twitter', 'github') AS p,
              company_id IS NOT NULL AND kind = 'blog' AS q FROM owned)""", DIRECTORY_SQL)),
    "prepare_snapshots": Case(
        lambda b: X.prepare_snapshots(scrapes(b), CAPTURES_AS_OF).select(
            "id", "company_id", "url", "content_markdown", "content_checksum", "status_code", "error_message", stamp("http_last_modified"), "has_paywall"),
        with_tables("scrapes", """SELECT id, company_id, url, nullif(markdown, '') AS content_markdown, md5(nullif(markdown, '')) AS content_checksum, status_code, error AS error_message,
            CASE id % 4 WHEN 0 THEN '2015-10-21 07:28:00' WHEN 3 THEN '2020-03-01 00:00:01' END AS http_last_modified, false AS has_paywall FROM scrapes""")),
    "http_dates": Case(
        lambda b: b["scrapes"].select("id", stamp(parse_http_date("last_modified"), "modified")),
        with_tables("scrapes", "SELECT id, CASE id % 4 WHEN 0 THEN '2015-10-21 07:28:00' WHEN 3 THEN '2020-03-01 00:00:01' END AS modified FROM scrapes")),
    "company_names": Case(
        lambda b: b.raw("part").select("p_partkey", normalize_company_name(F.concat(F.lit("  "), "p_name", F.lit("'s   "), "p_brand", F.lit("-x3y "))).alias("name")),
        "SELECT p_partkey, " + TITLED.format("concat(p_name, '''s ', p_brand, '-x3y')") + " AS name FROM part"),
    "matched_documents": Case(
        lambda b: matched_documents(b)[0].select("id", "company_id", "matched_url"),
        with_tables("companies", "SELECT id, o AS company_id, u AS matched_url FROM hit", DOCUMENTS_SQL)),
    "documents_of_bare_homepages": Case(
        lambda b: X.match_documents(b.spark.sql(DOCUMENTS, orders=b.raw("orders")), bare_homepages(b))[0].select("id", "company_id", "matched_url"),
        with_tables("companies", """SELECT id, o AS company_id, u AS matched_url FROM docs JOIN bare ON contains(url, u)
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1""",
            "docs AS (" + DOCUMENTS.replace("{orders}", "orders") + "), bare AS (SELECT " + BARE + """ AS u, min(id) AS o FROM companies
            WHERE homepage_url IS NOT NULL GROUP BY 1)""")),
    "unmatched_documents": Case(
        lambda b: matched_documents(b)[1],
        with_tables("companies", "SELECT id, url FROM docs WHERE id NOT IN (SELECT id FROM hit)", DOCUMENTS_SQL)),
    "companies_without_document": Case(
        lambda b: matched_documents(b)[2].select("id", "homepage_url"),
        with_tables("companies", "SELECT id, homepage_url FROM companies WHERE homepage_url IS NOT NULL AND homepage_url NOT IN (SELECT u FROM hit)", DOCUMENTS_SQL)),
    "social_sources": Case(
        lambda b: X.collect_social_sources(b["social_media_links"], b["blog_links"]),
        with_tables("social_media_links blog_links", """SELECT company_id, profile_url AS source_url, 'medium' AS source_type FROM social_media_links WHERE platform = 'medium'
            UNION ALL SELECT company_id, blog_url, 'blog' FROM blog_links WHERE is_active""")),
}
