"""Leadership: mentions, titles, profiles, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import titles as T
from ..operators import people as P
from ..operators.changes import with_company
from ..sources.testbed import CAPTURES_AS_OF, FIRST, LAST, LEADER_TITLE
from .case import Case, joined, stamp, time_sql, with_tables

NAME = "concat({first}, ' ', {last})".format(first=FIRST.format(k="o_orderkey"), last=LAST.format(k="o_orderkey"))
OTHER = "concat({first}, ' ', {last})".format(first=FIRST.format(k="(o_orderkey + 3)"), last=LAST.format(k="(o_orderkey + 4)"))
# A sentence per order, in each of the forms a leader is named.
SENTENCE = f"""concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Some longer words to lead into the matter. ' ELSE '' END,
    CASE o_orderkey % 8 WHEN 0 THEN concat('CEO: **', {NAME}, '**') WHEN 1 THEN concat('Meet our co-founder & ceo, ', {NAME})
    WHEN 2 THEN concat({NAME}, ', President') WHEN 3 THEN concat('[', {NAME}, '](https://x.y/z) (Founder)') WHEN 4 THEN concat({NAME}, ' is the chief executive officer')
    WHEN 5 THEN concat('Founded by ', {NAME}, ' and ', {OTHER}) WHEN 6 THEN concat('co-founded by ', {NAME}) ELSE concat('CEO: Global Analytics, founder ', lower({NAME})) END,
    ' in a town that is far away from everything else.')"""
SAID_SQL = f"""said AS (SELECT o_orderkey AS id, o_custkey AS company_id, {NAME} AS n, {OTHER} AS o, {SENTENCE} AS content_markdown FROM orders),
    named AS (SELECT id, company_id, n AS person_name, CASE id % 8 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Co-Founder and CEO' WHEN 2 THEN 'President' WHEN 3 THEN 'Founder'
        WHEN 4 THEN 'Chief Executive Officer' ELSE 'Founder' END AS title_context, CASE WHEN id % 8 IN (0, 1) THEN 1 WHEN id % 8 IN (2, 3) THEN 2 WHEN id % 8 = 4 THEN 3 ELSE 4 END AS priority
        FROM said WHERE id % 8 <> 7
      UNION ALL SELECT id, company_id, o, 'Founder', 4 FROM said WHERE id % 8 = 5 AND o <> n)"""

# Titles in many spellings.
TITLE = """concat(CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE '' END, CASE p_partkey % 13 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Chief Executive Officer' WHEN 2 THEN 'co-founder'
    WHEN 3 THEN 'Chief Happiness Officer' WHEN 4 THEN 'VP of Product' WHEN 5 THEN 'Senior Vice President' WHEN 6 THEN 'Engineer' WHEN 7 THEN 'cto'
    WHEN 8 THEN 'managing director' WHEN 9 THEN 'President' WHEN 10 THEN 'Founder and CEO at Acme' WHEN 11 THEN 'Cofounder' ELSE p_name END)"""
RANKS = " ".join(f"WHEN '{t}' THEN {r}" for t, r in fixed.TITLE_RANKS.items())
SHORT = " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in fixed.TITLE_SHORT_FORMS.items())
ROLES = " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in fixed.TITLE_ROLES.items())
ANY = r"\b(" + "|".join(sorted(fixed.TITLE_RANKS, key=len, reverse=True)) + r")\b"
CHIEF, VICE = fixed.CHIEF_OFFICER, fixed.VICE_PRESIDENT

HIT_NAME = "concat({first}, ' ', {last})".format(first=FIRST.format(k="l_orderkey"), last=LAST.format(k="l_partkey"))
HITS = f"""SELECT l_orderkey AS id, l_suppkey AS company_id, l_linenumber AS position, n,
    CASE l_linenumber % 5 WHEN 0 THEN concat(n, ' - CEO - Acme | LinkedIn') WHEN 1 THEN concat(n, ' | Founder') WHEN 2 THEN n WHEN 3 THEN concat(n, ' - VP of Product') ELSE ' - nobody' END AS title,
    CASE WHEN l_linenumber % 2 = 0 THEN concat('see https://www.linkedin.com/in/s', CAST(l_suppkey AS VARCHAR(20)), '?x=1 there') ELSE 'no link' END AS snippet,
    CASE l_linenumber % 3 WHEN 0 THEN concat('https://linkedin.com/in/p', CAST(l_orderkey % 500 AS VARCHAR(20)), '/?trk=a') WHEN 1 THEN 'https://example.com/' ELSE concat('https://t.co/?u=http://linkedin.com/in/q', CAST(l_orderkey % 500 AS VARCHAR(20))) END AS url
    FROM (SELECT *, {HIT_NAME} AS n FROM {{lineitem}})"""
HITS_SQL = "hit AS (" + HITS.replace("{lineitem}", "lineitem") + r"""),
    prof AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://(www\.)?linkedin\.com/in/') THEN regexp_replace(split_part(url, '?', 1), '/+$', '') END AS own,
      nullif(regexp_extract(snippet, 'https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+'), '') AS from_snippet,
      nullif(regexp_extract(url, 'https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+'), '') AS from_url FROM hit),
    parsed AS (SELECT id, company_id, position, n AS name, CASE position % 5 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Founder' WHEN 3 THEN 'VP of Product' ELSE '' END AS person_title,
      coalesce(own, from_snippet, from_url) AS profile_url FROM prof WHERE position % 5 <> 4 AND coalesce(own, from_snippet, from_url) IS NOT NULL)"""


def search_results(b):
    return b.spark.sql(HITS, lineitem=b.raw("lineitem"))


def sentences(b):
    return b.spark.sql(f"SELECT o_orderkey AS id, o_custkey AS company_id, {SENTENCE} AS content_markdown FROM {{orders}}", orders=b.raw("orders"))


def rosters(b):
    people = b["company_leadership"]
    return people.filter("in_previous"), people.filter("in_current")


def roster_changes(b):
    return P.compare_rosters(*rosters(b))


ROSTER_SQL = """chg AS (SELECT company_id, linkedin_profile_url, person_name, title,
      CASE WHEN in_previous THEN CASE title WHEN 'CEO' THEN 'ceo_departure' WHEN 'Founder' THEN 'founder_departure' WHEN 'CTO' THEN 'cto_departure'
        WHEN 'COO' THEN 'coo_departure' ELSE 'executive_departure' END ELSE CASE title WHEN 'CEO' THEN 'new_ceo' ELSE 'new_leadership' END END AS change_type,
      CASE WHEN in_previous AND title IN ('CEO', 'Founder', 'CTO', 'COO') THEN 'critical' ELSE 'notable' END AS severity
      FROM company_leadership WHERE in_previous <> in_current)"""
TOKENS = """list_sort(list_distinct(list_filter(list_transform(string_split(lower({0}), ' '), lambda w: trim(w, '.,;')),
    lambda w: length(w) > 1 AND w NOT IN ('dr', 'mr', 'mrs', 'ms', 'prof', 'professor'))))"""
MATCHES_SQL = f"""m AS (SELECT *, {TOKENS.format('person_name')} AS t FROM leadership_mentions), l AS (SELECT *, {TOKENS.format('person_name')} AS t FROM company_leadership),
    hit AS (SELECT m.company_id, m.id AS mention_id, min(l.id) AS leader_id FROM m JOIN l ON l.company_id = m.company_id
      AND len(list_intersect(m.t, l.t)) >= 2 GROUP BY ALL)"""

EMPLOYED = """SELECT o_orderkey AS id, o_custkey AS company_id,
    CASE WHEN o_orderkey % 3 = 0 THEN named_struct('is_employed', o_orderkey % 2 = 0, 'never_employed', o_orderkey % 5 = 0, 'evidence', 'seen', 'current_title', 'X', 'current_employer', 'Y',
      'error', CASE WHEN o_orderkey % 4 = 0 THEN 'blurred' END) END AS verdict,
    CASE WHEN o_orderkey % 7 = 1 THEN concat('CEO at Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) WHEN o_orderkey % 7 < 5 THEN 'Builder' END AS headline,
    CASE o_orderkey % 6 WHEN 0 THEN array(named_struct('title', 'Chef', 'company', concat('customer#', lpad(CAST(o_custkey AS STRING), 9, '0'), ' Group'), 'dates', '2019 - Present'))
      WHEN 1 THEN array(named_struct('title', 'Chef', 'company', concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')), 'dates', '2015 - 2018'))
      WHEN 2 THEN array(named_struct('title', 'Cook', 'company', 'Elsewhere', 'dates', 'current'))
      WHEN 3 THEN CAST(array() AS array<struct<title:string,company:string,dates:string>>) END AS experience FROM {orders}"""
EMPLOYED_SQL = """SELECT id, CASE WHEN told AND id % 5 = 0 THEN 'wrong_person' WHEN told AND id % 2 = 0 THEN 'employed' WHEN told THEN 'departed'
    WHEN id % 7 >= 5 AND id % 6 > 3 THEN 'unknown' WHEN id % 7 = 1 THEN 'employed' WHEN id % 6 = 0 THEN 'employed' WHEN id % 6 = 1 THEN 'departed'
    WHEN id % 6 = 2 THEN 'wrong_person' ELSE 'unknown' END AS employment,
    CASE WHEN told AND id % 5 = 0 THEN 0.85 WHEN told AND id % 2 = 0 THEN 0.9 WHEN told THEN 0.85 WHEN id % 7 >= 5 AND id % 6 > 3 THEN 0.0
    WHEN id % 7 = 1 THEN 0.75 WHEN id % 6 = 0 THEN 0.8 WHEN id % 6 = 1 THEN 0.7 WHEN id % 6 = 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence
    FROM (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS told FROM orders)"""

# Two extractions of the suppliers' rosters: full names, and first names or longer names.
PRIMARY = f"""SELECT CAST(s_nationkey AS BIGINT) AS company_id, s_suppkey AS position, {FIRST.format(k='s_suppkey')} AS f, {LAST.format(k='s_suppkey')} AS l, s_suppkey FROM {{supplier}}"""


def merged_people(b):
    base = b.spark.sql(PRIMARY, supplier=b.raw("supplier"))
    a = base.filter("s_suppkey % 3 <> 0").selectExpr(
        "company_id", "position", "concat(f, ' ', l, ' ', CAST(s_suppkey AS STRING)) AS name", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'CEO' END AS title",
        "concat('https://linkedin.com/in/', s_suppkey) AS profile_url")
    c = base.filter("s_suppkey % 4 <> 0").selectExpr(
        "company_id", "position", "concat('Dr ', f, ' ', l, ' ', CAST(s_suppkey AS STRING)) AS name", "'CTO' AS title", "'' AS profile_url")
    return P.merge_people(a, c)


MERGED_SQL = f"""base AS ({PRIMARY.replace('{supplier}', 'supplier')}),
    a AS (SELECT *, concat(f, ' ', l, ' ', s_suppkey) AS name, lower(concat(f, ' ', l, ' ', s_suppkey)) AS key FROM base WHERE s_suppkey % 3 <> 0),
    c AS (SELECT *, concat('Dr ', f, ' ', l, ' ', s_suppkey) AS name, lower(concat('Dr ', f, ' ', l, ' ', s_suppkey)) AS key FROM base WHERE s_suppkey % 4 <> 0),
    hit AS (SELECT a.company_id, a.position, min(c.position) AS m FROM a JOIN c ON a.company_id = c.company_id AND (contains(a.key, c.key) OR contains(c.key, a.key)) GROUP BY ALL),
    seen AS (SELECT c.company_id, c.key FROM hit JOIN c ON c.company_id = hit.company_id AND c.position = hit.m)"""


def found_profiles(b):
    return P.parse_profiles(search_results(b)).select(
        "company_id", (F.col("id") * 10 + F.col("position")).alias("position"), "name", F.col("person_title").alias("title"), "profile_url")


def stored_profiles(b):
    leaders = b["company_leadership"].select(
        F.col("id") % 50 + 0, "company_id", "person_name", "title", "linkedin_profile_url", "is_current", F.col("discovered_at").alias("last_verified_at"))
    leaders = leaders.select(F.col("company_id"), "person_name", "title", F.concat(F.lit("https://linkedin.com/in/p"), F.col("company_id").cast("string")).alias("linkedin_profile_url"), "is_current", "last_verified_at")
    links = b["social_media_links"].select("company_id", "platform", F.concat(F.lit("https://linkedin.com/in/s"), F.col("company_id").cast("string")).alias("profile_url"))
    return P.store_ceo_profiles(found_profiles(b), leaders, links, CAPTURES_AS_OF)


STORED_SQL = HITS_SQL + r""", clean AS (SELECT company_id, id * 10 + position AS position, name,
      regexp_replace(concat(regexp_extract(profile_url, '^(https?)', 1), '://', regexp_replace(regexp_extract(profile_url, '^https?://([^/?#]*)', 1), '^www\.', ''),
        regexp_replace(regexp_extract(profile_url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')), '^(https?://linkedin\.com/in/[^/]+)/.*$', '\1') AS u FROM parsed),
    held AS (SELECT DISTINCT company_id, concat('https://linkedin.com/in/p', company_id) AS u FROM company_leadership),
    linked AS (SELECT DISTINCT company_id, concat('https://linkedin.com/in/s', company_id) AS u FROM social_media_links)"""

CHECKS = "SELECT id, CAST(company_id AS BIGINT) AS company_id, captured_at, concat('P', CAST(id % 9 AS STRING)) AS person_name, 'CEO' AS title, CASE WHEN id % 4 = 0 THEN 'departed' ELSE 'employed' END AS status, 0.9 AS confidence, 'profile' AS evidence, id % 4 = 0 AS change_detected FROM {snaps}"
CASES = {
    "leadership_mentions": Case(
        lambda b: P.extract_mentions(sentences(b)).select("snapshot_id", "company_id", "person_name", "title_context", "priority"),
        "WITH " + SAID_SQL + " SELECT id AS snapshot_id, company_id, person_name, title_context, priority FROM named"),
    "leadership_mention_snippets": Case(
        lambda b: P.extract_mentions(sentences(b), b["companies"]).select("snapshot_id", "person_name", "snippet"),
        # Thirty letters before and after what names the leader.
        "WITH " + SAID_SQL + """ SELECT m.id AS snapshot_id, person_name, concat(CASE WHEN m.id % 2 = 0 THEN '...ords to lead into the matter. ' ELSE '' END,
            CASE m.id % 8 WHEN 0 THEN 'CEO: ' || n WHEN 1 THEN 'Meet our co-founder & ceo, ' || n WHEN 2 THEN n || ', President' WHEN 3 THEN n || ' (Founder)'
            WHEN 4 THEN n || ' is the chief executive officer' WHEN 5 THEN concat('Founded by ', n, ' and ', o) ELSE 'co-founded by ' || n END,
            ' in a town that is far away fr...') AS snippet FROM named m JOIN said s ON s.id = m.id"""),
    "titles": Case(
        lambda b: b.raw("part").selectExpr("p_partkey", f"{TITLE} AS t").select(
            "p_partkey", T.title_rank("t").alias("rank"), T.is_leadership("t").alias("leads"), T.normalize_title("t").alias("plain"),
            T.classify_role("t").alias("role"), T.extract_title("t").alias("found"), T.departure_type("t").alias("departure"), T.arrival_type("t").alias("arrival")),
        rf"""SELECT p_partkey, CASE k {RANKS} ELSE CASE WHEN regexp_matches(k, '{CHIEF}') THEN 4 WHEN regexp_matches(k, '{VICE}') THEN 5 ELSE 99 END END AS rank,
            regexp_matches(k, '{ANY}') OR regexp_matches(k, '{CHIEF}') OR regexp_matches(k, '{VICE}') AS leads,
            CASE WHEN k IN ({', '.join(repr(t) for t in fixed.TITLE_SHORT_FORMS)}) THEN CASE k {SHORT} END WHEN upper(trim(t)) IN ('CEO', 'CTO') THEN upper(trim(t))
              WHEN k = 'vp of product' THEN 'Vp Of Product' WHEN k = 'managing director' THEN 'Managing Director' WHEN k = 'president' THEN 'President' ELSE trim(t) END AS plain,
            CASE k {ROLES} ELSE CASE WHEN regexp_matches(k, '{CHIEF}') OR regexp_matches(k, '{VICE}') OR k IN ({', '.join(repr(t) for t in fixed.TITLE_RANKS)}) THEN 'other_executive' ELSE 'other' END END AS role,
            CASE p_partkey % 13 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Chief Executive Officer' WHEN 2 THEN 'co-founder' WHEN 3 THEN 'Chief Happiness Officer' WHEN 4 THEN 'VP of Product'
              WHEN 5 THEN 'Vice President' WHEN 7 THEN 'cto' WHEN 8 THEN 'managing director' WHEN 9 THEN 'President' WHEN 10 THEN 'Founder' WHEN 11 THEN 'Cofounder' END AS found,
            CASE WHEN k IN ('ceo', 'chief executive officer') THEN 'ceo_departure' WHEN k IN ('founder', 'co-founder', 'cofounder') THEN 'founder_departure' WHEN k = 'cto' THEN 'cto_departure' ELSE 'executive_departure' END AS departure,
            CASE WHEN k IN ('ceo', 'chief executive officer') THEN 'new_ceo' ELSE 'new_leadership' END AS arrival
            FROM (SELECT p_partkey, {TITLE} AS t, lower(trim({TITLE})) AS k FROM part)"""),
    "parse_profiles": Case(
        lambda b: P.parse_profiles(search_results(b)).select("id", "position", "company_id", "name", "person_title", "profile_url"),
        "WITH " + HITS_SQL + " SELECT id, position, company_id, name, person_title, profile_url FROM parsed"),
    "parse_cards": Case(
        lambda b: P.parse_cards(b.raw("supplier").selectExpr("s_suppkey",
            "concat('<li><a href=\"/', CASE WHEN s_suppkey % 4 = 0 THEN 'company' ELSE 'in' END, '/s', CAST(s_suppkey AS STRING), '\"><div class=\"profile-title\">', s_name, ' </div><div class=\"subtitle\"> CEO</div></a>') AS card_html")).select(
            "s_suppkey", "name", "person_title", "profile_url"),
        "SELECT s_suppkey, s_name AS name, 'CEO' AS person_title, concat('https://www.linkedin.com/in/s', s_suppkey) AS profile_url FROM supplier WHERE s_suppkey % 4 <> 0"),
    "filter_leaders": Case(
        lambda b: P.filter_leaders(found_profiles(b), 2).select("company_id", "position", "profile_url", "rank"),
        "WITH " + HITS_SQL + """, led AS (SELECT company_id, id * 10 + position AS position, profile_url, CASE person_title WHEN 'VP of Product' THEN 5 ELSE 1 END AS rank
            FROM parsed WHERE person_title <> '') SELECT company_id, position, profile_url, rank FROM (SELECT company_id, profile_url, min(position) AS position,
            arg_min(rank, position) AS rank FROM led GROUP BY ALL) WHERE rank <= 2"""),
    "compare_rosters": Case(
        lambda b: roster_changes(b).select("company_id", "linkedin_profile_url", "person_name", "title", "change_type", "severity"),
        with_tables("company_leadership", "SELECT company_id, linkedin_profile_url, person_name, title, change_type, severity FROM chg", ROSTER_SQL)),
    "roster_events": Case(
        lambda b: P.roster_events(*rosters(b), CAPTURES_AS_OF, 0.8, "scan").select("company_id", "linkedin_profile_url", "change_type", "confidence"),
        with_tables("company_leadership", """SELECT company_id, linkedin_profile_url, change_type, 0.8::DOUBLE AS confidence FROM chg
            WHERE company_id IN (SELECT company_id FROM company_leadership WHERE in_previous)""", ROSTER_SQL)),
    "roster_change_summary": Case(
        lambda b: P.roster_change_summary(roster_changes(b)).select(
            "company_id", "classification", "sentiment", "confidence", joined("matched_keywords", "keywords"), "notes"),
        with_tables("company_leadership", """SELECT company_id, 'significant' AS classification, CASE WHEN d AND a THEN 'mixed' WHEN d THEN 'negative' ELSE 'positive' END AS sentiment,
            CASE WHEN c > 0 THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence, keywords,
            CASE WHEN c > 0 THEN concat(c, ' critical leadership change(s) detected') ELSE concat(n, ' notable leadership change(s) detected') END AS notes
            FROM (SELECT company_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'notable') AS n,
              bool_or(ends_with(change_type, '_departure')) AS d, bool_or(starts_with(change_type, 'new_')) AS a,
              string_agg(DISTINCT change_type, '|' ORDER BY change_type) AS keywords
              FROM chg GROUP BY company_id)""", ROSTER_SQL)),
    "roster_change_evidence": Case(
        lambda b: P.roster_change_evidence(roster_changes(b)),
        with_tables("company_leadership", "SELECT company_id, concat(person_name, ' (', title, ') - ', change_type) AS evidence FROM chg", ROSTER_SQL)),
    "apply_departures": Case(
        lambda b: P.apply_departures(b["company_leadership"].withColumn("last_verified_at", F.col("discovered_at")), roster_changes(b), rosters(b)[1], CAPTURES_AS_OF)
        .select("id", "is_current", stamp("last_verified_at")),
        with_tables("company_leadership", f"""SELECT id, CASE WHEN in_previous AND NOT in_current THEN false ELSE is_current END AS is_current,
            {time_sql("CASE WHEN in_current THEN TIMESTAMP '2024-01-31 00:00:00' ELSE discovered_at END", 'last_verified_at')} FROM company_leadership""")),
    "reconcile_rosters": Case(
        lambda b: P.reconcile(b["leadership_mentions"], b["company_leadership"]).select(
            "company_id", "flag", "person_name", "title", F.coalesce("mention_id", F.lit(-1)).alias("mention_id"), F.coalesce("leader_id", F.lit(-1)).alias("leader_id")),
        with_tables("leadership_mentions company_leadership", """SELECT h.company_id, 'matched' AS flag, l.person_name, l.title, mention_id, leader_id FROM hit h JOIN l ON l.id = h.leader_id
            UNION ALL SELECT company_id, 'missing_in_db', person_name, title_context, id, -1 FROM m WHERE id NOT IN (SELECT mention_id FROM hit)
            UNION ALL SELECT company_id, 'missing_on_website', person_name, title, -1, id FROM l WHERE id NOT IN (SELECT leader_id FROM hit)""", MATCHES_SQL)),
    "employment_status": Case(
        lambda b: P.employment_status(b.spark.sql(EMPLOYED, orders=b.raw("orders")), b["companies"]).select("id", "employment", "confidence"),
        EMPLOYED_SQL),
    "merge_people": Case(
        lambda b: merged_people(b).select("company_id", "position", "name", "title", "origin"),
        f"WITH {MERGED_SQL}" + """ SELECT a.company_id, a.position, CASE WHEN length(c.name) > length(a.name) THEN c.name ELSE a.name END AS name,
            CASE WHEN a.s_suppkey % 2 <> 0 THEN 'CEO' WHEN c.name IS NOT NULL THEN 'CTO' ELSE '' END AS title, 'primary' AS origin
            FROM a LEFT JOIN hit h USING (company_id, position) LEFT JOIN c ON c.company_id = h.company_id AND c.position = h.m
            UNION ALL SELECT company_id, position, name, 'CTO', 'secondary' FROM c WHERE (company_id, key) NOT IN (SELECT (company_id, key) FROM seen)
              AND (company_id, key) NOT IN (SELECT (company_id, key) FROM a)"""),
    "best_ceo_name": Case(
        lambda b: P.best_ceo_name(b["leadership_mentions"]).select("company_id", "id", "person_name"),
        with_tables("leadership_mentions", """SELECT company_id, id, person_name FROM leadership_mentions WHERE title_context IN ('CEO', 'Founder')
            QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY priority, confidence DESC, id) = 1""")),
    "store_ceo_profiles": Case(
        lambda b: stored_profiles(b)[2],
        with_tables("company_leadership social_media_links", """SELECT c.company_id, count(*) AS profiles,
            count(DISTINCT c.u) FILTER (h.u IS NULL) AS profiles_found, count(*) FILTER (h.u IS NOT NULL) AS reverified,
            count(DISTINCT c.u) FILTER (k.u IS NULL) AS links_added, count(*) - count(DISTINCT c.u) FILTER (k.u IS NULL) AS already_existed
            FROM clean c LEFT JOIN held h ON h.company_id = c.company_id AND h.u = c.u LEFT JOIN linked k ON k.company_id = c.company_id AND k.u = c.u
            GROUP BY c.company_id""", STORED_SQL)),
    "leadership_digest": Case(
        lambda b: P.leadership_digest(
            b["company_leadership"].withColumn("last_verified_at", F.lit(None).cast("timestamp_ntz")).withColumn("discovery_method", F.lit("scan")),
            b.spark.sql(CHECKS, snaps=b["linkedin_snapshots"])),
        with_tables("company_leadership linkedin_snapshots", """SELECT company_id, 'leader' AS section, id, NULL::BOOLEAN AS changed,
            concat(person_name, ' (', title, ') [verified: never, method: scan]') AS line FROM company_leadership WHERE is_current
            UNION ALL SELECT company_id, 'check', id, id % 4 = 0, concat('P', id % 9, ' (CEO): ', CASE WHEN id % 4 = 0 THEN 'departed' ELSE 'employed' END,
              ' [confidence: 0.90] profile') FROM linkedin_snapshots""")),
    "leaders_with_company": Case(
        lambda b: with_company(b["company_leadership"], b["companies"]).select("id", "company_id", "company_name"),
        with_tables("company_leadership companies", "SELECT l.id, company_id, c.name AS company_name FROM company_leadership l JOIN companies c ON c.id = company_id")),
}
