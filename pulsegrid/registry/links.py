"""Link discovery, URL functions, logos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markup as M
from ..functions import urls as U
from ..functions.text import hash_similarity
from ..operators import links as L
from ..operators import timelines as G
from ..operators.logos import branding_logo, logo_classes, similar_logos
from ..operators.page_logos import page_logos
from ..sources.testbed import CAPTURES_AS_OF
from .case import Case, joined, with_tables

SCHEME = r"lower(regexp_extract({0}, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1))"
HOST = r"lower(regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1))"
PATH = r"regexp_extract({0}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def scheme(c: str) -> str:
    return SCHEME.format(c)


def host(c: str) -> str:
    return HOST.format(c)


def path(c: str) -> str:
    return PATH.format(c)


def domain(c: str) -> str:
    return rf"regexp_replace({host(c)}, '^www\.', '')"


def parts(c: str) -> str:
    return f"list_filter(string_split({path(c)}, '/'), lambda p: p <> '')"


def profile(c: str) -> str:
    plain = rf"concat({scheme(c)}, '://', {domain(c)}, regexp_replace({path(c)}, '/+$', ''))"
    for level in (r"github\.com/[^/]+", r"linkedin\.com/(?:company|in)/[^/]+", r"youtube\.com/(?:@|channel/|c/)[^/]+"):
        plain = rf"regexp_replace({plain}, '(?i)^(https?://{level})/.*$', '\1')"
    return plain


def platform(c: str) -> str:
    from .. import fixed

    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" for n, p in fixed.PLATFORM_PATTERNS) + " END"


def blog(c: str) -> str:
    from .. import fixed

    cases = [f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" for n, p in fixed.BLOG_HOST_PATTERNS]
    cases += [f"WHEN starts_with({host(c)}, '{s}') THEN 'company_blog'" for s in fixed.BLOG_SUBDOMAINS]
    cases += [f"WHEN starts_with(lower({path(c)}), '{s}') THEN 'company_blog'" for s in fixed.BLOG_PATHS]
    return "CASE " + " ".join(cases) + " END"


def blog_home(c: str) -> str:
    from .. import fixed

    site = f"concat({scheme(c)}, '://', {host(c)})"
    own = " OR ".join([f"starts_with({host(c)}, '{s}')" for s in fixed.BLOG_SUBDOMAINS]
                      + [f"contains({host(c)}, '{s}')" for s in (".substack.com", ".medium.com", ".ghost.io")])
    cases = [f"WHEN {own} THEN {site}",
             f"WHEN contains({host(c)}, 'medium.com') AND starts_with({parts(c)}[1], '@') THEN concat({site}, '/', {parts(c)}[1])"]
    cases += [f"WHEN starts_with(lower({path(c)}), '{s}') THEN concat({site}, '{s}')" for s in fixed.BLOG_PATHS]
    return "CASE " + " ".join(cases) + f" ELSE {c} END"


HANDLE = f"""CASE WHEN len(pp) = 0 THEN NULL WHEN kind IN ('linkedin', 'bluesky') THEN pp[2]
    WHEN kind IN ('twitter', 'github', 'instagram', 'facebook', 'pinterest') THEN pp[1]
    WHEN kind = 'youtube' THEN CASE WHEN starts_with(pp[1], '@') THEN pp[1] ELSE pp[2] END
    WHEN kind IN ('tiktok', 'threads', 'medium') THEN CASE WHEN starts_with(pp[1], '@') THEN pp[1] END
    WHEN kind = 'mastodon' THEN list_filter(pp, lambda p: starts_with(p, '@'))[1] END"""
URL_HANDLE = f"""CASE WHEN len(pp) = 0 THEN NULL WHEN contains(h, 'linkedin.com') AND len(pp) >= 2 AND pp[1] IN ('company', 'in') THEN pp[2]
    WHEN contains(h, 'twitter.com') OR contains(h, 'x.com') THEN ltrim(pp[1], '@')
    WHEN contains(h, 'youtube.com') AND starts_with(pp[1], '@') THEN ltrim(pp[1], '@')
    WHEN contains(h, 'youtube.com') AND len(pp) >= 2 AND pp[1] IN ('c', 'channel', 'user') THEN pp[2]
    WHEN regexp_matches(h, 'github.com|instagram.com|facebook.com') THEN pp[1]
    WHEN regexp_matches(h, 'tiktok.com|medium.com|threads.net') AND starts_with(pp[1], '@') THEN ltrim(pp[1], '@')
    WHEN contains(h, 'bsky.app') AND len(pp) >= 2 AND pp[1] = 'profile' THEN pp[2]
    WHEN contains(h, 'mastodon') THEN ltrim(list_filter(pp, lambda p: starts_with(p, '@'))[1], '@') ELSE pp[1] END"""
UTILITY = """CASE WHEN len(pp) = 0 THEN true WHEN kind IN ('tiktok', 'threads', 'mastodon', 'medium') THEN NOT starts_with(pp[1], '@')
    WHEN kind = 'youtube' THEN lower(pp[1]) NOT IN ('c', 'channel', 'user') AND NOT starts_with(pp[1], '@')
    WHEN kind = 'linkedin' THEN lower(pp[1]) NOT IN ('company', 'in') WHEN kind = 'bluesky' THEN lower(pp[1]) <> 'profile'
    WHEN kind = 'github' THEN lower(pp[1]) IN ('login', 'signup', 'explore', 'marketplace', 'settings', 'trending', 'topics')
    WHEN kind = 'facebook' THEN lower(pp[1]) IN ('login', 'signup', 'help', 'marketplace', 'watch', 'gaming', 'groups')
    ELSE false END"""

SQ = "''"
MARKUP = rf"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g')"""
ANCHORS = rf"""regexp_extract_all(mk, '(?i)<a\s[^>]*>')"""
HREF = r"""(?i)[\s"'']href\s*=\s*"([^"]*)\""""
# What page discovery finds, in order: markdown, anchors, structured data, meta tags, labels.
FOUND_SQL = rf"""pg AS (SELECT *, {MARKUP} AS mk, {scheme('url')} || '://' || {host('url')} AS site FROM linked_pages),
    md AS (SELECT *, list_transform(regexp_extract_all(markdown, '\[[^\]]*\]\(([^)]+)\)', 1), lambda u: split_part(u, ' ', 1)) AS t FROM pg),
    got AS (SELECT page_id, company_id, url,
      list_concat(t, list_filter(regexp_extract_all(markdown, 'https?://[^\s<>"''\)]+'), lambda u: NOT list_contains(t, u))) AS md_links,
      list_filter(list_transform(list_transform({ANCHORS}, lambda a: regexp_extract(a, '{HREF}', 1)),
        lambda h: CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN site || h END), lambda h: h IS NOT NULL) AS a_links,
      list_filter(list_transform(regexp_extract_all(regexp_extract(html, '"sameAs": \[([^\]]*)\]', 1), '"([^"]*)"', 1), lambda u: u), lambda u: starts_with(u, 'http')) AS org_links,
      list_concat(list_transform(regexp_extract_all(mk, 'name="twitter:site" content="@([^"]*)"', 1), lambda h: 'https://twitter.com/' || h),
        regexp_extract_all(mk, 'property="og:url" content="([^"]*)"', 1)) AS meta_links,
      regexp_extract_all(mk, 'aria-label="Our YouTube" href="([^"]*)"', 1) AS label_links FROM md)"""
LINKS_SQL = FOUND_SQL + r""", trusted AS (SELECT *, list_concat(list_concat(org_links, meta_links), label_links) AS tr FROM got),
    every AS (SELECT page_id, company_id, tr, u, min(i) AS i FROM (SELECT page_id, company_id, tr, unnest(al) AS u, generate_subscripts(al, 1) AS i
      FROM (SELECT *, list_concat(list_concat(md_links, a_links), tr) AS al FROM trusted)) GROUP BY ALL),
    embeds AS (SELECT DISTINCT page_id FROM every WHERE regexp_matches(u, '(?i)https?://(?:www\.)?(twitter|x)\.com/[^/]+/status/')),
    kept AS (SELECT * FROM every WHERE page_id NOT IN (SELECT page_id FROM embeds)
      OR (NOT regexp_matches(u, '(?i)https?://(?:www\.)?(twitter|x)\.com/[^/]+/status/')
        AND (NOT regexp_matches(u, '(?i)^https?://(?:www\.)?(twitter|x)\.com/') OR list_contains(tr, u))))"""
DISCOVERED_SQL = LINKS_SQL + f""", kinds AS (SELECT *, {blog('u')} AS bt, {platform('u')} AS pf FROM kept),
    social AS (SELECT company_id, pf AS platform, {profile('u')} AS profile_url, page_id, i FROM kinds WHERE bt IS NULL AND pf IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY company_id, {profile('u')} ORDER BY page_id, i) = 1),
    blogs AS (SELECT company_id, bt AS blog_type, {blog_home('u')} AS blog_url, page_id, i FROM kinds WHERE bt IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY company_id, {blog_home('u')} ORDER BY page_id, i) = 1)"""


def discovered(b):
    return L.discover_links(b["linked_pages"], CAPTURES_AS_OF, markdown="markdown")


def links_of(b, column):
    return b["linked_pages"].select("page_id", joined(column, "links"))


def found(column: str) -> str:
    return with_tables("linked_pages", f"SELECT page_id, array_to_string({column}, '|') AS links FROM got", FOUND_SQL)


def url_facts(b):
    u = F.col("profile_url")
    kind = U.detect_platform(u)
    return b["social_media_links"].select(
        "id", kind.alias("kind"), U.normalize_profile(u).alias("canonical"), U.account_handle(u, kind).alias("handle"),
        U.url_handle(u).alias("plain_handle"), U.is_utility_path(u, kind).alias("utility"))


MERGE_SQL = """keyed AS (SELECT *, regexp_replace(lower(profile_url), '/+$', '') AS key, id % 3 = 0 AS is_new FROM social_media_links)"""

CASES = {
    "url_parts": Case(
        lambda b: b.raw("pages").select(
            "page_id", U.url_host("url").alias("host"), U.url_domain("url").alias("domain"), U.base_domain("url").alias("base"),
            U.normalize_url("url").alias("plain"), joined(U.url_path_parts("url"), "parts"), U.is_valid_url("url").alias("valid"),
            U.is_subdomain_of("url", F.lit("Example.com")).alias("under_example"),
            U.is_same_domain("url", F.lit("http://a.b.example.net/x")).alias("same_as_net")),
        rf"""SELECT page_id, {host('url')} AS host, {domain('url')} AS domain,
            array_to_string(string_split({domain('url')}, '.')[-2:], '.') AS base,
            concat({scheme('lower(url)')}, '://', {domain('lower(url)')}, regexp_replace({path('lower(url)')}, '/+$', '')) AS plain,
            array_to_string({parts('url')}, '|') AS parts, {scheme('url')} IN ('http', 'https') AND {host('url')} <> '' AS valid,
            ends_with({host('url')}, '.example.com') OR {host('url')} = 'example.com' AS under_example,
            ends_with({domain('url')}, '.example.net') OR {domain('url')} = 'example.net' AS same_as_net FROM pages"""),
    "group_by_domain": Case(
        lambda b: L.group_by_domain(b.raw("pages")),
        rf"SELECT array_to_string(string_split({domain('url')}, '.')[-2:], '.') AS domain, count(*) AS urls FROM pages GROUP BY 1"),
    "profile_urls": Case(
        url_facts,
        with_tables("social_media_links", f"""SELECT id, kind, canonical, {HANDLE} AS handle, {URL_HANDLE} AS plain_handle, {UTILITY} AS utility
            FROM (SELECT id, {platform('profile_url')} AS kind, {profile('profile_url')} AS canonical, {parts('profile_url')} AS pp,
            {host('profile_url')} AS h FROM social_media_links)""")),
    "blog_urls": Case(
        lambda b: b["blog_links"].select("id", U.detect_blog("blog_url").alias("type"), U.normalize_blog("blog_url").alias("home")),
        with_tables("blog_links", f"SELECT id, {blog('blog_url')} AS type, {blog_home('blog_url')} AS home FROM blog_links")),
    "youtube_videos": Case(
        lambda b: b["social_media_links"].select("id", U.youtube_video_id("profile_url").alias("video"),
                                                 U.is_youtube_watch("profile_url").alias("watch"), U.is_youtube_embed("profile_url").alias("embed")),
        with_tables("social_media_links", r"""SELECT id, nullif(regexp_extract(profile_url, '(?i)youtube\.com/watch\?v=([a-zA-Z0-9_-]+)', 1), '') AS video,
            contains(profile_url, 'youtube.com/watch?v=') AS watch, false AS embed FROM social_media_links""")),
    "markdown_links": Case(lambda b: links_of(b, H.links_from_markdown("markdown")), found("md_links")),
    "html_links": Case(lambda b: links_of(b, H.links_from_html("html", "url")), found("a_links")),
    "schema_org_links": Case(lambda b: links_of(b, H.schema_org_links("html")), found("org_links")),
    "schema_org_links_any_depth": Case(lambda b: links_of(b, H.schema_org_links("html", recursive=True)), found("org_links")),
    "meta_links": Case(lambda b: links_of(b, H.meta_links("html")), found("meta_links")),
    "labelled_links": Case(lambda b: links_of(b, H.labelled_links("html")), found("label_links")),
    "social_urls_in_text": Case(
        lambda b: b["linked_pages"].select("page_id", joined(F.array_sort(H.social_urls_in_text("html")), "links")),
        with_tables("linked_pages", r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html,
            '(?i)https?://(?:www\.)?(?:linkedin\.com|twitter\.com|x\.com|youtube\.com|github\.com)/[^\s"''<>]+'),
            lambda u: regexp_replace(u, '[")>;,.]+$', '')))), '|') AS links FROM linked_pages""")),
    "page_links_without_embeds": Case(
        lambda b: L.page_links(b["linked_pages"], markdown="markdown").select("page_id", F.explode("links").alias("link")),
        with_tables("linked_pages", "SELECT page_id, u AS link FROM kept", LINKS_SQL)),
    "discovered_profiles": Case(
        lambda b: discovered(b)[0].select("company_id", "platform", "profile_url", "page_id"),
        with_tables("linked_pages", "SELECT company_id, platform, profile_url, page_id FROM social", DISCOVERED_SQL)),
    "discovered_blogs": Case(
        lambda b: discovered(b)[1].select("company_id", "blog_type", "blog_url", "page_id"),
        with_tables("linked_pages", "SELECT company_id, blog_type, blog_url, page_id FROM blogs", DISCOVERED_SQL)),
    "discovery_stats": Case(
        lambda b: L.discovery_stats(b["companies"], *discovered(b)),
        with_tables("linked_pages companies", """SELECT id AS company_id, (SELECT count(*) FROM social s WHERE s.company_id = c.id) AS links,
            (SELECT count(*) FROM blogs s WHERE s.company_id = c.id) AS blogs FROM companies c""", DISCOVERED_SQL)),
    "platform_totals": Case(
        lambda b: L.platform_totals(discovered(b)[0]),
        with_tables("linked_pages", """SELECT platform, count(*) AS links, count(DISTINCT company_id) AS companies FROM social GROUP BY platform""", DISCOVERED_SQL)),
    "classify_accounts": Case(
        lambda b: L.classify_accounts(b["social_media_links"], b["companies"].withColumn(
            "name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("C"), F.col("id").cast("string"))).otherwise(F.col("name")))).select(
            "id", "account_type", F.round("account_confidence", 6).alias("account_confidence")),
        with_tables("social_media_links companies", f"""SELECT id, CASE WHEN s >= 0.6 THEN 'company' WHEN s <= 0.2 THEN 'personal' ELSE 'unknown' END AS account_type,
            round(CASE WHEN s <= 0.2 THEN 1 - s ELSE s END, 6)::DOUBLE AS account_confidence FROM (SELECT l.id, least(1.0,
              CASE WHEN coalesce(hc, '') <> '' AND (contains(hc, cc) OR contains(cc, hc)) THEN 0.4 ELSE 0 END
              + CASE WHEN html_location IN ('footer', 'header', 'nav') THEN 0.3 WHEN html_location = 'main' THEN 0.1 ELSE 0 END
              + CASE WHEN logo_similarity > 0.85 THEN 0.3 ELSE 0 END)::DOUBLE AS s
            FROM (SELECT *, regexp_replace(trim(lower({URL_HANDLE}), '@'), '[-_]', '', 'g') AS hc FROM
              (SELECT *, {parts('profile_url')} AS pp, {host('profile_url')} AS h FROM social_media_links)) l
            JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN concat('c', id) ELSE lower(name) END AS cc FROM companies) c ON c.id = l.company_id)""")),
    "company_links": Case(
        lambda b: L.company_links(b["social_media_links"], b["blog_links"], 7),
        with_tables("social_media_links blog_links", """SELECT 'social' AS kind, platform AS type, profile_url AS link FROM social_media_links WHERE company_id = 7
            UNION ALL SELECT 'blog', blog_type, blog_url FROM blog_links WHERE company_id = 7""")),
    "links_by_platform": Case(
        lambda b: L.links_by_platform(b["social_media_links"], "medium").select("id", "profile_url"),
        with_tables("social_media_links", "SELECT id, profile_url FROM social_media_links WHERE platform = 'medium'")),
    "active_blogs": Case(
        lambda b: L.active_blogs(b["blog_links"]).select("id", "blog_url"),
        with_tables("blog_links", "SELECT id, blog_url FROM blog_links WHERE is_active")),
    "latest_logo": Case(
        lambda b: L.latest_logo(b["company_logos"]).select("company_id", "id", "perceptual_hash"),
        with_tables("company_logos", """SELECT company_id, id, perceptual_hash FROM company_logos
            QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY extracted_at DESC, id DESC) = 1""")),
    "merge_links": Case(
        lambda b: G.merge_links(b["social_media_links"].filter("id % 3 <> 0"), b["social_media_links"].filter("id % 3 = 0")).select("id", "company_id", "profile_url"),
        with_tables("social_media_links", """SELECT id, company_id, profile_url FROM keyed QUALIFY row_number() OVER
            (PARTITION BY company_id, key ORDER BY coalesce(similarity_score, 0) DESC, is_new, id) = 1""", MERGE_SQL)),
    "dedupe_links": Case(
        lambda b: G.dedupe_links(b["social_media_links"]).select("id", "company_id", "profile_url"),
        with_tables("social_media_links", """SELECT id, company_id, profile_url FROM keyed QUALIFY row_number() OVER
            (PARTITION BY company_id, key ORDER BY coalesce(similarity_score, 0) DESC, id) = 1""", MERGE_SQL)),
    "dedupe_blogs": Case(
        lambda b: G.dedupe_links(b["blog_links"], "blog_url").select("id", "company_id"),
        with_tables("blog_links", """SELECT id, company_id FROM blog_links QUALIFY row_number() OVER
            (PARTITION BY company_id, regexp_replace(lower(blog_url), '/+$', '') ORDER BY id) = 1""")),
    "aggregate_pages": Case(
        lambda b: G.aggregate_pages(b["linked_pages"].select("company_id", "page_id", F.posexplode(
            H.links_from_html("html", "url")).alias("position", "profile_url"))).select("company_id", "profile_url", "page_id"),
        with_tables("linked_pages", """SELECT company_id, u AS profile_url, page_id FROM (SELECT company_id, page_id, unnest(a_links) AS u,
            generate_subscripts(a_links, 1) AS i FROM got) WHERE u <> '' QUALIFY row_number() OVER
            (PARTITION BY company_id, regexp_replace(lower(u), '/+$', '') ORDER BY page_id, i) = 1""", FOUND_SQL)),
    "similar_logos": Case(
        lambda b: similar_logos(b["company_logos"], b["company_logos"]).filter("hash_a < hash_b"),
        with_tables("company_logos", """SELECT a.company_id, a.h AS hash_a, b.h AS hash_b, 1 - bit_count(xor(a.v, b.v)) / 64.0::DOUBLE AS similarity,
            a.n AS logos_a, b.n AS logos_b FROM hs a JOIN hs b ON a.company_id = b.company_id AND a.h < b.h AND 1 - bit_count(xor(a.v, b.v)) / 64.0 >= 0.85""",
            """hs AS (SELECT company_id, perceptual_hash AS h, CAST('0x' || perceptual_hash AS UBIGINT) AS v, count(*) AS n
            FROM company_logos GROUP BY ALL)""")),
    "logo_classes": Case(
        lambda b: logo_classes(b["company_logos"]),
        with_tables("company_logos", """SELECT h.h AS perceptual_hash, coalesce(r.root, h.h) AS class, h.logos, h.companies FROM hs h LEFT JOIN roots r ON r.a = h.h""",
            # Ten runs of bits, the commonest hash under each value, links to it, and what they reach.
            """hs AS (SELECT perceptual_hash AS h, CAST('0x' || perceptual_hash AS UBIGINT) AS v, count(*) AS logos, count(DISTINCT company_id) AS companies
            FROM company_logos GROUP BY ALL),
            edges AS (SELECT i AS run, CAST(round_even(i * 6.4, 0) AS INT) AS low, CAST(round_even((i + 1) * 6.4, 0) AS INT) AS high FROM range(10) t(i)),
            runs AS (SELECT h, v, logos, run, (v >> low) % (1::UBIGINT << (high - low)) AS k FROM hs, edges),
            stands AS (SELECT run, k, arg_min(h, (-logos, h)) AS s, arg_min(v, (-logos, h)) AS sv FROM runs GROUP BY run, k),
            linked AS (SELECT DISTINCT h, s FROM runs JOIN stands USING (run, k) WHERE h <> s AND bit_count(xor(v, sv)) <= 9),
            both_ways AS (SELECT h AS a, s AS b FROM linked UNION SELECT s, h FROM linked),
            roots AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)
              SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)""")),
    "hash_similarity": Case(
        lambda b: b["company_logos"].select("id", hash_similarity("perceptual_hash", F.lit("8000ffff0000f0f1")).alias("similarity")),
        with_tables("company_logos", """SELECT id, 1 - bit_count(xor(CAST('0x' || perceptual_hash AS UBIGINT), CAST('0x8000ffff0000f0f1' AS UBIGINT))) / 64.0::DOUBLE
            AS similarity FROM company_logos""")),
    "link_regions": Case(
        lambda b: b["linked_pages"].select("page_id", F.inline(M.link_regions("html"))).groupBy("page_id", "href", "region").agg(F.count("*").alias("links")),
        # The mapped pages have links in their navigation and in two footers.
        with_tables("linked_pages", rf"""SELECT page_id, href, region, count(*) AS links FROM (
            SELECT page_id, 'nav' AS region, unnest(regexp_extract_all(regexp_extract(m, '(?s)<nav>(.*?)</nav>', 1), '<a\b[^>]*?href="([^"]*)"', 1)) AS href FROM bare
            UNION ALL SELECT page_id, 'footer', unnest(regexp_extract_all(array_to_string(regexp_extract_all(m, '(?s)<footer[^>]*>(.*?)</footer>', 1), ' '),
              '<a\b[^>]*?href="([^"]*)"', 1)) FROM bare) GROUP BY ALL""", f"bare AS (SELECT page_id, {MARKUP} AS m FROM linked_pages)")),
    "branding_logo": Case(
        lambda b: b["linked_pages"].selectExpr(
            "page_id", "named_struct('logo', CASE WHEN page_id % 3 = 0 THEN concat('https://cdn.example.com/', page_id, '.png') WHEN page_id % 3 = 1 THEN 'https://x.com/yc-logo.svg' END, "
            "'images', map('og_image', concat('https://cdn.example.com/og', page_id, '.png'), 'favicon', 'https://cdn.example.com/f.ico', 'logo', CASE WHEN page_id % 4 = 0 THEN ' ' ELSE concat('https://cdn.example.com/wix-public/', page_id) END)) AS branding"
        ).select("page_id", branding_logo().alias("logo")),
        with_tables("linked_pages", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://cdn.example.com/', page_id, '.png')
            ELSE concat('https://cdn.example.com/og', page_id, '.png') END AS logo FROM linked_pages""")),
    "page_logos": Case(
        lambda b: page_logos(b["logo_pages"]),
        # What each arrangement was made to show.
        with_tables("logo_pages", """SELECT page_id, CASE kind WHEN 0 THEN concat('/p', page_id, '.png') WHEN 1 THEN concat('/h', page_id, '.png')
            WHEN 2 THEN concat('/n', page_id, '.png') WHEN 3 THEN concat('/b', page_id, '.png') WHEN 4 THEN '/touch.png' WHEN 5 THEN '/og.png'
            WHEN 6 THEN concat('/f', page_id, '.png') WHEN 7 THEN '/s.ico' ELSE '/glued.png' END AS source_url,
            CASE kind WHEN 0 THEN 'jsonld' WHEN 1 THEN 'header' WHEN 2 THEN 'header' WHEN 4 THEN 'favicon' WHEN 5 THEN 'og_image' WHEN 7 THEN 'favicon' ELSE 'body' END
            AS extraction_location FROM logo_pages WHERE kind < 9""")),
}
