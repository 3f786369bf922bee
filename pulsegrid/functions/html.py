"""Links and tags in HTML by regular expression (native, inside the row).

Comments and script bodies are removed first. Badly broken markup is read as it stands, not
repaired as a browser would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, col, empty_strings, let, strip
from .urls import url_host, url_scheme

INSIDE_TAG = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"


def visible_markup(html: ColumnOrName) -> Column:
    """HTML without comments, scripts and styles."""
    bare = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")


def tags(markup: Column, names: str) -> Column:
    """Opening tags with one of ``names`` (a regex alternation)."""
    return F.regexp_extract_all(markup, F.lit(rf"(?i)<(?:{names})(?=[\s/>]){INSIDE_TAG}>"), 0)


def unescape(c: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                         ("&#38;", "&"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, NULL when the tag has none of that name."""
    head = rf"(?i)[\s\"'/]{name}\s*=\s*"
    quoted = F.regexp_extract(tag, head + "([\"'])(.*?)\\1", 2)
    bare = F.regexp_extract(tag, head + r"([^\s\"'>]+)", 1)
    has_quotes = tag.rlike(head + "([\"']).*?\\1")
    return F.when(has_quotes, unescape(quoted)).when(tag.rlike(head), unescape(bare))


def is_http(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def links_from_markdown(markdown: ColumnOrName) -> Column:
    """Targets of ``[text](url "title")`` links, then bare URLs not among them."""
    text = F.coalesce(col(markdown), F.lit(""))
    raw = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1)
    targets = F.filter(
        F.transform(raw, lambda u: strip(F.get(F.split(strip(u), "\\s+[\"']", 2), F.lit(0)))), is_http)
    bare = F.regexp_extract_all(text, F.lit("https?://[^\\s<>\"'\\)]+"), 0)
    return let(targets, lambda t: F.concat(t, F.array_except(bare, t)))


def resolve(href: Column, base: Column) -> Column:
    """A root-relative link on its page's site; absolute links stay, others are NULL."""
    return (
        F.when(is_http(href), href)
        .when(href.startswith("//"), F.concat(url_scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(url_scheme(base), F.lit("://"), url_host(base), href))
    )


def links_from_html(html: ColumnOrName, base_url: ColumnOrName) -> Column:
    """Targets of ``<a href>``: absolute ones, and ``/path`` ones on the page's site."""
    base = col(base_url)
    anchors = tags(visible_markup(html), "a")
    hrefs = F.transform(anchors, lambda t: resolve(strip(attribute(t, "href")), base))
    return F.array_compact(hrefs)


def schema_org_links(html: ColumnOrName, recursive: bool = False) -> Column:
    """``sameAs`` URLs of JSON-LD blocks, at the top level or at any depth."""
    block = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
    blocks = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(block), 1)

    def urls(value: Column) -> Column:
        # A JSON list arrives as its text.
        many = F.from_json(value, "array<string>")
        return F.when(value.startswith("["), F.coalesce(many, empty_strings())).otherwise(F.array(value))

    def of_block(b: Column) -> Column:
        if recursive:
            found = F.regexp_extract_all(
                b, F.lit(r'(?<!\\)"sameAs"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\])'), 1)
            values = F.flatten(F.transform(found, lambda v: F.coalesce(F.from_json(
                F.when(v.startswith("["), v).otherwise(F.concat(F.lit("["), v, F.lit("]"))), "array<string>"),
                empty_strings())))
            return F.when(F.try_parse_json(b).isNotNull(), values).otherwise(empty_strings())
        items = F.from_json(b, "array<struct<sameAs:string>>")
        named = F.filter(F.transform(items, lambda i: i["sameAs"]), lambda v: v.isNotNull())
        return F.coalesce(F.flatten(F.transform(named, urls)), empty_strings())

    return F.filter(F.flatten(F.transform(blocks, of_block)), is_http)


def meta_links(html: ColumnOrName) -> Column:
    """URLs (and @handles, as profile URLs) of ``twitter:*`` and ``og:*`` meta tags."""

    def of_tags(metas: Column) -> Column:
        def contents(attr: str, word: str) -> Column:
            wanted = F.filter(metas, lambda t: F.coalesce(attribute(t, attr).rlike(f"(?i){word}"), F.lit(False)))
            return F.transform(wanted, lambda t: F.coalesce(attribute(t, "content"), F.lit("")))

        cards = F.transform(contents("name", "twitter:"), lambda c: F.when(is_http(c), c).when(
            c.startswith("@"), F.concat(F.lit("https://twitter.com/"), F.regexp_replace(c, "^@+", ""))))
        graph = F.filter(contents("property", "og:"), is_http)
        return F.concat(F.array_compact(cards), graph)

    return let(tags(visible_markup(html), "meta"), of_tags)


def labelled_links(html: ColumnOrName) -> Column:
    """Absolute links whose aria-label, or title, names a platform."""
    words = "|".join(fixed.LABEL_WORDS)

    def of_tags(found: Column) -> Column:
        def by(attr: str) -> Column:
            named = F.filter(found, lambda t: F.coalesce(
                F.lower(attribute(t, attr)).rlike(words), F.lit(False)))
            return F.filter(F.transform(named, lambda t: F.coalesce(attribute(t, "href"), F.lit(""))), is_http)

        return F.concat(by("aria-label"), by("title"))

    return let(tags(visible_markup(html), "a|link"), of_tags)


def social_urls_in_text(html: ColumnOrName) -> Column:
    """URLs on the known social hosts anywhere in the raw text, by host."""
    text = F.coalesce(col(html), F.lit(""))
    hosts = F.array(*[F.lit(h) for h in fixed.SOCIAL_HOSTS])
    found = F.flatten(F.transform(hosts, lambda h: F.regexp_extract_all(
        text, F.concat(F.lit("(?i)https?://(?:www\\.)?\\Q"), h, F.lit("\\E/[^\\s\"'<>]+")), F.lit(0))))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[\")>;,.]+$", "")))


TWEET = r"(?i)https?://(?:www\.)?(twitter|x)\.com/[^/]+/status/"
TWITTER = r"(?i)^https?://(?:www\.)?(twitter|x)\.com/"


def drop_tweet_embeds(urls: ColumnOrName, trusted: ColumnOrName) -> Column:
    """A page's URLs without embedded tweets. If there is one, Twitter profiles count only
    when a structured source names them."""
    urls, trusted = col(urls), col(trusted)
    cleaned = F.filter(urls, lambda u: ~u.rlike(TWEET) & (~u.rlike(TWITTER) | F.array_contains(trusted, u)))
    return F.when(F.exists(urls, lambda u: u.rlike(TWEET)), cleaned).otherwise(urls)
