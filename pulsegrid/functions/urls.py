"""Scalar functions on URLs: parts, platforms, blogs, handles, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, col, first_match, strip

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_scheme(url: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME, 1))


def url_host(url: ColumnOrName) -> Column:
    """Lower-case authority (a port stays), empty when there is none."""
    return F.lower(F.regexp_extract(col(url), AUTHORITY, 1))


def url_path(url: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_extract(col(url), PATH, 1), r";[^/]*$", "")


def strip_www(host: ColumnOrName) -> Column:
    return F.regexp_replace(col(host), r"^www\.", "")


def url_domain(url: ColumnOrName) -> Column:
    return strip_www(url_host(url))


def url_path_parts(url: ColumnOrName) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda p: p != "")


def base_domain(url: ColumnOrName) -> Column:
    """The last two labels of the host."""
    return F.substring_index(url_domain(url), ".", -2)


def is_same_domain(a: ColumnOrName, b: ColumnOrName) -> Column:
    return base_domain(a) == base_domain(b)


def is_subdomain_of(url: ColumnOrName, domain: ColumnOrName) -> Column:
    host, base = url_host(url), F.lower(col(domain))
    return F.endswith(host, F.concat(F.lit("."), base)) | (host == base)


def normalize_url(url: ColumnOrName) -> Column:
    """Lower case without ``www.``, query, fragment and closing slashes."""
    low = F.lower(strip(url))
    path = F.regexp_replace(url_path(low), r"/+$", "")
    return F.concat(url_scheme(low), F.lit("://"), url_domain(low), path)


def is_valid_url(url: ColumnOrName) -> Column:
    ok = url_scheme(url).isin("http", "https") & (url_host(url) != "")
    return F.coalesce(ok, F.lit(False))


def link_key(url: ColumnOrName) -> Column:
    """What makes two stored links the same: lower case, closing slashes off."""
    return F.regexp_replace(F.lower(F.coalesce(col(url), F.lit(""))), r"/+$", "")


def detect_platform(url: ColumnOrName, patterns=fixed.PLATFORM_PATTERNS) -> Column:
    return first_match([(col(url).rlike("(?i)" + p), name) for name, p in patterns])


def detect_blog(url: ColumnOrName) -> Column:
    """Blog type by host pattern, then subdomain, then path; NULL when not a blog."""
    url = col(url)
    host, path = url_host(url), F.lower(url_path(url))
    cases = [(url.rlike("(?i)" + p), kind) for kind, p in fixed.BLOG_HOST_PATTERNS]
    cases += [(host.startswith(s), "company_blog") for s in fixed.BLOG_SUBDOMAINS]
    cases += [(path.startswith(p), "company_blog") for p in fixed.BLOG_PATHS]
    return first_match(cases)


def normalize_blog(url: ColumnOrName) -> Column:
    """A blog URL reduced to the blog's front page."""
    url = col(url)
    host, path = url_host(url), F.lower(url_path(url))
    site = F.concat(url_scheme(url), F.lit("://"), host)
    author = F.get(url_path_parts(url), F.lit(0))
    own_host = F.lit(False)
    for s in fixed.BLOG_SUBDOMAINS:
        own_host = own_host | host.startswith(s)
    for s in (".substack.com", ".medium.com", ".ghost.io"):
        own_host = own_host | host.contains(s)
    cases = [
        (own_host, site),
        (host.contains("medium.com") & author.startswith("@"), F.concat(site, F.lit("/"), author)),
    ]
    cases += [(path.startswith(p), F.concat(site, F.lit(p))) for p in fixed.BLOG_PATHS]
    return first_match(cases, url)


def normalize_profile(url: ColumnOrName) -> Column:
    """A profile URL in canonical form, cut to organisation, person or channel level."""
    url = strip(url)
    scheme = F.coalesce(F.nullif(url_scheme(url), F.lit("")), F.lit("https"))
    path = F.regexp_replace(url_path(url), r"/+$", "")
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    plain = F.concat(scheme, F.lit("://"), url_domain(url), rooted)
    for level in (
        r"github\.com/[^/]+",
        r"linkedin\.com/(?:company|in)/[^/]+",
        r"youtube\.com/(?:@|channel/|c/)[^/]+",
    ):
        plain = F.regexp_replace(plain, rf"(?i)^(https?://{level})/.*$", "$1")
    return plain


def account_handle(url: ColumnOrName, platform: ColumnOrName) -> Column:
    """The account's identifier in a profile URL of a known platform."""
    parts, platform, host = url_path_parts(url), col(platform), url_host(url)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    at_first = F.when(first.startswith("@"), first)
    tagged = F.get(F.filter(parts, lambda p: p.startswith("@")), F.lit(0))
    blog_host = F.when(host.endswith(".medium.com"), F.replace(host, F.lit(".medium.com"), F.lit("")))
    chosen = first_match([
        (platform.isin("linkedin", "bluesky"), second),
        (platform.isin("twitter", "x", "github", "instagram", "facebook", "pinterest"), first),
        (platform == "youtube", F.coalesce(at_first, second)),
        (platform.isin("tiktok", "threads"), at_first),
        (platform == "medium", F.coalesce(at_first, blog_host)),
        (platform == "mastodon", tagged),
    ])
    return F.when(F.size(parts) > 0, chosen)


def url_handle(url: ColumnOrName) -> Column:
    """The account's identifier by the URL's host alone, without ``@``."""
    parts, host = url_path_parts(url), url_host(url)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    bare = F.regexp_replace(first, "^@+", "")
    tagged = F.get(F.filter(parts, lambda p: p.startswith("@")), F.lit(0))
    at = first.startswith("@")
    two = F.size(parts) >= 2
    chosen = first_match([
        (host.contains("linkedin.com") & two & first.isin("company", "in"), second),
        (host.contains("twitter.com") | host.contains("x.com"), bare),
        (host.contains("youtube.com") & at, bare),
        (host.contains("youtube.com") & two & first.isin("c", "channel", "user"), second),
        (host.rlike(r"github\.com|instagram\.com|facebook\.com|fb\.com"), first),
        (host.contains("tiktok.com") & at, bare),
        (host.contains("medium.com") & at, bare),
        (host.contains("bsky.app") & two & (first == "profile"), second),
        (host.contains("threads.net") & at, bare),
        (host.contains("mastodon") & tagged.isNotNull(), F.regexp_replace(tagged, "^@+", "")),
    ], first)
    return F.when(F.size(parts) > 0, chosen)


def is_utility_path(url: ColumnOrName, platform: ColumnOrName) -> Column:
    """The URL is a page of the platform (login, search, ...), not an account."""
    parts, platform = F.transform(url_path_parts(url), F.lower), col(platform)
    first = F.get(parts, F.lit(0))
    listed = F.lit(False)
    for name, paths in fixed.UTILITY_PATHS.items():
        listed = listed | ((platform == name) & first.isin(*paths))
    return first_match([
        (F.size(parts) == 0, F.lit(True)),
        (platform.isin("tiktok", "threads", "mastodon", "medium"), ~first.startswith("@")),
        (platform == "youtube", ~first.isin("c", "channel", "user") & ~first.startswith("@")),
        (platform == "linkedin", ~first.isin("company", "in")),
        (platform == "bluesky", first != "profile"),
    ], F.coalesce(listed, F.lit(False)))


def handle_fits_company(handle: ColumnOrName, company: ColumnOrName) -> Column:
    """The handle is, contains or is contained in the company's name, or is its initials."""
    handle, company = col(handle), col(company)
    h = F.regexp_replace(F.btrim(F.lower(handle), F.lit("@")), "[-_]", "")
    c = F.regexp_replace(F.lower(company), "[ _-]", "")
    words = F.filter(F.split(F.lower(company), r"(?U)\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    fits = F.contains(h, c) | F.contains(c, h) | ((F.size(words) > 1) & (h == initials))
    named = (F.coalesce(handle, F.lit("")) != "") & (F.coalesce(company, F.lit("")) != "")
    return F.coalesce(named & fits, F.lit(False))


def youtube_video_id(url: ColumnOrName) -> Column:
    embed = F.regexp_extract(col(url), r"(?i)youtube\.com/embed/([a-zA-Z0-9_-]+)", 1)
    watch = F.regexp_extract(col(url), r"(?i)youtube\.com/watch\?v=([a-zA-Z0-9_-]+)", 1)
    return F.nullif(F.when(embed != "", embed).otherwise(watch), F.lit(""))


def is_youtube_embed(url: ColumnOrName) -> Column:
    return col(url).rlike(r"(?i)youtube\.com/embed/[a-zA-Z0-9_-]+")


def is_youtube_watch(url: ColumnOrName) -> Column:
    return col(url).rlike(r"(?i)youtube\.com/watch\?v=[a-zA-Z0-9_-]+")
