"""Raw inputs to domain rows: directory records, scrapes, search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import blank_to_null, col, lookup, moment, strip
from ..functions.text import header, normalize_company_name, parse_http_date, parse_iso
from ..functions.urls import detect_blog, detect_platform, normalize_blog, normalize_profile, url_domain
from ..operators.tables import first_per_key

DIRECTORY = "Online Presence"


def _first(df: DataFrame, column: str) -> Column:
    """The value, or the first of a list."""
    is_list = dict(df.dtypes)[column].startswith("array")
    return F.get(F.col(column), F.lit(0)) if is_list else F.col(column)


def load_companies(records: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies of a directory, from its homepage records, and counts of what was read.

    ``records``: record_id, Resource (text or list), company_name (linked record list, or
    the name itself), url. ``names``: record_id, name.
    """
    if dict(records.dtypes)["Resource"].startswith("array"):
        homepage = F.exists(F.col("Resource"), lambda r: F.lower(r) == "homepage")
    else:
        homepage = F.lower("Resource") == "homepage"
    linked = dict(records.dtypes)["company_name"].startswith("array")
    marked = records.withColumn("__home", F.coalesce(homepage, F.lit(False))).withColumn("__ref", _first(records, "company_name"))
    if linked:
        known = names.select(F.col("record_id").alias("__ref"), F.col("name").alias("__name"))
        marked = marked.join(known, "__ref", "left")
    else:
        marked = marked.withColumn("__name", F.col("__ref"))
    kept = F.col("__home") & (F.coalesce("__name", F.lit("")) != "")
    companies = marked.filter(kept).select(
        "record_id", normalize_company_name("__name").alias("name"), F.col("url").alias("homepage_url"),
        F.lit(DIRECTORY).alias("source_sheet"))
    counts = marked.agg(
        F.count("*").alias("processed"), F.count_if(kept).alias("stored"), F.count_if(~kept).alias("skipped"))
    return companies, counts


def import_profile_links(records: DataFrame, names: DataFrame, companies: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile links and blog links of a directory, and counts of what was read.

    The kind of record names the platform, unless the URL itself is of another one.
    """
    kind = F.lower(_first(records, "Resource"))
    known = names.select(F.col("record_id").alias("__ref"), F.lower(normalize_company_name("name")).alias("__key"))
    owners = companies.groupBy(F.lower("name").alias("__key")).agg(F.min("id").alias("company_id"))
    rows = (
        records.withColumn("__kind", F.coalesce(kind, F.lit(""))).withColumn("__url", strip("url"))
        .withColumn("__ref", _first(records, "company_name"))
        .join(known, "__ref", "left").join(owners, "__key", "left")
    )
    usable = (
        (F.col("__kind") != "") & ~F.col("__kind").isin(*fixed.SKIPPED_RESOURCES)
        & F.coalesce(F.col("__url").startswith("http://") | F.col("__url").startswith("https://"), F.lit(False))
        & F.col("company_id").isNotNull()
    )
    platform = lookup(fixed.RESOURCE_PLATFORMS, F.col("__kind"))
    is_profile = usable & platform.isNotNull()
    is_blog = usable & F.col("__kind").isin(*fixed.BLOG_RESOURCES)
    stamp = moment(as_of).alias("discovered_at")
    social = first_per_key(
        rows.filter(is_profile).select(
            "company_id", F.coalesce(detect_platform("__url"), platform).alias("platform"),
            normalize_profile("__url").alias("profile_url"), F.lit("airtable_import").alias("discovery_method"),
            F.lit("manually_reviewed").alias("verification_status"), stamp,
            F.when(F.col("__kind") == "linkedin - person", "personal")
            .when(F.col("__kind") == "linkedin - corporate", "company").alias("account_type"), "record_id"),
        ["company_id", "profile_url"], ["record_id"])
    blogs = first_per_key(
        rows.filter(is_blog).select(
            "company_id", F.coalesce(detect_blog("__url"), F.lit("company_blog")).alias("blog_type"),
            normalize_blog("__url").alias("blog_url"), F.lit("airtable_import").alias("discovery_method"),
            F.lit(True).alias("is_active"), stamp, "record_id"),
        ["company_id", "blog_url"], ["record_id"])
    counts = rows.agg(
        F.count("*").alias("processed"), F.count_if(is_profile).alias("profiles"),
        F.count_if(is_blog).alias("blogs"), F.count_if(~(is_profile | is_blog)).alias("skipped"))
    return social, blogs, counts


def prepare_snapshots(scrapes: DataFrame, as_of) -> DataFrame:
    """Scrape output (company_id, url, markdown, html, status_code, error, metadata) as snapshot rows."""
    text = blank_to_null("markdown")
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in scrapes.columns else F.lit(default)
    modified = parse_http_date(header("metadata", "last-modified")) if "metadata" in scrapes.columns else F.lit(None).cast("timestamp_ntz")
    keep = [c for c in ("id", "company_id") if c in scrapes.columns]
    return scrapes.select(
        *keep, "url", text.alias("content_markdown"), blank_to_null("html").alias("content_html"), "status_code",
        moment(as_of).alias("captured_at"), optional("has_paywall", False).alias("has_paywall"),
        optional("has_auth_required", False).alias("has_auth_required"), F.col("error").alias("error_message"),
        F.md5(text).alias("content_checksum"), modified.alias("http_last_modified"),
        F.lit(None).cast("string").alias("capture_metadata"))


#: Letters of the pieces by which homepages are found inside document URLs.
GRAM = 10


def _grams(text: str | Column, sizes: str | Column) -> Column:
    """All different parts of a text that have one of ``sizes``."""
    text, sizes = col(text), col(sizes)
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(text)), lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))))


def containing(docs: DataFrame, homepages: DataFrame, url: str = "url", homepage: str = "homepage_url") -> DataFrame:
    """``url, homepage`` for every homepage that stands anywhere in a document's URL; both are distinct and not NULL.

    Each homepage is looked up by its rarest part of ``GRAM`` letters (shorter ones by themselves), so
    what is common to many, such as a scheme or a host's ending, makes no candidates; a candidate
    is then compared whole. Exploded parts are many times what their files let Spark expect, so
    their joins are sorted ones, which no side is broadcast for.
    """
    short = F.least(F.length(homepage), F.lit(GRAM))
    parts = homepages.select(homepage, F.explode(_grams(homepage, F.array(short))).alias("__gram"))
    rarity = parts.groupBy("__gram").agg(F.count("*").alias("__n"))
    index = parts.join(rarity.hint("merge"), "__gram").groupBy(homepage).agg(F.min(F.struct("__n", "__gram"))["__gram"].alias("__gram"))
    sizes = homepages.agg(F.collect_set(short).alias("sizes")).scalar()  # at most GRAM + 1 numbers
    pieces = docs.withColumn("__sizes", sizes).filter(F.length(url) > 0).select(url, F.explode(_grams(url, "__sizes")).alias("__gram"))
    return pieces.join(index.hint("merge"), "__gram").filter(F.contains(F.col(url), F.col(homepage))).select(url, homepage)


def match_documents(docs: DataFrame, companies: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their company, documents without one, and companies that got none.

    A document belongs to the company with its URL, else to the first company whose URL it
    contains, with a scheme or without.
    """
    wanted = companies.filter("homepage_url is not null").groupBy("homepage_url").agg(
        F.max("id").alias("__company"), F.min("id").alias("__order"))
    exact = docs.join(wanted.select(F.col("homepage_url").alias(url), F.col("__company").alias("company_id")).hint("merge"), url, "left")
    rest = exact.filter("company_id is null").select(url).distinct()
    parts = containing(rest.filter(F.col(url).isNotNull()), wanted.select("homepage_url"), url)
    first = parts.join(wanted.hint("merge"), "homepage_url").groupBy(url).agg(
        F.min(F.struct("__order", "__company", "homepage_url")).alias("__hit"))
    joined = exact.join(first.hint("merge"), url, "left")
    found = joined.select(
        *docs.columns, F.coalesce("company_id", F.col("__hit.__company")).alias("company_id"),
        F.when(F.col("company_id").isNotNull(), F.col(url)).otherwise(F.col("__hit.homepage_url")).alias("matched_url"))
    matched = found.filter("company_id is not null")
    unmatched = found.filter("company_id is null").drop("company_id", "matched_url")
    seen = matched.select(F.col("matched_url").alias("homepage_url")).distinct()
    missing = companies.filter("homepage_url is not null").join(seen.hint("merge"), "homepage_url", "left_anti").select("id", "name", "homepage_url")
    return matched, unmatched, missing


def collect_social_sources(links: DataFrame, blogs: DataFrame) -> DataFrame:
    """Pages to watch: Medium profiles and active blogs."""
    medium = links.filter("platform = 'medium'").select(
        "company_id", F.col("profile_url").alias("source_url"), F.lit("medium").alias("source_type"))
    posts = blogs.filter("is_active").select(
        "company_id", F.col("blog_url").alias("source_url"), F.lit("blog").alias("source_type"))
    return medium.unionByName(posts)


def prepare_articles(results: DataFrame, as_of) -> DataFrame:
    """Search hits (title, url, snippet, published) as articles; hits without URL are dropped."""
    published = parse_iso("published")
    keep = [c for c in ("id", "company_id") if c in results.columns]
    return results.filter(F.coalesce("url", F.lit("")) != "").select(
        *keep, F.coalesce("title", F.lit("")).alias("title"), "url", F.coalesce("snippet", F.lit("")).alias("snippet"),
        url_domain("url").alias("source"), F.coalesce(published, moment(as_of)).alias("published"))


def write_report(report: DataFrame, path: str) -> None:
    """A run report as JSON."""
    report.write.mode("overwrite").json(path)
