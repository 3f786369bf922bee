"""Discovery and classification of profile and blog links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import empty_strings, let, moment
from ..functions.html import (
    drop_tweet_embeds,
    labelled_links,
    links_from_html,
    links_from_markdown,
    meta_links,
    schema_org_links,
)
from ..functions.urls import (
    base_domain,
    detect_blog,
    detect_platform,
    handle_fits_company,
    normalize_blog,
    normalize_profile,
    url_handle,
)
from .tables import first_per_key


def page_links(pages: DataFrame, html: str = "html", markdown: str | None = None, base: str = "url") -> DataFrame:
    """``pages`` with ``links``: all distinct links in the order found, tweet embeds dropped."""
    text = links_from_markdown(markdown) if markdown else empty_strings()

    def combine(parts: Column) -> Column:
        found = F.array_distinct(F.concat(parts["plain"], parts["trusted"]))
        return drop_tweet_embeds(found, parts["trusted"])

    trusted = F.concat(schema_org_links(html), meta_links(html), labelled_links(html))
    parts = F.struct(F.concat(text, links_from_html(html, base)).alias("plain"), trusted.alias("trusted"))
    return pages.withColumn("links", let(parts, combine))


def discover_links(
    pages: DataFrame, as_of, html: str = "html", markdown: str | None = None, base: str = "url",
    method: str = "page_footer",
) -> tuple[DataFrame, DataFrame]:
    """Social links and blog links found on ``pages`` (company_id, page_id, url, html).

    A link is a blog first, else a profile on a known platform. Each canonical URL is
    kept once per company, where it was first found.
    """
    found = page_links(pages, html, markdown, base).select(
        "company_id", "page_id", F.posexplode("links").alias("position", "link"))
    kinds = found.withColumn("blog_type", detect_blog("link")).withColumn("platform", detect_platform("link"))
    stamp = moment(as_of).alias("discovered_at")
    social = first_per_key(
        kinds.filter("blog_type is null and platform is not null").select(
            "company_id", "platform", normalize_profile("link").alias("profile_url"),
            F.lit(method).alias("discovery_method"), F.lit("unverified").alias("verification_status"),
            stamp, "page_id", "position"),
        ["company_id", "profile_url"], ["page_id", "position"])
    blogs = first_per_key(
        kinds.filter("blog_type is not null").select(
            "company_id", "blog_type", normalize_blog("link").alias("blog_url"),
            F.lit(method).alias("discovery_method"), F.lit(True).alias("is_active"), stamp, "page_id", "position"),
        ["company_id", "blog_url"], ["page_id", "position"])
    return social, blogs


def discovery_stats(companies: DataFrame, social: DataFrame, blogs: DataFrame) -> DataFrame:
    """Per company: links and blogs found (0 where none)."""
    links = social.groupBy("company_id").agg(F.count("*").alias("links"))
    posts = blogs.groupBy("company_id").agg(F.count("*").alias("blogs"))
    return (
        companies.select(F.col("id").alias("company_id")).join(links, "company_id", "left").join(posts, "company_id", "left")
        .select("company_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("blogs", F.lit(0)).alias("blogs"))
    )


def platform_totals(social: DataFrame) -> DataFrame:
    """Links and companies per platform."""
    per_company = social.groupBy("platform", "company_id").agg(F.count("*").alias("n"))
    return per_company.groupBy("platform").agg(F.sum("n").alias("links"), F.count("*").alias("companies"))


def classify_accounts(links: DataFrame, companies: DataFrame) -> DataFrame:
    """Links with ``account_type`` and ``account_confidence`` from the handle, the place of
    the link on the page and the logo."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("__name"))
    base = links.drop("account_type", "account_confidence").join(names, "company_id")
    place = F.col("html_location")
    logo = F.col("logo_similarity") if "logo_similarity" in links.columns else F.lit(None).cast("double")
    score = (
        F.when(handle_fits_company(url_handle("profile_url"), "__name"), 0.4).otherwise(0.0)
        + F.when(place.isin("footer", "header", "nav"), 0.3).when(place == "main", 0.1).otherwise(0.0)
        + F.when(logo > 0.85, 0.3).otherwise(0.0)
    )
    scored = base.withColumn("__score", F.least(F.lit(1.0), score))
    kind = F.when(F.col("__score") >= 0.6, "company").when(F.col("__score") <= 0.2, "personal").otherwise("unknown")
    sure = F.when(F.col("__score") <= 0.2, 1.0 - F.col("__score")).otherwise(F.col("__score"))
    return scored.withColumn("account_type", kind).withColumn("account_confidence", sure).drop("__name", "__score")


def group_by_domain(urls: DataFrame, url: str = "url") -> DataFrame:
    """URLs with their base domain, and per domain how many there are."""
    return urls.groupBy(base_domain(url).alias("domain")).agg(F.count("*").alias("urls"))


def company_links(links: DataFrame, blogs: DataFrame, company_id: int) -> DataFrame:
    """All links of a company: profiles by platform, then blogs."""
    own = F.col("company_id") == company_id
    social = links.filter(own).select(
        F.lit("social").alias("kind"), F.col("platform").alias("type"), F.col("profile_url").alias("link"))
    posts = blogs.filter(own).select(
        F.lit("blog").alias("kind"), F.col("blog_type").alias("type"), F.col("blog_url").alias("link"))
    return social.unionByName(posts)


def links_by_platform(links: DataFrame, platform: str) -> DataFrame:
    return links.filter(F.col("platform") == platform)


def active_blogs(blogs: DataFrame) -> DataFrame:
    return blogs.filter("is_active")


def latest_logo(logos: DataFrame) -> DataFrame:
    """Each company's newest logo."""
    from .latest import latest_per_key

    return latest_per_key(logos, ["company_id"], ["extracted_at", "id"])
