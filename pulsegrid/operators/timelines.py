"""Feeds over several tables, and merging of link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import empty_strings
from ..functions.urls import link_key
from .tables import first_per_key


def activity_feed(changes: DataFrame, news: DataFrame, leaders: DataFrame, companies: DataFrame) -> DataFrame:
    """Significant changes, all news and current leaders in one nine-column shape."""
    nothing = F.lit(None).cast("string")
    words = lambda df: F.coalesce(F.col("matched_keywords"), empty_strings()) if "matched_keywords" in df.columns else empty_strings()
    parts = [
        changes.filter(F.col("has_changed") & (F.col("significance_classification") == "significant")).select(
            F.lit("change").alias("event_type"), F.col("id").alias("event_id"),
            F.col("detected_at").alias("event_date"), "company_id",
            F.col("significance_classification").alias("classification"),
            F.col("significance_sentiment").alias("sentiment"),
            F.col("change_magnitude").alias("magnitude"), words(changes).alias("keywords"), nothing.alias("title")),
        news.select(
            F.lit("news").alias("event_type"), F.col("id").alias("event_id"),
            F.col("published_at").alias("event_date"), "company_id",
            F.col("significance_classification").alias("classification"),
            F.col("significance_sentiment").alias("sentiment"),
            nothing.alias("magnitude"), words(news).alias("keywords"), "title"),
        leaders.filter("is_current").select(
            F.lit("leadership").alias("event_type"), F.col("id").alias("event_id"),
            F.col("discovered_at").alias("event_date"), "company_id",
            nothing.alias("classification"), nothing.alias("sentiment"), nothing.alias("magnitude"),
            empty_strings().alias("keywords"),
            F.concat("person_name", F.lit(" - "), "title").alias("title")),
    ]
    events = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return events.join(names, "company_id")


def feed_page(feed: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a feed, newest events first."""
    order = [F.col("event_date").desc(), F.col("event_type"), F.col("event_id").desc()]
    return feed.orderBy(*order).offset(offset).limit(limit)


def change_timeline(changes: DataFrame, social_changes: DataFrame, company_id: int | None = None) -> DataFrame:
    """Homepage and social changes in one list, tagged with their source."""
    shape = ["company_id", "id", "detected_at", "has_changed", "change_magnitude",
             "significance_classification", "significance_sentiment"]
    home = changes.select(F.lit("HOMEPAGE").alias("source"), *shape)
    social = social_changes.select(F.upper(F.coalesce("source_type", F.lit("unknown"))).alias("source"), *shape)
    both = home.unionByName(social)
    if company_id is not None:
        both = both.filter(F.col("company_id") == company_id)
    return both


def related_news(news: DataFrame, company_id: int) -> DataFrame:
    """All articles of a company; ``top_n`` shows the newest."""
    return news.filter(F.col("company_id") == company_id)


def merge_links(existing: DataFrame, new: DataFrame, key: str = "profile_url", owner: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """Both lists with one row per link; the higher score wins, then the existing, then the earlier row."""
    both = existing.withColumn("__origin", F.lit(0)).unionByName(new.withColumn("__origin", F.lit(1)), allowMissingColumns=True)
    return _best_link(both, key, owner, [F.col("__origin"), F.col("id")]).drop("__origin")


def dedupe_links(links: DataFrame, key: str = "profile_url", owner: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """One row per link: the highest score, then the first seen."""
    return _best_link(links, key, owner, [F.col("id")])


def _best_link(links: DataFrame, key: str, owner: tuple[str, ...], order: list) -> DataFrame:
    score = F.coalesce(F.col("similarity_score"), F.lit(0.0)) if "similarity_score" in links.columns else F.lit(0.0)
    keyed = links.withColumn("__key", link_key(key)).filter("__key <> ''")
    return first_per_key(keyed, [*owner, "__key"], [score.desc(), *order]).drop("__key")


def aggregate_pages(links: DataFrame, key: str = "profile_url", owner: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """Links found on several pages of a company, the first of each kept."""
    keyed = links.withColumn("__key", link_key(key)).filter("__key <> ''")
    return first_per_key(keyed, [*owner, "__key"], [F.col("page_id"), F.col("position")]).drop("__key")
