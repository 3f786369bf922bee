"""Matching articles to companies, and news queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import col, let, moment, on_or_after, once, quoted
from ..functions.keywords import Term, _occurrences
from ..functions.urls import url_domain
from .significance import VERDICT_COLUMNS, classify_significance, overlay_verdicts
from .tables import first_per_key


def domain_match(text: str | Column, domain: str | Column) -> Column:
    """The domain stands in the text on its own, not inside a longer name."""
    text, domain = col(text), col(domain)
    pattern = F.concat(F.lit(r"(?i)(?<![a-zA-Z0-9.\-])"), quoted(domain), F.lit(r"(?![a-zA-Z0-9\-])"))
    # The plain test spares most rows their own regular expression.
    there = (domain != "") & F.contains(F.lower(text), F.lower(domain))
    return F.coalesce(there & F.regexp_like(text, pattern), F.lit(False))


def name_in_context(text: str | Column, name: str | Column, words: Sequence[str] = fixed.BUSINESS_WORDS) -> Column:
    """The name occurs with a business word within 200 characters on either side."""
    text, name = F.coalesce(col(text), F.lit("")), F.coalesce(col(name), F.lit(""))
    any_word = "|".join(words)

    def near(parts: Column) -> Column:
        low, wanted = parts["low"], parts["name"]

        def business(start: Column) -> Column:
            begin = F.greatest(start - 200, F.lit(0))
            return F.substring(low, begin + 1, start + F.length(wanted) + 200 - begin).rlike(any_word)

        return F.contains(low, wanted) & F.exists(_occurrences(low, wanted), business)

    both = F.struct(F.lower(text).alias("low"), F.lower(name).alias("name"))
    return F.when((name == "") | (text == ""), F.lit(False)).otherwise(let(both, near))


def _name_part(domain: Column) -> Column:
    """A domain without port and top level; a single label stays."""
    bare = F.substring_index(domain, ":", 1)
    return F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.[^.]*$", "")).otherwise(bare)


def competing_domain(url: str | Column, domain: str | Column) -> Column:
    """The URL's site has the company's name under another domain, or one name begins the other."""
    site, own = url_domain(url), col(domain)
    a, b = _name_part(site), _name_part(own)
    prefix = (F.startswith(a, b) | F.startswith(b, a)) & (F.least(F.length(a), F.length(b)) >= 3)
    ok = (site != "") & (own != "") & (site != own) & (a != "") & (b != "")
    return F.coalesce(ok & ((a == b) | prefix), F.lit(False))


def match_articles(
    articles: DataFrame, companies: DataFrame, verdicts: DataFrame | None = None,
    weights: dict[str, float] = fixed.MATCH_WEIGHTS, threshold: float = fixed.MATCH_THRESHOLD,
    only_matches: bool = False,
) -> DataFrame:
    """Articles (company_id, title, url, snippet, ...) with ``match_confidence``, ``match_evidence``
    and ``is_match``.

    ``verdicts`` (company_id, url, is_match, reasoning) is asked only where domain and
    context alone do not reach the threshold.
    """
    own = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("__name"),
        F.coalesce(url_domain("homepage_url"), F.lit("")).alias("__domain"))
    joined = articles.join(own, "company_id")
    if verdicts is not None:
        asked = verdicts.select("company_id", "url", F.col("is_match").alias("__said"), F.col("reasoning").alias("__why"))
        joined = joined.join(asked, ["company_id", "url"], "left")
        said, why = F.coalesce("__said", F.lit(False)), F.coalesce("__why", F.lit(""))
    else:
        said, why = F.lit(False), F.lit("")
    name, domain = F.col("__name"), F.col("__domain")

    def rated(s: Column) -> Column:
        site = F.when(s["by_domain"], 1.0).when(s["competing"], fixed.COMPETING_DOMAIN_VALUE).otherwise(0.0)
        base = site * weights["domain"] + F.when(s["by_context"], 1.0).otherwise(0.0) * weights["context"]
        confirmed = (F.greatest(F.lit(0.0), base) < threshold) & said
        total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(confirmed, weights["verdict"]).otherwise(0.0)))
        evidence = F.array_compact(F.array(
            F.when(s["by_domain"], F.concat(F.lit("Domain match: "), domain)),
            F.when(s["by_context"], F.concat(F.lit("Name in business context: "), name)),
            F.when(confirmed, F.concat(F.lit("LLM verification: "), why)),
        ))
        return let(F.struct(total.alias("t"), evidence.alias("e")), lambda r: F.struct(
            r["t"].alias("match_confidence"), r["e"].alias("match_evidence"), (r["t"] >= threshold).alias("is_match")))

    by_domain = domain_match("url", domain) | domain_match(F.coalesce("snippet", F.lit("")), domain)
    signals = let(by_domain, lambda hit: F.struct(
        hit.alias("by_domain"), (~hit & competing_domain("url", domain)).alias("competing"),
        name_in_context("snippet", name).alias("by_context")))
    keep = (lambda m: m["is_match"]) if only_matches else None
    return joined.select(*articles.columns, once(let(signals, rated), keep))


def ingest_news(
    articles: DataFrame, companies: DataFrame, existing: DataFrame, as_of,
    match_verdicts: DataFrame | None = None, class_verdicts: DataFrame | None = None,
    terms: Sequence[Term] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows to add to the news table, and per company how many articles were found, verified, stored.

    Articles already known by URL are skipped, the rest matched and classified on snippet
    and title; of two new articles with one URL the first is stored.
    """
    known = existing.select(F.col("content_url").alias("url")).distinct()
    fresh = articles.join(known, "url", "left_anti")
    matched = match_articles(fresh, companies, match_verdicts, only_matches=True).withColumn("title", F.coalesce("title", F.lit("")))
    # Only what is stored is judged: known URLs are gone already, and others of its URL don't count.
    chosen = first_per_key(matched, ["url"], ["company_id", "title"])
    subject = F.concat(F.coalesce("snippet", F.lit("")), F.lit(" "), F.col("title"))
    judged = classify_significance(chosen.withColumn("__subject", subject), "__subject", "minor", (), terms)
    if class_verdicts is not None:
        judged = overlay_verdicts(judged, class_verdicts, ["company_id", "url"])
    stored = judged.select(
        "company_id", "title", F.col("url").alias("content_url"), "source",
        F.coalesce(F.col("published"), moment(as_of)).alias("published_at"), moment(as_of).alias("discovered_at"),
        "match_confidence", "match_evidence", F.lit(None).cast("double").alias("logo_similarity"),
        F.coalesce("snippet", F.lit("")).alias("company_match_snippet"),
        *[c for c in VERDICT_COLUMNS if c != "evidence_snippets"])
    # Articles are matched once for both counts.
    owners = matched.groupBy("url", "company_id").agg(F.count("*").alias("__n")).withColumn(
        "__first", F.min("company_id").over(Window.partitionBy("url")))
    kept = owners.groupBy("company_id").agg(
        F.sum("__n").alias("verified"), F.count_if(F.col("company_id") == F.col("__first")).alias("stored"))
    found = articles.groupBy("company_id").agg(F.count("*").alias("found"))
    counts = found.join(kept, "company_id", "left").fillna(0, ["verified", "stored"])
    return stored, counts


def news_filtered(news: DataFrame, companies: DataFrame, as_of, days: int = 180, classification: str | None = None, sentiment: str | None = None) -> DataFrame:
    """Recent articles with the company's name."""
    hits = news.filter(on_or_after("published_at", as_of, days))
    if classification:
        hits = hits.filter(F.col("significance_classification") == classification)
    if sentiment:
        hits = hits.filter(F.col("significance_sentiment") == sentiment)
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return hits.join(names, "company_id")


def significant_news(news: DataFrame, companies: DataFrame, as_of, days: int = 90, sentiment: str | None = None) -> DataFrame:
    return news_filtered(news, companies, as_of, days, "significant", sentiment)


def recent_by_company(news: DataFrame, company_id: int) -> DataFrame:
    """All articles of a company; ``top_n`` shows the newest."""
    return news.filter(F.col("company_id") == company_id)
