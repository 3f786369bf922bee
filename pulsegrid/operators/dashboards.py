"""List, detail and risk views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import on_or_after
from .aggregates import change_rate_anomalies, freshness_tier
from .latest import current_status, latest_per_key, page
from .people import leadership_departures
from .status import status_news_contradictions

Tables = Mapping[str, DataFrame]


def companies_list(
    tables: Tables, as_of, search: str | None = None, status: str | None = None, source_sheet: str | None = None,
    has_changes: bool | None = None, flagged: bool | None = None, freshness: str | None = None,
    manual_override: bool | None = None,
) -> DataFrame:
    """Companies with status, last change, last capture and counts, filtered; order and page with
    ``latest.sort_columns`` and ``latest.page``.

    Each fact table is reduced to one row per company before it meets the companies.
    """
    companies = tables["companies"]
    latest = current_status(tables["company_statuses"].select("id", "company_id", "status", "is_manual_override")).select(
        "company_id", F.col("status").alias("__status"), F.col("is_manual_override").alias("__manual"))
    changed = tables["change_records"].filter("has_changed").groupBy("company_id").agg(
        F.max("detected_at").alias("last_change_date"))
    captured = tables["snapshots"].groupBy("company_id").agg(F.max("captured_at").alias("last_snapshot"))
    social = tables["social_media_links"].groupBy("company_id").agg(F.count("*").alias("social_count"))
    news = tables["news_articles"].groupBy("company_id").agg(F.count("*").alias("news_count"))
    rows = companies
    if search:
        rows = rows.filter(F.col("name").ilike(f"%{search}%"))
    if source_sheet:
        rows = rows.filter(F.col("source_sheet") == source_sheet)
    if flagged is not None:
        rows = rows.filter(F.col("flagged_for_review") == flagged)
    rows = rows.withColumn("company_id", F.col("id"))
    for part in (latest, changed, captured, social, news):
        rows = rows.join(part, "company_id", "left")
    manual = F.coalesce("__manual", F.lit(False))
    if status:
        rows = rows.filter(F.col("__status") == status)
    if has_changes is not None:
        rows = rows.filter(F.col("last_change_date").isNotNull() == has_changes)
    if manual_override is not None:
        rows = rows.filter(manual == manual_override)
    if freshness:
        rows = rows.filter(freshness_tier("last_snapshot", as_of, "__status", "__manual") == freshness)
    reason = [c for c in ("flag_reason",) if c in companies.columns]
    return rows.select(
        "id", "name", "homepage_url", "source_sheet", "flagged_for_review", *reason,
        F.coalesce("__status", F.lit("unknown")).alias("status"), manual.alias("is_manual_override"),
        "last_change_date", "last_snapshot", F.coalesce("social_count", F.lit(0)).alias("social_count"),
        F.coalesce("news_count", F.lit(0)).alias("news_count"))


def changes_by_company(
    tables: Tables, as_of, days: int = 180, classification: str | None = None, sentiment: str | None = None,
    min_confidence: float = 0.0, number: int = 1, per_page: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """A page of companies by newest change, and the change rows of those companies."""
    changes = tables["change_records"].filter(F.col("has_changed") & on_or_after("detected_at", as_of, days))
    if classification:
        changes = changes.filter(F.col("significance_classification") == classification)
    if sentiment:
        changes = changes.filter(F.col("significance_sentiment") == sentiment)
    if min_confidence > 0:
        changes = changes.filter(F.coalesce("significance_confidence", F.lit(0.0)) >= min_confidence)
    names = tables["companies"].select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    counted = changes.groupBy("company_id").agg(
        F.max("detected_at").alias("latest_change"), F.count("*").alias("change_count"))
    groups = page(counted.join(names, "company_id"), [F.col("latest_change").desc(), F.col("company_id")], number, per_page)
    latest = current_status(tables["company_statuses"].select("id", "company_id", "status", "is_manual_override")).drop("id")
    rows = changes.join(groups.select("company_id"), "company_id", "left_semi")
    headed = groups.join(latest, "company_id", "left").select(
        "company_id", "company_name", F.coalesce("status", F.lit("unknown")).alias("company_status"),
        F.coalesce("is_manual_override", F.lit(False)).alias("company_status_manual"),
        "latest_change", "change_count")
    return headed, rows


# Sections of a company page: table, order, rows (1: the latest one; None: all).
SUMMARY_SECTIONS = (
    ("status", "company_statuses", ("-id",), 1),
    ("changes", "change_records", ("-detected_at", "-id"), None),
    ("social_links", "social_media_links", ("platform", "profile_url"), None),
    ("news", "news_articles", ("-published_at", "-id"), None),
    ("leadership", "company_leadership", ("-is_current", "title", "id"), None),
    ("latest_snapshot", "snapshots", ("-captured_at", "-id"), 1),
)
NOT_SHOWN = ("content_markdown", "content_html", "capture_metadata")


def company_summary(tables: Tables, company_id: int) -> DataFrame:
    """One company's page as rows: ``section, record`` (JSON), sections as in ``SUMMARY_SECTIONS``
    plus the company itself and its number of snapshots. Page text is never read."""

    def ordering(names: tuple[str, ...]) -> list[Column]:
        return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n) for n in names]

    def section(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("record"))

    parts = [section("company", tables["companies"].filter(F.col("id") == company_id))]
    for name, table, order, shown in SUMMARY_SECTIONS:
        if table in tables:
            own = tables[table].filter(F.col("company_id") == company_id).drop(*NOT_SHOWN)
            parts.append(section(name, own if shown is None else own.orderBy(*ordering(order)).limit(shown)))
    count = tables["snapshots"].filter(F.col("company_id") == company_id).agg(F.count("*").alias("snapshot_count"))
    parts.append(section("snapshot_count", count))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def company_summaries(tables: Tables) -> DataFrame:
    """The same for all companies at once: ``company_id, section, record``."""
    keys = {"company_statuses": ("id",), "snapshots": ("captured_at", "id")}

    def section(name: str, df: DataFrame, owner: str) -> DataFrame:
        return df.select(F.col(owner).alias("company_id"), F.lit(name).alias("section"),
                         F.to_json(F.struct(*df.columns)).alias("record"))

    parts = [section("company", tables["companies"], "id")]
    for name, table, _, shown in SUMMARY_SECTIONS:
        if table in tables:
            df = tables[table].drop(*NOT_SHOWN)
            parts.append(section(name, df if shown is None else latest_per_key(df, ["company_id"], keys[table], shown), "company_id"))
    counts = tables["snapshots"].groupBy("company_id").agg(F.count("*").alias("snapshot_count"))
    parts.append(section("snapshot_count", counts, "company_id"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def risk_view(tables: Tables, as_of) -> dict[str, DataFrame]:
    """Status against news, critical departures, and unusual change rates."""
    companies = tables["companies"]
    return {
        "contradictions": status_news_contradictions(
            companies, tables["company_statuses"], tables["news_articles"], as_of),
        "departures": leadership_departures(tables["leadership_changes"], companies, as_of),
        "anomalies": change_rate_anomalies(tables["change_records"], companies, as_of),
    }


def company_lookup(tables: Tables, name: str | None = None, company_id: int | None = None) -> DataFrame:
    """A company by id or name (any case) with its newest status."""
    hit = F.col("id") == company_id if company_id is not None else F.lower("name") == (name or "").lower()
    companies = tables["companies"].filter(hit)
    wanted = companies.select(F.col("id").alias("company_id"))
    own = tables["company_statuses"].join(wanted, "company_id", "left_semi")
    latest = current_status(own).select(
        F.col("company_id").alias("id"), "status", "confidence", "last_checked", "is_manual_override")
    return companies.join(latest, "id", "left")
