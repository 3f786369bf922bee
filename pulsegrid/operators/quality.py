"""Table checks and repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import blank_to_null, moment, strip
from ..functions.text import is_md5
from ..functions.urls import is_valid_url
from .tables import NATURAL_KEYS, first_per_key, update_by_key

Rules = Mapping[str, Column]


def positive(c: str) -> Column:
    return F.col(c) > 0


def filled(c: str, limit: int | None = None) -> Column:
    ok = F.coalesce(strip(c) != "", F.lit(False))
    return ok if limit is None else ok & (F.length(c) <= limit)


def at_most(c: str, limit: int) -> Column:
    return F.col(c).isNull() | (F.length(c) <= limit)


def share(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).between(0.0, 1.0)


def one_of(c: str, allowed: Sequence[str]) -> Column:
    return F.col(c).isNull() | F.col(c).isin(*allowed)


def checksum(c: str) -> Column:
    return F.col(c).isNull() | is_md5(F.lower(F.col(c)))


def not_future(c: str, as_of, slack_seconds: int = 60) -> Column:
    return F.col(c).isNull() | (F.col(c) <= moment(as_of) + F.expr(f"interval {int(slack_seconds)} seconds"))


def http_url(c: str) -> Column:
    return F.col(c).isNull() | is_valid_url(c)


def table_rules(as_of) -> dict[str, Rules]:
    """The constraints of the main tables, each TRUE for a good row."""
    return {
        "companies": {
            "name_filled": filled("name", 500), "source_sheet_filled": filled("source_sheet"),
            "homepage_url_valid": http_url("homepage_url"), "flag_reason_short": at_most("flag_reason", 1000),
            "flag_reason_given": ~F.col("flagged_for_review") | blank_to_null("flag_reason").isNotNull(),
        },
        "snapshots": {
            "company_id_positive": positive("company_id"), "url_valid": http_url("url"),
            "content_markdown_short": at_most("content_markdown", 10_000_000),
            "content_html_short": at_most("content_html", 10_000_000),
            "status_code_range": F.col("status_code").isNull() | F.col("status_code").between(100, 599),
            "error_message_short": at_most("error_message", 2000),
            "content_checksum_md5": checksum("content_checksum"), "captured_at_past": not_future("captured_at", as_of),
            "content_or_error": F.coalesce("content_markdown", "content_html", "error_message").isNotNull(),
            "checksum_given": F.col("content_markdown").isNull() | F.col("content_checksum").isNotNull(),
        },
        "change_records": {
            "checksum_old_md5": checksum("checksum_old"), "checksum_new_md5": checksum("checksum_new"),
            "magnitude_known": one_of("change_magnitude", fixed.MAGNITUDES),
            "classification_known": one_of("significance_classification", fixed.CLASSIFICATIONS),
            "sentiment_known": one_of("significance_sentiment", fixed.SENTIMENTS),
            "confidence_share": share("significance_confidence"),
        },
        "company_statuses": {"status_known": one_of("status", fixed.STATUSES), "confidence_share": share("confidence")},
        "news_articles": {
            "company_id_positive": positive("company_id"), "title_filled": filled("title", 500),
            "source_filled": filled("source"), "content_url_valid": http_url("content_url"),
            "match_confidence_share": share("match_confidence"), "logo_similarity_share": share("logo_similarity"),
            "significance_confidence_share": share("significance_confidence"),
        },
        "social_media_links": {
            "platform_known": one_of("platform", fixed.PLATFORMS), "profile_url_valid": http_url("profile_url"),
            "verification_known": one_of("verification_status", fixed.VERIFICATION_STATES),
            "account_type_known": one_of("account_type", fixed.ACCOUNT_TYPES),
        },
        "leadership_mentions": {"title_context_short": filled("title_context", 50), "confidence_share": share("confidence")},
    }


def _broken(rules: Rules) -> Column:
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def check_constraints(df: DataFrame, rules: Rules, id_column: str = "id") -> DataFrame:
    """One row per broken rule and row, from one pass over the table."""
    return df.select(F.col(id_column), F.explode(_broken(rules)).alias("rule"))


def violation_rates(df: DataFrame, rules: Rules) -> DataFrame:
    """Per rule: rows broken and the share of all rows."""
    counts = df.agg(F.count("*").alias("rows"), *[
        F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select("rows", F.explode(pairs).alias("r")).select(
        "r.rule", "r.violations", (F.col("r.violations") / F.nullif("rows", F.lit(0))).alias("rate"))


def remap_snapshots(snapshots: DataFrame, companies: DataFrame) -> DataFrame:
    """Snapshots with the company their URL says, and the ``remap_phase`` that changed it.

    Tried in order: same URL, URL without closing slashes, company URL trimmed; of equal
    company URLs the smallest id. A snapshot without a match keeps its company.
    """

    def owners(url: Column, name: str) -> DataFrame:
        return companies.groupBy(url.alias(f"__url_{name}")).agg(F.min("id").alias(f"__{name}")).filter(
            F.col(f"__url_{name}").isNotNull())

    exact, trimmed = owners(F.col("homepage_url"), "exact"), owners(F.trim("homepage_url"), "trim")
    slash = exact.select(F.col("__url_exact").alias("__url_slash"), F.col("__exact").alias("__slash"))
    joined = (
        snapshots.join(exact, F.col("url") == F.col("__url_exact"), "left")
        .join(slash, F.regexp_replace("url", "/+$", "") == F.col("__url_slash"), "left")
        .join(trimmed, F.col("url") == F.col("__url_trim"), "left")
    )
    found = F.coalesce("__exact", "__slash", "__trim")
    phase = (
        F.when(F.col("__exact").isNotNull(), "exact_match").when(F.col("__slash").isNotNull(), "trailing_slash")
        .when(F.col("__trim").isNotNull(), "whitespace_trim")
    )
    moved = found.isNotNull() & (found != F.col("company_id"))
    return joined.select(
        *[F.coalesce(found, F.col("company_id")).alias(c) if c == "company_id" else F.col(c) for c in snapshots.columns],
        F.when(moved, phase).alias("remap_phase"),
    )


def remap_counts(remapped: DataFrame) -> DataFrame:
    return remapped.filter("remap_phase is not null").groupBy("remap_phase").agg(F.count("*").alias("snapshots"))


def realign_changes(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes with the company of their old snapshot."""
    owner = snapshots.select(F.col("id").alias("snapshot_id_old"), "company_id")
    return update_by_key(changes, owner, ["snapshot_id_old"], ["company_id"])


def merge_companies(tables: Mapping[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Fold duplicates into their keepers (``pairs``: keeper_id, duplicate_id).

    Rows of a duplicate move to the keeper; where the keeper has the same natural key,
    its own row stays. A keeper without homepage takes the duplicate's, else the URL of
    its first snapshot.
    """
    companies = tables["companies"]
    ids = companies.select(F.col("id").alias("__id"))
    known = (
        pairs.join(ids, F.col("keeper_id") == F.col("__id"), "left_semi")
        .join(ids, F.col("duplicate_id") == F.col("__id"), "left_semi")
        .select("keeper_id", "duplicate_id")
    )
    result: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if name == "companies" or "company_id" not in df.columns:
            result[name] = df
            continue
        moved = df.join(known, df["company_id"] == known["duplicate_id"], "left")
        moved = moved.withColumn("__moved", F.col("keeper_id").isNotNull()).withColumn(
            "company_id", F.coalesce("keeper_id", "company_id")).drop("keeper_id", "duplicate_id")
        keys = NATURAL_KEYS.get(name)
        if keys and "company_id" in keys:
            moved = first_per_key(moved, list(keys), [F.col("__moved"), F.col("id")])
        result[name] = moved.drop("__moved")
    inherited = (
        known.join(companies, known["duplicate_id"] == companies["id"])
        .groupBy("keeper_id").agg(F.min_by("homepage_url", F.when(F.col("homepage_url").isNotNull(), F.col("id"))).alias("__from_duplicate"))
    )
    kept = companies.join(known, companies["id"] == known["duplicate_id"], "left_anti")
    kept = kept.join(inherited, kept["id"] == inherited["keeper_id"], "left")
    url = F.coalesce(blank_to_null("homepage_url"), F.col("__from_duplicate"))
    if "snapshots" in result and "url" in result["snapshots"].columns:
        first_url = (
            result["snapshots"].join(known.select(F.col("keeper_id").alias("company_id")).distinct(), "company_id", "left_semi")
            .groupBy(F.col("company_id").alias("__owner")).agg(F.min_by("url", "id").alias("__from_snapshot"))
        )
        kept = kept.join(first_url, kept["id"] == first_url["__owner"], "left")
        url = F.coalesce(url, F.col("__from_snapshot"))
    result["companies"] = kept.select(*[
        F.when(F.col("keeper_id").isNotNull(), url).otherwise(F.col(c)).alias(c) if c == "homepage_url" else F.col(c)
        for c in companies.columns])
    return result


def integrity_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``check_name, rows``: misplaced and orphaned rows, shared URLs, totals."""
    companies, snapshots, changes = tables["companies"], tables["snapshots"], tables["change_records"]
    ids = companies.select(F.col("id").alias("company_id"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("check_name"), "rows")

    urls = companies.filter("homepage_url is not null").groupBy(F.col("homepage_url").alias("url")).agg(
        F.min("id").alias("__low"), F.max("id").alias("__high"), F.count("*").alias("__n"))
    owner = snapshots.select(F.col("id").alias("snapshot_id_old"), F.col("company_id").alias("__owner"))
    own_url = companies.select(F.col("id").alias("company_id"), "homepage_url")
    parts = [
        # Some company other than its own has the snapshot's URL.
        count(snapshots.join(urls, "url").filter(
            (F.col("__low") != F.col("company_id")) | (F.col("__high") != F.col("company_id"))), "wrong_company_url"),
        count(snapshots.join(own_url, "company_id").filter(F.col("url") != F.col("homepage_url")), "url_mismatch"),
        count(changes.join(owner, "snapshot_id_old").filter(F.col("company_id") != F.col("__owner")), "misaligned_change"),
        count(urls.filter("__n > 1"), "duplicate_url"),
        count(snapshots.join(ids, "company_id", "left_anti"), "orphan_snapshot"),
        count(changes.join(ids, "company_id", "left_anti"), "orphan_change"),
        count(companies, "companies"), count(snapshots, "snapshots"), count(changes, "change_records"),
    ]
    if "social_media_links" in tables:
        parts.append(count(tables["social_media_links"], "social_media_links"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
