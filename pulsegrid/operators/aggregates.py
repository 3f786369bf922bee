"""Dashboard aggregates: counts, trends, tiers, anomalies, run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import days_before, moment, on_or_after
from .latest import _closed_by_hand, current_status, latest_with_ties


def _one_row(spark: SparkSession, **parts: DataFrame) -> DataFrame:
    """One row of structs, each the only row of an aggregate (scalar subqueries, no join)."""
    named = [df.select(F.struct(*df.columns).alias(name)).scalar().alias(name) for name, df in parts.items()]
    flat = [F.col(f"{name}.{c}").alias(c) for name, df in parts.items() for c in df.columns]
    return spark.range(1).select(*named).select(*flat)


def overview_stats(tables: Mapping[str, DataFrame], as_of) -> DataFrame:
    """Nine totals in one row; each table is read once, only in the columns counted."""
    changes, recent = tables["change_records"], on_or_after("detected_at", as_of, 30)
    count = lambda name: F.count("*").alias(name)
    return _one_row(
        tables["companies"].sparkSession,
        companies=tables["companies"].agg(
            count("total_companies"), F.count("homepage_url").alias("companies_with_homepage")),
        snapshots=tables["snapshots"].agg(count("total_snapshots"), F.max("captured_at").alias("last_scan_date")),
        changes=changes.filter(recent).agg(
            F.count_if("has_changed").alias("recent_changes"),
            F.count_if(F.col("significance_classification") == "significant").alias("significant_changes")),
        links=tables["social_media_links"].agg(count("total_social_links")),
        news=tables["news_articles"].agg(count("total_news")),
        leaders=tables["company_leadership"].filter("is_current").agg(count("total_leadership")),
    )


def status_counts(statuses: DataFrame) -> DataFrame:
    """Companies per status by latest check; a company with tied checks counts for each."""
    newest = latest_with_ties(statuses.select("company_id", "last_checked", "status"), ["company_id"], "last_checked")
    return newest.distinct().groupBy("status").agg(F.count("*").alias("companies"))


def _worst(column: str, levels: Sequence[str]) -> Column:
    """Rank of the most severe level (levels are listed from mild to severe)."""
    value = F.lower(F.col(column))
    rank = F.lit(0)
    for i, level in enumerate(levels):
        rank = F.when(value == level, i).otherwise(rank)
    return F.max(rank)


def changes_since_last_scan(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Companies changed since the scan before the last, each at its worst magnitude and significance.

    One row; all zero when there are fewer than two scan dates.
    """
    dates = snapshots.select(F.to_date("captured_at").alias("d")).distinct().orderBy(F.desc("d")).limit(2)
    previous = dates.agg(F.when(F.count("d") == 2, F.min("d"))).scalar()
    current = dates.agg(F.max("d")).scalar()
    magnitudes = ("minor", "moderate", "major")
    verdicts = ("insignificant", "uncertain", "significant")
    worst = (
        changes.filter(F.col("has_changed") & (F.to_date("detected_at") >= previous))
        .groupBy("company_id")
        .agg(_worst("change_magnitude", magnitudes).alias("m"),
             _worst("significance_classification", verdicts).alias("s"))
    )
    return worst.agg(
        F.count("*").alias("total_changes"),
        *[F.count_if(F.col("m") == i).alias(v) for i, v in enumerate(magnitudes)],
        *[F.count_if(F.col("s") == i).alias(v) for i, v in enumerate(verdicts)],
    ).withColumn("scan_date", current)


def alerts_summary(changes: DataFrame, companies: DataFrame, as_of, days: int = 30, shown: int = 5) -> DataFrame:
    """Recent negative and uncertain changes, all flagged companies counted, and the first ``shown`` of them by name."""
    verdict = F.col("significance_classification")
    recent = changes.filter(on_or_after("detected_at", as_of, days)).agg(
        F.count_if((verdict == "significant") & (F.col("significance_sentiment") == "negative"))
        .alias("negative_significant_count"),
        F.count_if(verdict == "uncertain").alias("uncertain_count"),
    )
    marked = companies.filter("flagged_for_review")
    reason = F.col("flag_reason") if "flag_reason" in companies.columns else F.lit(None).cast("string")
    top = marked.select("name", "id", reason.alias("flag_reason")).orderBy("name", "id").limit(shown)
    flagged = top.agg(F.array_sort(F.collect_list(F.struct("name", "id", "flag_reason"))).alias("flagged_companies"))
    counted = marked.agg(F.count("*").alias("flagged_count"))
    both = _one_row(changes.sparkSession, recent=recent, flagged=flagged, counted=counted)
    return both.withColumn(
        "total_alerts",
        F.col("negative_significant_count") + F.col("uncertain_count") + F.col("flagged_count"))


def weekly_trend(changes: DataFrame, news: DataFrame, leaders: DataFrame, as_of, weeks: int = 12) -> DataFrame:
    """Per week (disjoint, the last one ending on ``as_of``): significant changes, articles, new leaders."""
    today = F.to_date(moment(as_of))

    def series(df: DataFrame, when: str, kind: str) -> DataFrame:
        age = F.datediff(today, F.to_date(when))
        return df.filter(age.between(0, weeks * 7 - 1)).select(
            F.floor(age / 7).cast("int").alias("week"), F.lit(kind).alias("kind"))

    significant = changes.filter(F.col("has_changed") & (F.col("significance_classification") == "significant"))
    counts = (
        series(significant, "detected_at", "c")
        .unionByName(series(news, "published_at", "n"))
        .unionByName(series(leaders, "discovered_at", "l"))
        .groupBy("week")
        .agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in (
            ("c", "significant_changes"), ("n", "news_articles"), ("l", "leadership_discoveries"))])
    )
    spine = changes.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week"))
    start = F.date_sub(today, F.col("week") * 7 + 6)
    return spine.join(counts, "week", "left").select(
        start.alias("week_start"), F.date_format(start, "MM-dd").alias("label"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c)
          for c in ("significant_changes", "news_articles", "leadership_discoveries")],
    )


def freshness_tier(last_snapshot: str, as_of, status: str = "status", manual: str = "is_manual_override") -> Column:
    closed = F.coalesce((F.col(status) == "likely_closed") & F.col(manual), F.lit(False))
    tier = F.when(closed, "manually_closed").when(F.col(last_snapshot).isNull(), "never")
    for name, days in fixed.FRESHNESS_DAYS:
        tier = tier.when(on_or_after(last_snapshot, as_of, days), name)
    return tier.otherwise("very_stale")


def freshness_tiers(companies: DataFrame, snapshots: DataFrame, statuses: DataFrame, as_of) -> DataFrame:
    """How recently each company was captured; companies closed by hand stand apart."""
    last = snapshots.groupBy("company_id").agg(F.max("captured_at").alias("last_snapshot"))
    status = current_status(statuses.select("id", "company_id", "status", "is_manual_override")).drop("id")
    return (
        companies.select(F.col("id").alias("company_id"), "name")
        .join(last, "company_id", "left").join(status, "company_id", "left")
        .select("company_id", "name", "last_snapshot", freshness_tier("last_snapshot", as_of).alias("tier"))
    )


def bucket_counts(df: DataFrame, column: str, buckets: Sequence[str], name: str = "companies") -> DataFrame:
    """Rows per bucket, absent buckets as 0."""
    spine = df.sparkSession.createDataFrame([(b,) for b in buckets], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias(name))
    return spine.join(counted, column, "left").select(column, F.coalesce(name, F.lit(0)).alias(name))


def freshness_counts(tiers: DataFrame) -> DataFrame:
    return bucket_counts(tiers, "tier", fixed.FRESHNESS_TIERS)


def monthly_sentiment(news: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Per company and month: positive, negative and all significant articles."""
    recent = news.filter(
        (F.col("significance_classification") == "significant") & on_or_after("published_at", as_of, months * 30))
    mood = F.col("significance_sentiment")
    return recent.groupBy("company_id", F.date_format("published_at", "yyyy-MM").alias("month")).agg(
        F.count_if(mood == "positive").alias("positive"), F.count_if(mood == "negative").alias("negative"),
        F.count("*").alias("total"))


def change_rate_anomalies(changes: DataFrame, companies: DataFrame, as_of, days: int = 90, baseline_days: int = 365) -> DataFrame:
    """Companies that change at least twice, or at most a tenth, as often as their own baseline."""
    counted = (
        changes.filter(F.col("has_changed") & on_or_after("detected_at", as_of, baseline_days))
        .groupBy("company_id")
        .agg(F.count_if(on_or_after("detected_at", as_of, days)).alias("recent_count"),
             F.count("*").alias("baseline_count"))
    )
    expected = F.col("baseline_count") * F.lit(days / baseline_days)
    rated = counted.withColumn("__expected", expected).withColumn(
        "__ratio", F.col("recent_count") / F.col("__expected"))
    odd = rated.filter((F.col("__ratio") >= 2.0) | (F.col("__ratio") <= 0.1))
    named = odd.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")
    return named.select(
        "company_id", "company_name", "recent_count", "baseline_count",
        F.round("__expected", 2).alias("expected_count"), F.round("__ratio", 2).alias("ratio"),
        F.when(F.col("__ratio") >= 2.0, "spike").otherwise("drought").alias("direction"),
    )


# Fixed buckets of a run report; other breakdowns list what occurs.
REPORT_BUCKETS = {
    "significance": fixed.CLASSIFICATIONS,
    "sentiment": fixed.SENTIMENTS,
    "magnitude": ("major", "moderate", "minor"),
}


def breakdowns(results: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Several counters over a run's rows in one pass: ``breakdown, value, n``.

    ``columns`` maps a breakdown to its column. Breakdowns with fixed buckets show 0 for an empty
    one and count all other values as ``other``, if there are any; the rest show every value, a
    missing one as ``unknown``.
    """
    pairs = [
        F.struct(F.lit(name).alias("breakdown"), F.coalesce(F.col(c), F.lit("unknown")).alias("value"))
        for name, c in columns.items()
    ]
    counted = (
        results.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        .groupBy("breakdown", "value").agg(F.count("*").alias("n"))
    )
    fixed_names = [name for name in columns if name in REPORT_BUCKETS]
    free = counted.filter(~F.col("breakdown").isin(*fixed_names)) if fixed_names else counted
    if not fixed_names:
        return free
    spine = results.sparkSession.createDataFrame(
        [(name, value) for name in fixed_names for value in REPORT_BUCKETS[name]], "breakdown string, value string")
    filled = spine.join(counted, ["breakdown", "value"], "left").select(
        "breakdown", "value", F.coalesce("n", F.lit(0)).alias("n"))
    known = F.lit(False)
    for name in fixed_names:
        known = known | ((F.col("breakdown") == name) & F.col("value").isin(*REPORT_BUCKETS[name]))
    others = counted.filter(F.col("breakdown").isin(*fixed_names) & ~known).groupBy("breakdown").agg(
        F.sum("n").alias("n")).select("breakdown", F.lit("other").alias("value"), "n")
    return filled.unionByName(others).unionByName(free)


def run_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Processed, successful, failed and skipped items (``outcome``). The errors are ``run_errors``."""
    return results.groupBy(*by).agg(
        F.count("*").alias("processed"),
        *[F.count_if(F.col("outcome") == o).alias(name) for o, name in (
            ("success", "successful"), ("failure", "failed"), ("skip", "skipped"))],
    )


def run_errors(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every error of a run, a row each."""
    return results.filter(F.col("outcome") == "failure").select(*by, "error")


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Several run summaries as one."""
    return summaries.agg(*[F.sum(c).alias(c) for c in ("processed", "successful", "failed", "skipped")])
