"""A company's operating status from page, social, news and leadership signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import blank_to_null, has_text, moment, on_or_after, strip, text_array
from ..functions.dates import days_since, is_inactive, latest_post_date
from ..functions.text import acquisition_mention, copyright_year
from .latest import current_status, latest_per_key, latest_with_ties
from .tables import append_log

LOOKBACK_DAYS = 90
INDICATOR = ("company_id", "origin", "place", "type", "value", "signal")


def _indicator(origin: int, place: Column, kind: Column, value: Column, signal: Column) -> list[Column]:
    return [F.col("company_id"), F.lit(origin).alias("origin"), place.cast("string").alias("place"),
            kind.alias("type"), value.alias("value"), signal.alias("signal")]


def newest_texts(snapshots: DataFrame) -> DataFrame:
    """Each company's newest snapshot with its text; texts of older ones are not shuffled."""
    slim = snapshots.select("company_id", "id", "captured_at")
    newest = latest_per_key(slim, ["company_id"], ["captured_at", "id"]).select("company_id", "id")
    return snapshots.join(newest, ["company_id", "id"], "left_semi")


def snapshot_indicators(newest: DataFrame, as_of) -> DataFrame:
    """Copyright year, acquisition phrase and Last-Modified age of each newest page."""
    year_now = F.year(moment(as_of))
    text = F.coalesce(F.col("content_markdown"), F.lit(""))
    modified = F.col("http_last_modified") if "http_last_modified" in newest.columns else F.lit(None).cast("timestamp_ntz")
    facts = newest.select(
        "company_id", copyright_year(text).alias("year"), acquisition_mention(text).alias("deal"),
        days_since(modified, as_of).alias("age"))

    def graded(value: Column, good: Column, fair: Column) -> Column:
        return F.when(value.isNotNull(), F.when(good, "positive").when(fair, "neutral").otherwise("negative"))

    def entry(kind: str, value: Column, signal: Column) -> Column:
        return F.when(signal.isNotNull(), F.struct(
            F.lit(kind).alias("type"), value.alias("value"), signal.alias("signal")))

    year, age = F.col("year"), F.col("age")
    entries = F.array_compact(F.array(
        entry("copyright_year", year.cast("string"), graded(year, year >= year_now - 1, year >= year_now - 3)),
        entry("acquisition_text", F.col("deal"), F.when(F.coalesce(F.col("deal"), F.lit("")) != "", "negative")),
        entry("http_last_modified", F.concat(age.cast("string"), F.lit(" days ago")),
              graded(age, age <= 90, age <= 365)),
    ))
    rows = facts.select("company_id", F.posexplode(entries).alias("place", "e"))
    return rows.select(*_indicator(1, F.col("place"), F.col("e.type"), F.col("e.value"), F.col("e.signal")))


def posting_activity(social_snapshots: DataFrame, as_of, threshold_days: int = 365) -> DataFrame:
    """The newest capture per source with ``is_inactive`` and ``days_since_post``.

    A missing ``latest_post_date`` column is derived from the page text.
    """
    source = social_snapshots
    if "latest_post_date" not in source.columns:
        newest = latest_with_ties(source.select("id", "company_id", "source_url", "captured_at"),
                                  ["company_id", "source_url"], "captured_at").select("company_id", "id")
        source = source.join(newest, ["company_id", "id"], "left_semi").withColumn(
            "latest_post_date", latest_post_date("content_markdown", as_of))
    else:
        source = latest_with_ties(source, ["company_id", "source_url"], "captured_at")
    return source.withColumn("days_since_post", days_since("latest_post_date", as_of)).withColumn(
        "is_inactive", is_inactive("latest_post_date", as_of, threshold_days))


def social_indicators(social_snapshots: DataFrame, as_of) -> DataFrame:
    """One signal per source: negative when nothing was posted for a year, else positive."""
    active = posting_activity(social_snapshots, as_of)
    age = F.concat(F.col("days_since_post").cast("string"), F.lit(" days since last post"))
    quiet = F.col("is_inactive")
    value = F.concat(F.coalesce("source_type", F.lit("unknown")), F.lit(": "),
                     F.coalesce(age, F.when(quiet, "no posting date found").otherwise("active")))
    return active.select(*_indicator(
        2, F.concat_ws("|", "source_type", "source_url"),
        F.when(quiet, "social_media_inactive").otherwise("social_media_active"), value,
        F.when(quiet, "negative").otherwise("positive")))


def _recent_news(news: DataFrame, as_of) -> DataFrame:
    return news.filter((F.col("significance_classification") == "significant")
                       & on_or_after("published_at", as_of, LOOKBACK_DAYS))


def _age(column: str, as_of) -> Column:
    """Days back as sortable text, so that lists run from new to old."""
    return F.lpad(F.date_diff(moment(as_of), F.col(column)).cast("string"), 6, "0")


def _headline() -> Column:
    return F.coalesce("title", F.lit(""))


def _outlet() -> Column:
    return F.coalesce(blank_to_null("source"), F.lit("unknown"))


def news_indicators(news: DataFrame, as_of) -> DataFrame:
    """One signal per recent significant article with positive or negative sentiment."""
    mood = F.col("significance_sentiment")
    hits = _recent_news(news, as_of).filter(mood.isin("positive", "negative"))
    return hits.select(*_indicator(
        3, _age("published_at", as_of), F.concat(F.lit("news_"), mood),
        F.concat(_outlet(), F.lit(": "), _headline()), mood))


def leadership_indicators(changes: DataFrame, as_of) -> DataFrame:
    """Critical departures (negative) and new CEOs (positive) of the last 90 days."""
    kind = F.coalesce("change_type", F.lit(""))
    cutoff = moment(as_of) - F.expr(f"interval {LOOKBACK_DAYS} days")
    left = (F.col("severity") == "critical") & kind.endswith("_departure")
    hits = changes.filter((F.col("detected_at") >= cutoff) & (left | (kind == "new_ceo")))
    value = F.concat(kind, F.lit(": "), F.coalesce(blank_to_null("person_name"), F.lit("Unknown")),
                     F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")"))
    return hits.select(*_indicator(
        4, _age("detected_at", as_of),
        F.when(left, "leadership_departure").otherwise("leadership_new_ceo"), value,
        F.when(left, "negative").otherwise("positive")))


def capture_history(snapshots: DataFrame) -> DataFrame:
    """One row per company from its captures, without their texts: the newest one's id, failures
    among the last five, and the sentiment at both ends of the whole history."""
    mood = strip("baseline_sentiment") if "baseline_sentiment" in snapshots.columns else F.lit(None).cast("string")
    slim = snapshots.select("company_id", "id", "captured_at", "error_message", mood.alias("mood"))
    last = latest_per_key(slim, ["company_id"], ["captured_at", "id"], n=5, rank="place")
    failed = has_text("error_message")
    recent = last.groupBy("company_id").agg(
        F.min_by("id", "place").alias("newest_id"), F.count("*").alias("n"), F.count_if(failed).alias("bad"),
        F.min_by("error_message", F.when(failed, F.col("place"))).alias("error"))
    # Moods in structs, so that a missing one is not skipped.
    end = F.struct("captured_at", "id", "mood")
    ends = slim.groupBy("company_id").agg(F.count("*").alias("captures"), F.min(end).alias("oldest"), F.max(end).alias("newest"))
    return recent.join(ends, "company_id")


def history_indicators(history: DataFrame) -> DataFrame:
    """At least three failed captures among the last five; sentiment turned from positive to negative."""
    value = F.concat(F.col("bad").cast("string"), F.lit("/"), F.col("n").cast("string"),
                     F.lit(" recent snapshots failed: "), F.col("error"))
    turned = ((F.col("captures") >= 2) & (F.col("oldest.mood") == "positive") & (F.col("newest.mood") == "negative"))

    def entry(hit: Column, origin: int, kind: str, text: Column, signal: str) -> Column:
        return F.when(hit, F.struct(F.lit(origin).alias("origin"), F.lit("0").alias("place"), F.lit(kind).alias("type"),
                                    text.alias("value"), F.lit(signal).alias("signal")))

    found = F.array_compact(F.array(
        entry(F.col("bad") >= 3, 5, "error_pattern", value, "negative"),
        entry(turned, 6, "baseline_drift", F.lit("sentiment flipped positive -> negative since first snapshot"), "neutral")))
    return history.select("company_id", F.inline(found))


def error_pattern(snapshots: DataFrame) -> DataFrame:
    """Companies with at least three failed captures among their last five."""
    return history_indicators(capture_history(snapshots)).filter("type = 'error_pattern'")


def baseline_drift(snapshots: DataFrame) -> DataFrame:
    """Companies whose baseline sentiment turned from positive to negative since their first capture."""
    return history_indicators(capture_history(snapshots)).filter("type = 'baseline_drift'")


def count_signals(indicators: DataFrame) -> DataFrame:
    """Signals per company; counted before the shuffle, so a company with very many is no burden."""
    return indicators.groupBy("company_id").agg(
        *[F.count_if(F.col("signal") == s).alias(f"{s}_count") for s in fixed.SIGNALS])


def confidence(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.least(F.lit(1.0), (positive + negative) * 0.4 + neutral * 0.2)


def decide_status(sure: Column, positive: Column, negative: Column, previous: Column) -> Column:
    """Without negative signals the previous status stays (two positive ones lift an
    uncertain one); with them, confidence and majority decide."""
    calm = F.when((previous == "uncertain") & (positive >= 2), "operational").otherwise(
        F.coalesce(previous, F.lit("operational")))
    return (
        F.when(negative == 0, calm)
        .when(sure < 0.4, "uncertain")
        .when(sure >= 0.7, "likely_closed")
        .when(positive > negative, "operational")
        .when(negative > positive, "likely_closed")
        .otherwise("uncertain")
    )


def news_veto(news: DataFrame, as_of) -> DataFrame:
    """Per company the newest article that alone proves a closure, as ``reason``."""
    categories = F.col("matched_categories")
    if dict(news.dtypes)["matched_categories"] == "string":
        categories = F.from_json("matched_categories", "array<string>")
    proof = F.array_sort(F.array_intersect(categories, text_array(fixed.VETO_CATEGORIES)))
    hits = _recent_news(news, as_of).withColumn("__proof", proof).filter(
        (F.col("significance_sentiment") == "negative")
        & (F.col("significance_confidence") >= fixed.VETO_MIN_CONFIDENCE) & (F.size("__proof") > 0))
    reason = F.concat(
        F.lit("news_veto: "), _outlet(), F.lit(" -- "), _headline(), F.lit(" ["), F.array_join("__proof", ", "),
        F.lit(", conf="), F.format_number("significance_confidence", 2), F.lit("]"))
    slim = hits.select("company_id", "published_at", "id", reason.alias("reason"))
    return slim.groupBy("company_id").agg(F.max_by("reason", F.struct("published_at", "id")).alias("reason"))


def analyze_status(
    companies: DataFrame,
    snapshots: DataFrame,
    statuses: DataFrame,
    as_of,
    social_snapshots: DataFrame | None = None,
    news: DataFrame | None = None,
    leadership_changes: DataFrame | None = None,
    history: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New status rows, and all indicator rows behind them.

    Companies set by hand, and those whose newest snapshot has no text, are left out. A status
    row counts its signals; the signals themselves are rows of the second table. ``history`` is the
    ``capture_history`` of the snapshots where it has been made already.
    """
    latest = current_status(statuses.select("id", "company_id", "status", "is_manual_override")).select(
        "company_id", "status", F.coalesce("is_manual_override", F.lit(False)).alias("manual"))
    history = capture_history(snapshots) if history is None else history
    newest = history.select("company_id", F.col("newest_id").alias("id"))
    pages = snapshots.join(newest, ["company_id", "id"], "left_semi").filter(F.coalesce("content_markdown", F.lit("")) != "")
    if "http_last_modified" not in pages.columns:
        pages = pages.withColumn("http_last_modified", F.lit(None).cast("timestamp_ntz"))
    subjects = (
        companies.select(F.col("id").alias("company_id"))
        .join(pages.select("company_id", "http_last_modified"), "company_id")
        .join(latest, "company_id", "left")
        .filter(~F.coalesce("manual", F.lit(False)))
        .select("company_id", "http_last_modified",
                F.when(F.col("status").isin(*fixed.STATUSES), F.col("status")).alias("previous"))
    )
    signals = snapshot_indicators(pages, as_of)
    if social_snapshots is not None:
        signals = signals.unionByName(social_indicators(social_snapshots, as_of))
    if news is not None:
        signals = signals.unionByName(news_indicators(news, as_of))
    if leadership_changes is not None:
        signals = signals.unionByName(leadership_indicators(leadership_changes, as_of))
    signals = signals.unionByName(history_indicators(history))

    counts = count_signals(signals)
    n = {s: F.coalesce(f"{s}_count", F.lit(0)) for s in fixed.SIGNALS}
    scored = subjects.join(counts, "company_id", "left").select(
        "company_id", "previous", "http_last_modified", *[c.alias(s) for s, c in n.items()])
    sure = confidence(F.col("positive"), F.col("negative"), F.col("neutral"))
    decided = scored.withColumn("confidence", sure).withColumn(
        "status", decide_status(F.col("confidence"), F.col("positive"), F.col("negative"), F.col("previous")))
    if news is not None:
        decided = decided.join(news_veto(news, as_of), "company_id", "left")
    else:
        decided = decided.withColumn("reason", F.lit(None).cast("string"))
    forced = F.col("reason").isNotNull()

    rows = decided.select(
        "company_id",
        F.when(forced, "likely_closed").otherwise(F.col("status")).alias("status"),
        F.when(forced, fixed.VETO_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
        moment(as_of).alias("last_checked"), "http_last_modified",
        F.col("reason").alias("status_reason"), F.lit(False).alias("is_manual_override"),
        F.col("positive").alias("positive_count"), F.col("negative").alias("negative_count"),
        F.col("neutral").alias("neutral_count"),
    )
    return rows, signals.join(subjects.select("company_id"), "company_id", "left_semi").select(*INDICATOR)


def manual_override(statuses: DataFrame, requests: DataFrame, as_of, performed_by: str) -> tuple[DataFrame, DataFrame]:
    """The log with the requested statuses (company_id, status) set by hand, and the refused requests."""
    allowed = F.coalesce(F.col("status").isin(*fixed.STATUSES), F.lit(False))
    mark = F.array(F.struct(
        F.lit("manual_override").alias("type"), F.lit("Set by user via dashboard").alias("value"),
        F.lit("neutral").alias("signal")))
    rows = requests.filter(allowed).select(
        "company_id", "status", F.lit(1.0).alias("confidence"), mark.alias("indicators"),
        moment(as_of).alias("last_checked"), F.lit(True).alias("is_manual_override"))
    return append_log(statuses, rows, performed_by), requests.filter(~allowed)


def clear_override(statuses: DataFrame, company_ids: DataFrame, as_of, performed_by: str) -> DataFrame:
    """The log with each company's latest status repeated, no longer set by hand."""
    rows = (
        current_status(statuses).join(company_ids.select("company_id").distinct(), "company_id", "left_semi")
        .drop("id").withColumn("is_manual_override", F.lit(False)).withColumn("last_checked", moment(as_of))
    )
    return append_log(statuses, rows, performed_by)


def status_news_contradictions(companies: DataFrame, statuses: DataFrame, news: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Companies that count as operational despite recent significant negative news."""
    running = current_status(statuses).filter("status = 'operational'").select(
        "company_id", "status", F.col("confidence").alias("status_confidence"),
        F.col("last_checked").alias("status_last_checked"))
    bad = news.filter(
        (F.col("significance_classification") == "significant")
        & (F.col("significance_sentiment") == "negative") & on_or_after("published_at", as_of, days)
    ).select(
        "company_id", F.col("id").alias("news_id"), F.col("title").alias("news_title"),
        F.col("source").alias("news_source"), F.col("content_url").alias("news_url"),
        F.col("published_at").alias("news_published_at"),
        F.col("significance_confidence").alias("news_confidence"), F.col("matched_categories").alias("news_categories"))
    names = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), "homepage_url")
    return bad.join(running, "company_id").join(names, "company_id")


def health_grid(companies: DataFrame, statuses: DataFrame) -> DataFrame:
    """All companies with their latest status, ``unknown`` where there is none."""
    wanted = [c for c in ("confidence", "indicators", "status_reason") if c in statuses.columns]
    latest = current_status(statuses.select("id", "company_id", "status", "is_manual_override", *wanted)).drop("id")
    return companies.select(F.col("id").alias("company_id"), "name").join(latest, "company_id", "left").select(
        "company_id", "name", F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("is_manual_override", F.lit(False)).alias("is_manual_override"), *wanted)
