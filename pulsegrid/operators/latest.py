"""Latest-per-key, version pairs, exclusion sets, paging.

None of these gathers a whole key in one task. ``row_number() <= n`` filters are cut
down before the shuffle (Spark's window group limit), group extremes come from partial
aggregates, and consecutive versions are paired inside time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import moment


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """The newest ``n`` rows per key, exactly one row per rank (``order`` names are descending)."""
    ordering = [F.col(o).desc() if isinstance(o, str) else o for o in order]
    place = rank or "__place"
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)))
    kept = ranked.filter(F.col(place) <= n)
    return kept if rank else kept.drop(place)


def latest_with_ties(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows equal to their key's newest ``order`` value."""
    top = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(top, [*keys, order], "left_semi")


def snapshot_pairs(
    snapshots: DataFrame,
    keys: Sequence[str] = ("company_id",),
    mode: str = "latest",
    carry: Sequence[str] = ("content_checksum", "error_message"),
    order: Sequence[str] = ("captured_at", "id"),
    bucket: str = "day",
) -> DataFrame:
    """Old and new version side by side: ``<keys>, old_<c>, new_<c>`` for id, order and carried columns.

    ``latest`` pairs the newest two per key. ``all`` pairs every version with the one
    before it; a key's history is cut into time buckets and only the first version of a
    bucket looks outside it, to the last version of the bucket before.
    """
    columns = list(dict.fromkeys(["id", *order, *carry]))
    narrow = snapshots.select(*keys, *columns)

    def side(prefix: str, source: Column) -> list[Column]:
        return [source[c].alias(f"{prefix}_{c}") for c in columns]

    if mode == "latest":
        two = latest_per_key(narrow, keys, order, n=2, rank="__place")
        both = two.groupBy(*keys).agg(
            *[F.max(F.when(F.col("__place") == p, F.struct(*columns))).alias(name)
              for p, name in ((1, "__new"), (2, "__old"))]
        ).filter(F.col("__old").isNotNull())
    elif mode == "all":
        row = F.struct(*columns)
        timed = narrow.select(
            *keys, F.date_trunc(bucket, F.col(order[0])).alias("__bucket"), row.alias("__new"),
            F.struct(*order).alias("__at"),
        )
        inside = timed.withColumn(
            "__old", F.lag("__new").over(Window.partitionBy(*keys, "__bucket").orderBy("__at")))
        ends = timed.groupBy(*keys, "__bucket").agg(F.max_by("__new", "__at").alias("__last"))
        carried = ends.withColumn(
            "__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))
        ).select(*keys, "__bucket", "__before")
        firsts = inside.filter(F.col("__old").isNull()).drop("__old")
        stitched = firsts.join(carried, [*keys, "__bucket"]).withColumn("__old", F.col("__before"))
        both = (
            inside.filter(F.col("__old").isNotNull()).select(*keys, "__old", "__new")
            .unionByName(stitched.filter(F.col("__old").isNotNull()).select(*keys, "__old", "__new"))
        )
    else:
        raise ValueError(f"mode must be 'latest' or 'all', not {mode!r}")
    return both.select(*keys, *side("old", F.col("__old")), *side("new", F.col("__new")))


def earliest_without_baseline(snapshots: DataFrame) -> DataFrame:
    """The first snapshot with content per company that has no baseline yet; ties stay."""
    open_ = F.col("baseline_classification").isNull() & F.col("content_markdown").isNotNull()
    first = snapshots.groupBy("company_id").agg(
        F.max(F.col("baseline_classification").isNotNull()).alias("__done"),
        F.min(F.when(open_, F.col("captured_at"))).alias("captured_at"),
    ).filter(~F.col("__done")).select("company_id", "captured_at")
    return snapshots.filter(open_).join(first, ["company_id", "captured_at"], "left_semi")


def current_status(statuses: DataFrame) -> DataFrame:
    """Each company's latest status row (largest id)."""
    return latest_per_key(statuses, ["company_id"], ["id"])


def _closed_by_hand() -> Column:
    return (F.col("status") == "likely_closed") & F.col("is_manual_override")


def manually_closed(statuses: DataFrame) -> DataFrame:
    """Companies set to closed by hand."""
    return current_status(statuses).filter(_closed_by_hand()).select("company_id")


def skippable(statuses: DataFrame) -> DataFrame:
    """Companies closed by hand or without a homepage."""
    skip = _closed_by_hand() | (F.col("status") == "no_homepage_url")
    return current_status(statuses).filter(skip).select("company_id")


def exclude(df: DataFrame, ids: DataFrame, key: str = "company_id") -> tuple[DataFrame, DataFrame]:
    """Rows of companies not excluded, and a one-row report of how many companies went."""
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    kept = df.join(gone, key, "left_anti")
    report = (
        df.select(key).distinct().join(gone.withColumn("__gone", F.lit(True)), key, "left")
        .agg(F.count("*").alias("total"), F.count("__gone").alias("excluded"))
        .withColumn("remaining", F.col("total") - F.col("excluded"))
    )
    return kept, report


def captured_since(snapshots: DataFrame, since) -> DataFrame:
    """Companies with a snapshot on or after a moment."""
    return snapshots.filter(F.col("captured_at") >= moment(since)).select("company_id").distinct()


def stale_logos(companies: DataFrame, logos: DataFrame, as_of, days: int = 30, force: bool = False) -> DataFrame:
    """Companies with no logo, or with the latest one older than ``days``."""
    if force:
        return companies
    newest = logos.groupBy("company_id").agg(F.max("extracted_at").alias("__logo_at"))
    joined = companies.join(newest, companies["id"] == newest["company_id"], "left").drop(newest["company_id"])
    cutoff = moment(as_of) - F.expr(f"interval {int(days)} days")
    return joined.filter(F.col("__logo_at").isNull() | (F.col("__logo_at") < cutoff)).drop("__logo_at")


def without_significance(changes: DataFrame) -> DataFrame:
    """Changed rows not classified yet."""
    return changes.filter(F.col("has_changed") & F.col("significance_classification").isNull())


def news_between(news: DataFrame, start, end, company_id: int | None = None) -> DataFrame:
    """Articles published from ``start`` to ``end``, both included."""
    hits = news.filter(F.col("published_at").between(moment(start), moment(end)))
    return hits if company_id is None else hits.filter(F.col("company_id") == company_id)


def multi_version_keys(df: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Keys with at least two snapshots."""
    return df.groupBy(*keys).agg(F.count("*").alias("versions")).filter("versions >= 2")


def snapshot_profile(snapshots: DataFrame) -> DataFrame:
    """Per company: number of snapshots, oldest date, whether a baseline exists."""
    return snapshots.groupBy("company_id").agg(
        F.count("*").alias("snapshot_count"), F.min("captured_at").alias("oldest"),
        F.max(F.col("baseline_classification").isNotNull()).alias("has_baseline"),
    )


def search_window(snapshots: DataFrame, companies: DataFrame, as_of, days: int = 90) -> DataFrame:
    """News search range: from the oldest snapshot (else ``days`` back) to ``as_of``."""
    oldest = snapshots.groupBy("company_id").agg(F.min("captured_at").alias("__oldest"))
    today = F.to_date(moment(as_of))
    return companies.join(oldest, companies["id"] == oldest["company_id"], "left").select(
        companies["id"].alias("company_id"),
        F.coalesce(F.to_date("__oldest"), F.date_sub(today, days)).alias("after_date"),
        today.alias("before_date"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def page(df: DataFrame, order: Sequence[str | Column], number: int = 1, per_page: int = 50) -> DataFrame:
    """One page of ``df``; ``order`` must end in a unique column."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, number: int = 1, per_page: int = 50) -> DataFrame:
    """Total rows and pages behind ``page``."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page))
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(per_page).alias("per_page"),
        pages.cast("bigint").alias("total_pages"),
    )


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


SORT_KEYS = {
    "name": "name", "status": "status", "last_change": "last_change_date",
    "social_count": "social_count", "news_count": "news_count",
}


def sort_columns(key: str = "name", direction: str = "asc", tie: str = "id") -> list[Column]:
    """Order for a company list; an unknown key sorts by name, ties by ``tie``."""
    chosen = F.col(SORT_KEYS.get(key, "name"))
    return [chosen.desc() if direction == "desc" else chosen.asc(), F.col(tie).asc()]


def sort_by(df: DataFrame, key: str = "name", direction: str = "asc", tie: str = "id") -> DataFrame:
    return df.orderBy(*sort_columns(key, direction, tie))
