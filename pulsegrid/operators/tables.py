"""Writes as table-to-table transformations: insert, upsert, patch, delete, merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import moment
from ..session import cut_lineage

# Unique keys of the tables that skip known rows on insert.
NATURAL_KEYS = {
    "change_records": ("company_id", "snapshot_id_old", "snapshot_id_new"),
    "social_media_links": ("company_id", "profile_url"),
    "blog_links": ("company_id", "blog_url"),
    "company_logos": ("company_id", "perceptual_hash"),
    "news_articles": ("content_url",),
    "leadership_mentions": ("company_id", "person_name", "title_context"),
    "company_leadership": ("company_id", "linkedin_profile_url"),
}

# Tables whose rows belong to a company.
CHILD_TABLES = (
    "snapshots", "change_records", "company_statuses", "social_media_links", "blog_links",
    "news_articles", "company_logos", "company_leadership", "leadership_changes",
    "social_media_snapshots", "social_media_change_records", "leadership_mentions",
    "linkedin_snapshots",
)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def new_rows(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Incoming rows whose key ``target`` lacks; of equal keys the first."""
    fresh = incoming.join(target.select(*keys).distinct(), list(keys), "left_anti")
    return first_per_key(fresh, keys, order)


def with_ids(target: DataFrame, rows: DataFrame, kept: bool = False) -> DataFrame:
    """``rows`` with ids of their own above all ids of ``target``, without gaps.

    The rows are written to the shared folder first (unless they are ``kept`` there already), so that their
    partitions, and with them the ids, stay the same however often they are read. A row's id counts the rows of the partitions
    before its own (one number for each partition is added up) and its place in it.
    """
    lasting = (rows.drop("id") if kept else cut_lineage(rows.drop("id"))).withColumn("__row", F.monotonically_increasing_id())
    part, place = F.shiftright("__row", 33), F.col("__row").bitwiseAND((1 << 33) - 1)
    placed = lasting.withColumn("__part", part).withColumn("__place", place)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top")).first()["top"]
    kind = target.schema["id"].dataType
    return placed.join(offsets, "__part").select(
        (F.lit(top) + F.col("__before") + F.col("__place") + 1).cast(kind).alias("id"), *[c for c in rows.columns if c != "id"])


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``target`` plus the new rows; rows that come without an id get one."""
    fresh = new_rows(target, incoming, keys, order)
    if "id" in target.columns and "id" not in fresh.columns:
        fresh = with_ids(target, fresh)
    return target.unionByName(fresh, allowMissingColumns=True)


def append_new(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column], path: str) -> None:
    """Append the new rows to the Parquet table at ``path``. Running it again adds nothing."""
    new_rows(target, incoming, keys, order).write.mode("append").parquet(path)


def upsert_companies(target: DataFrame, incoming: DataFrame, as_of, order: Sequence[str] = ("id",)) -> DataFrame:
    """Match on name and homepage (NULL equals NULL): refresh the sheet and time, else insert."""
    newest = first_per_key(incoming, ["name", "homepage_url"], [F.col(c).desc() for c in order])
    patch = newest.select(
        F.col("name").alias("__name"), F.col("homepage_url").alias("__url"),
        F.col("source_sheet").alias("__sheet"),
    )
    same = (F.col("name") == F.col("__name")) & F.col("homepage_url").eqNullSafe(F.col("__url"))
    hit = F.col("__name").isNotNull()
    updated = target.join(patch, same, "left").select(*[
        F.when(hit, F.col("__sheet")).otherwise(F.col(c)).alias(c) if c == "source_sheet"
        else F.when(hit, moment(as_of)).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.col(c)
        for c in target.columns
    ])
    known = target.select(F.col("name").alias("__name"), F.col("homepage_url").alias("__url"))
    added = newest.join(known, same, "left_anti").withColumn("updated_at", moment(as_of))
    return updated.unionByName(added, allowMissingColumns=True)


def append_log(target: DataFrame, rows: DataFrame, performed_by: str, kept: bool = False) -> DataFrame:
    """``target`` plus stamped rows (statuses, leadership changes and errors are only appended).

    "Latest" is by id in these tables, so every appended row gets an id above those there are. ``kept``
    rows have had their lineage cut and aren't written again for that.
    """
    if "id" in target.columns:
        rows = with_ids(target, rows, kept)
    return target.unionByName(rows.withColumn("performed_by", F.lit(performed_by)), allowMissingColumns=True)


def update_by_key(target: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Set ``columns`` from ``patch`` (one row per key) where its key matches."""
    marked = patch.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__v_{c}") for c in columns],
        F.lit(True).alias("__hit"),
    )
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    joined = target.join(marked, on, "left")
    missing = [c for c in columns if c not in target.columns]
    return joined.select(
        *[F.when(F.col("__hit"), F.col(f"__v_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in target.columns],
        *[F.col(f"__v_{c}").alias(c) for c in missing],
    )


def delete_cascade(tables: Mapping[str, DataFrame], company_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given companies and the rows that belong to them."""
    gone = company_ids.select(F.col(company_ids.columns[0]).alias("__gone")).distinct()
    owner = {name: "id" if name == "companies" else "company_id" for name in tables}
    return {
        name: df.join(gone, df[owner[name]] == gone["__gone"], "left_anti")
        if owner[name] in df.columns else df
        for name, df in tables.items()
    }


def delete_row(target: DataFrame, row_id: int, company_id: int, entity: str, as_of, performed_by: str) -> tuple[DataFrame, DataFrame]:
    """``target`` without one row of one company, and the audit rows of what went."""
    hit = (F.col("id") == row_id) & (F.col("company_id") == company_id)
    audit = target.filter(hit).select(
        F.lit(entity).alias("entity_type"), F.col("id").alias("entity_id"),
        F.lit("manual_delete").alias("error_type"),
        F.concat(F.lit(f"{entity} "), F.col("id").cast("string"), F.lit(" removed from company "),
                 F.col("company_id").cast("string")).alias("error_message"),
        F.lit(0).alias("retry_count"), moment(as_of).alias("occurred_at"),
        F.lit(performed_by).alias("performed_by"),
    )
    return target.filter(~F.coalesce(hit, F.lit(False))), audit


def backfill_operator(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Every table with ``performed_by`` filled in where it is NULL."""
    return {
        key: df.fillna({"performed_by": name}) if "performed_by" in df.columns
        else df.withColumn("performed_by", F.lit(name))
        for key, df in tables.items()
    }
