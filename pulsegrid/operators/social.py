"""Digests of social activity for a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import strip
from .status import posting_activity


def social_digest(social_snapshots: DataFrame, as_of) -> DataFrame:
    """A row for each source of a company: ``company_id, source_type, source_url, id, last_post, state, content``.

    ``content`` is the whole page text without blanks around it.
    """
    active = posting_activity(social_snapshots, as_of)
    days, quiet = F.col("days_since_post"), F.col("is_inactive")
    age = F.concat(days.cast("string"), F.lit(" days"))
    state = (
        F.when(~quiet, "ACTIVE").when(days.isNotNull(), F.concat(F.lit("INACTIVE ("), age, F.lit(" since last post)")))
        .otherwise("INACTIVE (no posting date found)")
    )
    date = F.coalesce(F.col("latest_post_date").cast("string"), F.lit("None detected"))
    date = F.when(~quiet & days.isNotNull(), F.concat(date, F.lit(" ("), age, F.lit(" ago)"))).otherwise(date)
    return active.select(
        "company_id", "source_type", "source_url", "id", date.alias("last_post"), state.alias("state"),
        strip(F.coalesce("content_markdown", F.lit(""))).alias("content"))
