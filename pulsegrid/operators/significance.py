"""Keyword significance of documents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import let, once
from ..functions.keywords import Term, default_terms, keyword_hits, significance

VERDICT_COLUMNS = (
    "significance_classification", "significance_sentiment", "significance_confidence",
    "matched_keywords", "matched_categories", "significance_notes", "evidence_snippets",
)


def lexicon_frame(spark: SparkSession, terms: Sequence[Term] | None = None) -> DataFrame:
    """The lexicon as a table."""
    rows = [(*t, i) for i, t in enumerate(terms or default_terms())]
    return spark.createDataFrame(rows, "keyword string, category string, polarity string, position int")


def keyword_matches(
    docs: DataFrame, ids: Sequence[str], text: str = "text", terms: Sequence[Term] | None = None, **options
) -> DataFrame:
    """One row per hit: ids, keyword, category, polarity, position, context, negation, false positive."""
    hits = keyword_hits(text, terms or default_terms(), **options)
    return docs.select(*ids, F.explode(hits).alias("hit")).select(*ids, "hit.*")


def verdict(text: str | Column, level: str | Column, terms: Sequence[Term], **options) -> Column:
    """``significance`` of a text's hits, with the stored column names."""
    fields = ("classification", "sentiment", "confidence", "keywords", "categories", "notes", "evidence")
    found = significance(keyword_hits(text, terms, **options), level)
    return let(found, lambda v: F.struct(*[v[f].alias(c) for f, c in zip(fields, VERDICT_COLUMNS)]))


def classify_significance(
    docs: DataFrame,
    text: str = "text",
    magnitude: str | Column = "minor",
    exclude_categories: Iterable[str] = (),
    terms: Sequence[Term] | None = None,
    **options,
) -> DataFrame:
    """``docs`` with the keyword verdict on ``text``; no row leaves its partition.

    ``magnitude`` is a level for all rows, or a Column.
    """
    level = F.lit(magnitude) if isinstance(magnitude, str) else magnitude
    dropped = set(exclude_categories)
    lexicon = default_terms(dropped) if terms is None else [
        t for t in terms if not (t.polarity == "negative" and t.category in dropped)]
    return docs.select("*", once(verdict(text, level, lexicon, **options)))


def is_obvious(decisive: Sequence[str] = fixed.DECISIVE_CATEGORIES) -> Column:
    label, sure = F.col("significance_classification"), F.col("significance_confidence")
    noise = (label == "insignificant") & (F.col("change_magnitude") == "minor") & (sure >= 0.85)
    known = F.arrays_overlap("matched_categories", F.array(*[F.lit(c) for c in decisive]))
    return F.coalesce(noise | ((label == "significant") & (sure >= 0.90) & known), F.lit(False))


def needs_review(results: DataFrame, decisive: Sequence[str] = fixed.DECISIVE_CATEGORIES) -> DataFrame:
    """Rows a second classifier should see: neither plain noise nor a decisive event."""
    return results.filter(~is_obvious(decisive))


def overlay_verdicts(results: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results with a second classifier's verdict (one row per key) in place of the keyword
    verdict, unless it reports an error. Fields it leaves out stay."""
    valid = verdicts.filter(F.coalesce("error", F.lit("")) == "").select(
        *keys, *[F.col(c).alias(f"__{c}") for c in ("classification", "sentiment", "confidence", "reasoning")])
    joined = results.join(valid, list(keys), "left")
    over = {
        "significance_classification": F.col("__classification"), "significance_sentiment": F.col("__sentiment"),
        "significance_confidence": F.col("__confidence"),
        "significance_notes": F.nullif(F.col("__reasoning"), F.lit("")),
    }
    return joined.select(*[F.coalesce(over[c], F.col(c)).alias(c) if c in over else F.col(c) for c in results.columns])
