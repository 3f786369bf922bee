"""Change detection between versions of a page."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import blank_to_null, empty_strings, has_text, moment, on_or_after, strip
from ..functions.keywords import Term
from ..functions.text import magnitude
from .latest import earliest_without_baseline, snapshot_pairs, without_significance
from .significance import VERDICT_COLUMNS, classify_significance
from .tables import update_by_key
from .text_diff import line_added, line_similarity


@dataclass(frozen=True)
class Policy:
    """How one kind of page is compared."""

    keys: tuple[str, ...] = ("company_id",)
    empty_checksum_is_missing: bool = True
    follow_errors: bool = True  # an error that appears or differs is a change
    additions_only: bool = False  # nothing added: no verdict
    excluded: tuple[str, ...] = fixed.SELF_REPORT_EXCLUDED
    carried: tuple[str, ...] = field(default=())


HOMEPAGE = Policy()
SOCIAL = Policy(
    keys=("company_id", "source_url"), empty_checksum_is_missing=False, follow_errors=False,
    additions_only=True, carried=("source_type",),
)


def compare_checksums(pairs: DataFrame, policy: Policy = HOMEPAGE) -> DataFrame:
    """Pairs with ``has_changed``, and ``outcome``: unchanged, replaced (major without
    looking at the text) or compare (the texts decide)."""
    old, new = F.col("old_content_checksum"), F.col("new_content_checksum")
    if policy.empty_checksum_is_missing:
        old, new = blank_to_null(old), blank_to_null(new)
    else:
        old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    outcome = (
        F.when(old.eqNullSafe(new), "unchanged")
        .when(old.isNull() | new.isNull(), "replaced")
        .when(F.col("old_has_content") & F.col("new_has_content"), "compare")
        .otherwise("replaced")
    )
    return (
        pairs.withColumn("checksum_old", F.coalesce(old, F.lit("")))
        .withColumn("checksum_new", F.coalesce(new, F.lit("")))
        .withColumn("outcome", outcome)
        .withColumn("has_changed", F.col("outcome") != "unchanged")
    )


def detect_changes(pairs: DataFrame, similarity: Column, policy: Policy = HOMEPAGE) -> DataFrame:
    """Pairs with ``has_changed``, ``similarity`` and ``change_magnitude``; ``similarity`` is
    looked at only where both texts are there and differ."""
    judged = compare_checksums(pairs, policy)
    score = F.when(F.col("outcome") == "unchanged", 1.0).when(F.col("outcome") == "replaced", 0.0).otherwise(similarity)
    level = F.when(F.col("outcome") == "unchanged", "minor").when(
        F.col("outcome") == "replaced", "major").otherwise(magnitude("similarity"))
    return judged.withColumn("similarity", score).withColumn("change_magnitude", level)


def error_transition(old_error: Column, new_error: Column, old_checksum: Column, new_checksum: Column) -> Column:
    """What happened to the capture itself: it broke, recovered, or failed otherwise than before."""
    before, after = old_checksum.isNotNull(), new_checksum.isNotNull()
    old_text, new_text = strip(F.coalesce(old_error, F.lit(""))), strip(F.coalesce(new_error, F.lit("")))
    cause = F.coalesce(blank_to_null(new_error), F.lit("unknown"))
    return (
        F.when(before & ~after, F.concat(F.lit("Content recovery -> error: "), cause))
        .when(~before & after, "Site recovered from previous error")
        .when(~before & ~after & (old_text != new_text) & (new_text != ""),
              F.concat(F.lit("Error state changed: "), new_text))
    )


def error_transitions(pairs: DataFrame) -> DataFrame:
    """Pairs with a ``transition`` text, NULL when the capture state stayed."""
    return pairs.withColumn("transition", error_transition(
        F.col("old_error_message"), F.col("new_error_message"),
        blank_to_null("old_content_checksum"), blank_to_null("new_content_checksum")))


def _constant_verdict(label: Column, confidence: Column, notes: Column) -> list[Column]:
    values = (label, F.when(label.isNotNull(), "neutral"), confidence, empty_strings(), empty_strings(), notes,
              empty_strings())
    return [v.alias(c) for v, c in zip(values, VERDICT_COLUMNS)]


def with_texts(pairs: DataFrame, snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs with ``old_text`` and ``new_text``.

    Texts belong to a company and an id. The page texts are read once and only the wanted ones
    are shuffled on, as the narrow list of wanted ids meets them in a join Spark sizes itself.
    """
    columns = pairs.columns
    wanted = pairs.select("company_id", F.struct(*columns).alias("pair"), F.explode(F.array(
        F.struct(F.col("old_id").alias("__id"), F.lit(0).alias("side")),
        F.struct(F.col("new_id").alias("__id"), F.lit(1).alias("side")))).alias("w")).select("company_id", "pair", "w.*")
    texts = snapshots.select("company_id", F.col("id").alias("__id"), F.col("content_markdown").alias("__text"))
    met = wanted.join(texts, ["company_id", "__id"], "left")
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("__text")))
    grouped = met.groupBy(*[F.col(f"pair.{k}").alias(k) for k in keys]).agg(
        F.first("pair").alias("pair"), side(0).alias("old_text"), side(1).alias("new_text"))
    return grouped.select("pair.*", "old_text", "new_text")


def latest_pairs(snapshots: DataFrame, exclude: DataFrame | None = None, policy: Policy = HOMEPAGE) -> DataFrame:
    """The newest two versions of each key, without texts, as ``change_records`` takes them."""
    slim = snapshots.select(
        *policy.keys, "id", "captured_at", "content_checksum", "error_message", *policy.carried,
        F.col("content_markdown").isNotNull().alias("has_content"))
    if exclude is not None:
        slim = slim.join(exclude.select("company_id").distinct(), "company_id", "left_anti")
    return snapshot_pairs(slim, list(policy.keys), "latest", carry=("content_checksum", "error_message", "has_content", *policy.carried))


def change_records(
    snapshots: DataFrame,
    as_of,
    exclude: DataFrame | None = None,
    policy: Policy = HOMEPAGE,
    terms: Sequence[Term] | None = None,
    pairing: str = "latest",
    pairs: DataFrame | None = None,
    difference: Callable[[str, str], Column] = line_added,
) -> DataFrame:
    """One change record per key: its newest two versions compared and classified.

    Versions are paired on ids and checksums alone; page text is fetched for changed
    pairs only, and only those reach the text comparison. ``difference`` says what was added:
    ``line_added``, or ``line_added_in_order`` where moved and repeated lines are to count.
    """
    keys = list(policy.keys)
    source = snapshots
    if exclude is not None:
        source = source.join(exclude.select("company_id").distinct(), "company_id", "left_anti")
    slim = source.select(
        *keys, "id", "captured_at", "content_checksum", "error_message", *policy.carried,
        F.col("content_markdown").isNotNull().alias("has_content"))
    if pairs is None:
        pairs = snapshot_pairs(
            slim, keys, pairing, carry=("content_checksum", "error_message", "has_content", *policy.carried))
    judged = error_transitions(compare_checksums(pairs, policy))
    failed = has_text("new_error_message") if policy.follow_errors else F.lit(False)
    if policy.follow_errors:
        judged = judged.withColumn("has_changed", F.col("has_changed") | F.col("transition").isNotNull())
    read_text = (F.col("outcome") == "compare") | (F.col("has_changed") & ~failed)
    head = [
        *[F.col(k) for k in keys], *[F.col(f"new_{c}").alias(c) for c in policy.carried],
        F.col("old_id").alias("snapshot_id_old"), F.col("new_id").alias("snapshot_id_new"),
        "checksum_old", "checksum_new", "has_changed",
    ]
    stamp = moment(as_of).alias("detected_at")
    error_note = F.concat(F.lit("Snapshot capture failed: "), strip("new_error_message"))

    settled = judged.filter(~read_text)
    broken = F.col("has_changed") & failed
    quiet = F.lit("insignificant") if not policy.additions_only else F.lit(None).cast("string")
    plain = settled.select(
        *head, F.when(F.col("outcome") == "replaced", "major").otherwise("minor").alias("change_magnitude"), stamp,
        *_constant_verdict(
            F.when(broken, "uncertain").otherwise(quiet),
            F.when(broken, 0.0).when(quiet.isNotNull(), 1.0),
            F.when(broken, error_note).when(quiet.isNotNull(), "No content change detected.")),
    )

    pair_keys = keys if pairing == "latest" else [*keys, "new_id"]
    texts = with_texts(judged.filter(read_text), source, pair_keys)
    score, added = line_similarity("old_text", "new_text"), difference("old_text", "new_text")
    subject = added if policy.additions_only else F.coalesce(
        blank_to_null(strip(added)), blank_to_null(strip("new_text")), strip("old_text"))
    measured = texts.withColumn(
        "change_magnitude",
        F.when(F.col("outcome") == "compare", magnitude(score)).when(F.col("outcome") == "replaced", "major").otherwise("minor"),
    ).withColumn("__subject", F.coalesce(subject, F.lit("")))
    scored = classify_significance(measured, "__subject", F.col("change_magnitude"), policy.excluded, terms)
    blank = ~has_text("__subject")
    empty_label = F.lit(None).cast("string") if policy.additions_only else F.lit("insignificant")
    constants = dict(zip(VERDICT_COLUMNS, _constant_verdict(
        F.when(failed, "uncertain").otherwise(empty_label),
        F.when(failed, 0.0).when(empty_label.isNotNull(), 0.5),
        F.when(failed, error_note).when(empty_label.isNotNull(), "No analyzable content in diff."))))
    full = scored.select(
        *head, "change_magnitude", stamp,
        *[F.when(failed | blank, constants[c]).otherwise(F.col(c)).alias(c) for c in VERDICT_COLUMNS])
    return plain.unionByName(full)


def social_change_records(social_snapshots: DataFrame, as_of, **options) -> DataFrame:
    """The same per company and source page, judged by what was added alone."""
    return change_records(social_snapshots, as_of, policy=SOCIAL, **options)


def backfill_significance(
    changes: DataFrame, snapshots: DataFrame, terms: Sequence[Term] | None = None, dry_run: bool = False,
) -> DataFrame:
    """Classify changed rows that have no verdict yet, by their added lines.

    Returns the patched table, or with ``dry_run`` only the new verdicts. Rows whose new
    version has no text, or with nothing added, stay as they are.
    """
    pending = without_significance(changes).select(
        "id", "company_id", F.col("snapshot_id_old").alias("old_id"), F.col("snapshot_id_new").alias("new_id"), "change_magnitude")
    texts = with_texts(pending, snapshots, ["id"]).filter(F.coalesce(F.col("new_text"), F.lit("")) != "")
    diffed = texts.withColumn("__subject", line_added("old_text", "new_text")).filter(has_text("__subject"))
    judged = classify_significance(
        diffed, "__subject", F.coalesce("change_magnitude", F.lit("minor")), fixed.SELF_REPORT_EXCLUDED, terms
    ).select("id", *VERDICT_COLUMNS)
    return judged if dry_run else update_by_key(changes, judged, ["id"], VERDICT_COLUMNS)


BASELINE_COLUMNS = (
    "baseline_classification", "baseline_sentiment", "baseline_confidence", "baseline_keywords",
    "baseline_categories", "baseline_notes",
)


def baseline(snapshots: DataFrame, terms: Sequence[Term] | None = None) -> DataFrame:
    """The verdict on each company's first page text, where it has no baseline yet."""
    first = earliest_without_baseline(snapshots).filter(F.col("content_markdown") != "").select(
        "id", "company_id", "content_markdown")
    judged = classify_significance(first, "content_markdown", "minor", fixed.SELF_REPORT_EXCLUDED, terms)
    return judged.select("id", "company_id", *[
        F.col(c).alias(b) for c, b in zip(VERDICT_COLUMNS, BASELINE_COLUMNS)])


def store_baseline(snapshots: DataFrame, baselines: DataFrame) -> DataFrame:
    return update_by_key(snapshots, baselines, ["id"], BASELINE_COLUMNS)


def significant_changes(changes: DataFrame, companies: DataFrame, as_of, days: int = 180, sentiment: str | None = None, min_confidence: float = 0.5) -> DataFrame:
    """Recent significant changes with their company."""
    hits = changes.filter(
        (F.col("significance_classification") == "significant")
        & (F.col("significance_confidence") >= min_confidence) & on_or_after("detected_at", as_of, days))
    if sentiment:
        hits = hits.filter(F.col("significance_sentiment") == sentiment)
    return with_company(hits, companies)


def uncertain_changes(changes: DataFrame, companies: DataFrame) -> DataFrame:
    """Changes whose meaning is open, with their company."""
    return with_company(changes.filter(F.col("significance_classification") == "uncertain"), companies)


def with_company(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows joined to their company's name and homepage."""
    names = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"),
        F.col("homepage_url").alias("company_homepage"))
    return rows.join(names, "company_id")


def _recent(changes: DataFrame, as_of, days: int) -> DataFrame:
    return changes.filter(F.col("has_changed") & on_or_after("detected_at", as_of, days))


def active_companies(changes: DataFrame, companies: DataFrame, as_of, days: int = 180) -> DataFrame:
    """Companies with a change in the window, with every moment of change."""
    moments = _recent(changes, as_of, days).select("company_id", "detected_at").distinct()
    return with_company(moments, companies).select(
        "company_name", F.col("company_homepage").alias("homepage_url"), "detected_at").distinct()


def inactive_companies(changes: DataFrame, companies: DataFrame, as_of, days: int = 180) -> DataFrame:
    """Companies without a change in the window."""
    seen = _recent(changes, as_of, days).select(F.col("company_id").alias("id")).distinct()
    return companies.join(seen, "id", "left_anti").select("id", "name", "homepage_url")
