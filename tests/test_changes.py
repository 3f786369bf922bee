from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import changes as I
from pulsegrid.operators.latest import snapshot_pairs
from pulsegrid.operators.text_diff import line_added, line_similarity

SCHEMA = "id long, company_id long, captured_at timestamp_ntz, content_markdown string, content_checksum string, error_message string"
T0 = dt.datetime(2024, 1, 1)
AS_OF = "2024-02-01 00:00:00"


def snaps(spark, *versions):
    """Two versions per company: (text, checksum, error) old and new."""
    data = []
    for company, (old, new) in enumerate(versions, 1):
        for i, (text, checksum, error) in enumerate((old, new)):
            data.append((company * 10 + i, company, T0 + dt.timedelta(days=i), text, checksum, error))
    return spark.createDataFrame(data, SCHEMA)


def test_every_kind_of_change(spark):
    body = "\n".join(f"line {i} of the page" for i in range(30))
    df = snaps(
        spark,
        ((None, None, "a"), (None, None, "a")),          # 1 failed twice alike
        ((None, None, "a"), (None, None, "b")),          # 2 failed otherwise
        (("x", "1", None), (None, None, "boom")),        # 3 broke
        ((None, None, "boom"), ("hello", "1", None)),    # 4 recovered
        (("x", "1", None), ("x", "1", None)),            # 5 same
        ((body, "1", None), (body + "\nbankruptcy and shutting down", "2", None)),  # 6 small addition
        (("aaaa", "1", None), ("zzzz", "2", None)),      # 7 all new
        (("x", "", None), ("y", "", "e")),               # 8 empty checksums are missing ones
    )
    got = {r.company_id: r for r in I.change_records(df, AS_OF).collect()}
    facts = {k: (r.has_changed, r.change_magnitude, r.significance_classification, r.significance_confidence) for k, r in got.items()}
    assert facts == {
        1: (False, "minor", "insignificant", 1.0), 2: (True, "minor", "uncertain", 0.0), 3: (True, "major", "uncertain", 0.0),
        4: (True, "major", "insignificant", 0.75), 5: (False, "minor", "insignificant", 1.0),
        6: (True, "minor", "uncertain", 0.5), 7: (True, "major", "insignificant", 0.75), 8: (True, "minor", "uncertain", 0.0),
    }
    assert got[3].significance_notes == "Snapshot capture failed: boom" and got[6].matched_keywords == ["shutting down"]


def test_social_policy(spark):
    df = snaps(spark, (("x", "", None), ("y", "", "e")), (("a", "1", None), (None, None, "e")), (("one\ntwo", "1", None), ("one", "2", None)))
    df = df.withColumn("source_url", F.lit("u")).withColumn("source_type", F.lit("blog"))
    got = {r.company_id: (r.has_changed, r.change_magnitude, r.significance_classification) for r in I.social_change_records(df, AS_OF).collect()}
    assert got == {1: (False, "minor", None), 2: (True, "major", None), 3: (True, "moderate", None)}


def test_one_record_per_pair_and_exclusion(spark):
    df = snaps(spark, (("x", "1", None), ("y", "2", None)), (("x", "1", None), ("y", "2", None)))
    gone = spark.createDataFrame([(2,)], "company_id long")
    assert [r.company_id for r in I.change_records(df, AS_OF, exclude=gone).collect()] == [1]


def test_pairs_on_ties_and_across_buckets(spark):
    rng = random.Random(3)
    data = [(i, i % 3, T0 + dt.timedelta(hours=rng.randint(0, 100)), None, str(i), None) for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    expected = set()
    for c in range(3):
        own = sorted((d for d in data if d[1] == c), key=lambda d: (d[2], d[0]))
        expected |= {(c, a[0], b[0]) for a, b in zip(own, own[1:])}
    for bucket in ("day", "hour", "year"):
        pairs = snapshot_pairs(df, mode="all", bucket=bucket).select("company_id", "old_id", "new_id").collect()
        assert {tuple(p) for p in pairs} == expected
    newest = {tuple(p) for p in snapshot_pairs(df).select("company_id", "old_id", "new_id").collect()}
    assert len(newest) == 3 and newest <= expected


def test_text_measures(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta".split()
    pairs = []
    for _ in range(40):
        a = [" ".join(rng.choices(words, k=4)) for _ in range(rng.randint(0, 12))]
        b = [x for x in a if rng.random() > 0.3] + [" ".join(rng.choices(words, k=4)) for _ in range(rng.randint(0, 4))]
        pairs.append(("\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = df.select(line_similarity("a", "b"), line_added("a", "b")).collect()
    for (a, b), row in zip(pairs, got):
        x, y = a.split("\n"), b.split("\n")
        assert row[0] == pytest.approx(2 * sum(min(x.count(v), y.count(v)) for v in set(x)) / (len(x) + len(y)))
        assert row[1] == "\n".join(v for v in y if v not in x)


def test_long_pages_are_compared_whole(spark):
    """100,000 lines, of which only the last half differs."""
    old = "\n".join(f"line {i}" for i in range(100_000))
    new = "\n".join(f"line {i}" if i < 50_000 else f"new {i}" for i in range(100_000))
    df = spark.createDataFrame([(old, new)], "a string, b string")
    row = df.select(line_similarity("a", "b"), F.size(F.split(line_added("a", "b"), "\n"))).first()
    assert tuple(row) == (0.5, 50_000)


def test_magnitude_boundaries(rows):
    from pulsegrid.functions.text import magnitude

    assert rows([1.0, 0.9, 0.89, 0.5, 0.49], magnitude("t"), "t double") == ["minor", "minor", "moderate", "moderate", "major"]


def test_backfill_touches_only_open_rows(spark):
    df = snaps(spark, (("x", "1", None), ("x\nlawsuit and layoffs", "2", None)), (("x", "1", None), ("x", "2", None)))
    changes = spark.createDataFrame([
        (1, 1, 10, 11, True, "minor", T0, None), (2, 2, 20, 21, True, "minor", T0, None), (3, 1, 10, 11, True, "minor", T0, "uncertain")],
        "id long, company_id long, snapshot_id_old long, snapshot_id_new long, has_changed boolean, change_magnitude string, detected_at timestamp_ntz, significance_classification string")
    for c, t in (("significance_sentiment", "string"), ("significance_confidence", "double"), ("matched_keywords", "array<string>"),
                 ("matched_categories", "array<string>"), ("significance_notes", "string"), ("evidence_snippets", "array<string>")):
        changes = changes.withColumn(c, F.lit(None).cast(t))
    got = {r.id: r.significance_classification for r in I.backfill_significance(changes, df).collect()}
    assert got == {1: "insignificant", 2: None, 3: "uncertain"}  # both terms are excluded on a company's own page


def test_baseline_is_stored_once(spark):
    df = snaps(spark, (("we raised a series a", "1", None), ("y", "2", None)))
    for c, t in (("baseline_classification", "string"), ("baseline_sentiment", "string")):
        df = df.withColumn(c, F.lit(None).cast(t))
    found = I.baseline(df)
    assert [r.id for r in found.collect()] == [10]
    stored = I.store_baseline(df, found)
    assert I.baseline(stored).count() == 0 and stored.count() == 2
