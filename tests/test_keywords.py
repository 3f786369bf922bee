"""Keyword matching against a plain reading of its rules, on random text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid import fixed
from pulsegrid.functions.keywords import Term, default_terms, keyword_hits, significance
from pulsegrid.operators.significance import classify_significance, needs_review, overlay_verdicts

TERMS = default_terms()
FILLER = ["no", "not", "casino", "the", "status: none", "date: n/a", "a", "x.css", "(c)2020", "\n", "für", "naïve", ",", ".", "b", "funding-status"]


def brute_hits(text):
    low, out = text.lower(), []
    for t in TERMS:
        for m in re.finditer(r"\b" + re.escape(t.keyword) + r"\b", low):
            before = low[max(0, m.start() - 20):m.start()].strip()
            after = low[m.end():m.end() + 30].strip()
            negated = any(before.endswith(w) or f" {w} " in f" {before} " for w in fixed.NEGATION_WORDS) or any(
                after.startswith(s) for s in fixed.NEGATION_SUFFIXES)
            false = any(0 <= low.find(p) <= m.start() < low.find(p) + len(p) for p in fixed.FALSE_POSITIVE_PHRASES)
            scored = t.polarity != "insignificant"
            out.append((t.keyword, t.category, m.start(), text[max(0, m.start() - 50):m.start()].strip(),
                        text[m.end():m.end() + 50].strip(), scored and negated, scored and false))
    return out


def random_texts(n):
    rng = random.Random(7)
    words = [t.keyword for t in TERMS] + list(fixed.FALSE_POSITIVE_PHRASES) + FILLER * 6
    return [" ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words)
                     for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_hits_equal_plain_search(rows):
    texts = random_texts(150)
    found = rows(texts, keyword_hits("t", TERMS))
    for text, hits in zip(texts, found):
        got = [(h.keyword, h.category, h.position, h.context_before, h.context_after, h.is_negated, h.is_false_positive) for h in hits]
        assert got == brute_hits(text), text


def test_edges_of_words(rows):
    texts = ["margin: 1px", "margin:1px", "a.css", ".css", "x(c)y", "(c) 2020", None, ""]
    found = rows(texts, F.transform(keyword_hits("t", TERMS), lambda h: h["keyword"]))
    assert found == [[], ["margin:"], [".css"], [], ["(c)"], [], [], []]


def test_strict_reading(rows):
    loose, strict = keyword_hits("t", TERMS), keyword_hits("t", TERMS, strict=True)
    texts = ["casino funding", "press release then another press release"]
    flags = lambda c: F.transform(c, lambda h: F.concat_ws("/", h["keyword"], h["is_negated"], h["is_false_positive"]))
    assert rows(texts, flags(loose)) == [["funding/true/false"], ["release/false/true", "release/false/false"]]
    assert rows(texts, flags(strict)) == [["funding/false/false"], ["release/false/true", "release/false/true"]]


@pytest.mark.parametrize(("text", "magnitude", "expected"), [
    ("font-size changed tracking", "minor", ("insignificant", "neutral", 0.85)),
    ("font-size changed tracking", "major", ("insignificant", "neutral", 0.75)),
    ("lawsuit and layoffs", "minor", ("significant", "negative", 0.90)),
    ("lawsuit, layoffs, recall, merger", "minor", ("significant", "negative", 0.95)),
    ("award winner", "minor", ("significant", "positive", 0.90)),
    ("award winner milestone nasdaq", "minor", ("significant", "positive", 0.90)),
    ("award winner lawsuit layoffs", "minor", ("significant", "mixed", 0.90)),
    ("lawsuit", "major", ("significant", "neutral", 0.70)),
    ("lawsuit", "moderate", ("uncertain", "neutral", 0.60)),
    ("lawsuit", "minor", ("uncertain", "neutral", 0.50)),
    ("lawsuit and award", "major", ("insignificant", "neutral", 0.75)),
    ("no lawsuit. a long gap of words here, award", "minor", ("uncertain", "neutral", 0.30)),
    ("press release; a long gap of words here; merger", "minor", ("uncertain", "neutral", 0.20)),
    ("nothing at all", "minor", ("insignificant", "neutral", 0.75)),
])
def test_rules(rows, text, magnitude, expected):
    (v,) = rows([text], significance(keyword_hits("t", TERMS), F.lit(magnitude)))
    assert (v.classification, v.sentiment, round(v.confidence, 6)) == expected


def test_excluded_categories_drop_negative_terms_only(spark):
    docs = spark.createDataFrame([("lawsuit settlement award winner",)], "text string")
    (row,) = classify_significance(docs, exclude_categories=fixed.SELF_REPORT_EXCLUDED).collect()
    assert row.matched_keywords == ["award", "winner"] and row.matched_categories == ["recognition"]


def test_review_and_overlay(spark):
    docs = spark.createDataFrame([
        (1, "lawsuit layoffs shut down closing", "minor"), (2, "font-size", "minor"), (3, "lawsuit", "minor")],
        "id int, text string, change_magnitude string")
    judged = classify_significance(docs, magnitude=F.col("change_magnitude"))
    assert [r.id for r in needs_review(judged).orderBy("id").collect()] == [3]
    verdicts = spark.createDataFrame([
        (1, "insignificant", None, 0.1, "", None), (3, "significant", "negative", 0.8, "seen", "timeout")],
        "id int, classification string, sentiment string, confidence double, reasoning string, error string")
    one, _, three = overlay_verdicts(judged, verdicts, ["id"]).orderBy("id").collect()
    assert (one.significance_classification, one.significance_sentiment, one.significance_confidence) == ("insignificant", "negative", 0.1)
    assert one.significance_notes.startswith("Multiple negative") and three.significance_classification == "uncertain"


@pytest.mark.parametrize("strict", [False, True])
def test_negation_and_phrases_equal_plain_reading(rows, strict):
    """Words before, patterns after and phrases around a term, as ``in``, ``endswith`` and ``startswith`` read them."""
    leads = ["", "no ", "not any ", "casino ", "is not", "none\n", "x no y ", "no\tmore ", "was never ", "self-", "a self-funded firm, ", "notno "]
    tails = ["", " status: none", " status:none at all", "ing", " date: n/a", " sources", " sources, funding sources"]
    texts = [f"{a}funding{b}" for a in leads for b in tails]
    terms = [t for t in default_terms() if t.keyword == "funding"] or [Term("funding", "x", "positive")]
    found = rows(texts, keyword_hits("t", terms, strict=strict))
    for text, hits in zip(texts, found):
        for h in hits:
            before, after = text[max(0, h["position"] - 20):h["position"]].strip(), text[h["position"] + 7:h["position"] + 37].strip()
            negated = any(f" {w} " in f" {before} " or (not strict and before.endswith(w)) for w in fixed.NEGATION_WORDS) or after.startswith(tuple(fixed.NEGATION_SUFFIXES))
            starts = [(i, i + len(p)) for p in fixed.FALSE_POSITIVE_PHRASES for i in range(len(text)) if text.startswith(p, i) and (strict or i == text.find(p))]
            assert (h["is_negated"], h["is_false_positive"]) == (negated, any(a <= h["position"] < b for a, b in starts)), (text, h)
