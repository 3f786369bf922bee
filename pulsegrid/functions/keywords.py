"""Keyword matching and significance as column expressions.

A document is scanned inside its own row: no join with the lexicon, no explode and no
shuffle. The document is first cut into words; only terms with one of their words
present are searched for at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, col, let, literal, strip, text_array


class Term(NamedTuple):
    keyword: str
    category: str
    polarity: str  # positive, negative or insignificant


def default_terms(exclude_categories: Iterable[str] = ()) -> list[Term]:
    """The business lexicon; an excluded category drops its negative terms only."""
    dropped = set(exclude_categories)
    groups = (
        ("positive", fixed.POSITIVE_TERMS, set()),
        ("negative", fixed.NEGATIVE_TERMS, dropped),
        ("insignificant", fixed.COSMETIC_TERMS, set()),
    )
    return [
        Term(word, category, polarity)
        for polarity, table, skip in groups
        for category, words in table.items()
        if category not in skip
        for word in words
    ]


def _anchor(keyword: str) -> str:
    """The longest word of a term. A whole-word match of the term has it as a whole word."""
    return max(re.findall(r"[a-z0-9_]+", keyword.lower()), key=len, default="")


def _any_of(texts: Sequence[str]) -> str:
    """A regular expression for any of some literal texts."""
    return "|".join(rf"\Q{t}\E" for t in texts)


TERM = "struct<keyword:string,category:string,polarity:string,anchor:string,pattern:string>"


def _terms_column(terms: Sequence[Term]) -> Column:
    rows = [
        {**t._asdict(), "anchor": _anchor(t.keyword), "pattern": rf"\b\Q{t.keyword}\E\b"} for t in terms
    ]
    return literal(rows, f"array<{TERM}>")


def _starts(low: Column, term: Column) -> Column:
    """0-based start of every whole-word occurrence: the pieces between occurrences, summed."""
    width = F.length(term["keyword"])

    def from_pieces(pieces: Column) -> Column:
        before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
        empty = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<int>)").alias("starts"))
        step = lambda acc, n: F.struct(
            (acc["end"] + n + width).alias("end"),
            F.concat(acc["starts"], F.array(acc["end"] + n)).alias("starts"),
        )
        return F.aggregate(before, empty, step, lambda acc: acc["starts"])

    return let(F.split(low, term["pattern"], -1), from_pieces)


def keyword_hits(
    text: ColumnOrName,
    terms: Sequence[Term],
    strict: bool = False,
    negation_words: Sequence[str] = fixed.NEGATION_WORDS,
    negation_suffixes: Sequence[str] = fixed.NEGATION_SUFFIXES,
    false_positives: Sequence[str] = fixed.FALSE_POSITIVE_PHRASES,
) -> Column:
    """Every whole-word occurrence of every term, in lexicon order, with its surroundings.

    ``array<struct<keyword, category, polarity, position, context_before, context_after,
    is_negated, is_false_positive>>``. By default a negation word may also end the text
    before a term without a word break, and only the first occurrence of a false-positive
    phrase counts; ``strict`` asks for a whole word, and for any occurrence.
    """
    text = col(text)
    anchors = sorted({_anchor(t.keyword) for t in terms} - {""})

    def flagged(doc: Column, term: Column, start: Column) -> Column:
        width = F.length(term["keyword"])
        lead = F.least(start, F.lit(50))
        in_phrase = F.exists(
            doc["phrases"], lambda p: (p["start"] <= start) & (start < p["start"] + p["width"])
        )
        scored = term["polarity"] != "insignificant"

        def negated(before: Column) -> Column:
            if not negation_words:
                return F.lit(False)
            word = rf"(?:{_any_of(negation_words)})"
            return before.rlike(rf"(?:\A| ){word}(?: |\z)" if strict else rf"(?:\A| ){word} |{word}\z")

        def suffixed(after: Column) -> Column:
            return after.rlike(rf"\A(?:{_any_of(negation_suffixes)})") if negation_suffixes else F.lit(False)

        def described(around: Column) -> Column:
            # ``around`` is the only cut out of the whole text; the rest cuts it further.
            low = F.lower(around)
            near = F.least(lead, F.lit(20))
            before20 = strip(F.substring(low, lead - near + 1, near))
            after30 = strip(F.substring(low, lead + width + 1, F.lit(30)))
            return F.struct(
                term["keyword"].alias("keyword"), term["category"].alias("category"),
                term["polarity"].alias("polarity"), start.alias("position"),
                strip(F.substring(around, F.lit(1), lead)).alias("context_before"),
                strip(F.substring(around, lead + width + 1, F.lit(50))).alias("context_after"),
                (scored & (let(before20, negated) | let(after30, suffixed))).alias("is_negated"),
                (scored & in_phrase).alias("is_false_positive"),
            )

        return let(F.substring(doc["text"], start - lead + 1, lead + width + 50), described)

    def phrase_spans(low: Column) -> Column:
        if not false_positives:
            return F.expr("cast(array() as array<struct<start:int,width:int>>)")
        # Looking for bytes is much cheaper than counting characters, and few phrases are there.
        there = F.filter(text_array(false_positives), lambda p: F.contains(low, p))
        if strict:
            return F.flatten(F.transform(there, lambda p: F.transform(_occurrences(low, p), lambda s: F.struct(
                s.alias("start"), F.length(p).alias("width")))))
        return F.transform(there, lambda p: F.struct((F.position(p, low) - 1).alias("start"), F.length(p).alias("width")))

    def scan(doc: Column) -> Column:
        return F.flatten(F.transform(
            doc["terms"],
            lambda term: F.transform(_starts(doc["low"], term), lambda start: flagged(doc, term, start)),
        ))

    def prepare(low: Column) -> Column:
        present = F.array_intersect(text_array(anchors), F.split(low, r"\W+"))
        wanted = let(present, lambda here: F.filter(
            _terms_column(terms),
            lambda t: (t["anchor"] == "") | F.array_contains(here, t["anchor"]),
        ))
        # Phrases matter only where a term was found.
        doc = let(wanted, lambda some: F.struct(
            text.alias("text"), low.alias("low"), some.alias("terms"),
            F.when(F.size(some) > 0, phrase_spans(low)).alias("phrases"),
        ))
        return let(doc, scan)

    return let(F.lower(F.coalesce(text, F.lit(""))), prepare)


def _occurrences(low: Column, phrase: Column) -> Column:
    """0-based starts of all, also overlapping, occurrences of a literal phrase."""
    pattern = F.concat(F.lit("(?=\\Q"), phrase, F.lit("\\E)"))

    def from_pieces(pieces: Column) -> Column:
        sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
        empty = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<int>)").alias("starts"))
        step = lambda acc, n: F.struct(
            (acc["end"] + n).alias("end"),
            F.concat(acc["starts"], F.array(acc["end"] + n)).alias("starts"),
        )
        later = F.aggregate(sizes, empty, step, lambda acc: acc["starts"])
        at_zero = F.when(F.startswith(low, phrase), F.expr("array(0)")).otherwise(
            F.expr("cast(array() as array<int>)"))
        return F.concat(at_zero, later)

    return let(F.split(low, pattern, -1), from_pieces)


def sentiment(positive: Column, negative: Column) -> Column:
    return (
        F.when((positive >= 2) & (negative >= 2), "mixed")
        .when(negative >= 2, "negative")
        .when(positive >= 2, "positive")
        .otherwise("neutral")
    )


def significance(hits: Column, magnitude: ColumnOrName) -> Column:
    """The keyword verdict on a document's hits.

    ``struct<classification, sentiment, confidence, keywords, categories, notes, evidence>``.
    Cosmetic terms alone in a minor change are insignificant (.85); two negative terms
    make it significant (.80 + up to .15), else two positive ones (.80 + up to .10); one
    term is significant in a major change (.70), uncertain in a minor (.50) or moderate
    one (.60); anything else is insignificant (.75). Negated terms take .20 and false
    positives .30 off the scored verdicts.
    """
    magnitude = col(magnitude)
    none = F.expr("cast(array() as array<string>)")

    def verdict(c: Column) -> Column:
        p, n = F.size(c["positive"]), F.size(c["negative"])
        one = (p + n) == 1
        cosmetic = (F.size(c["cosmetic"]) > 0) & (p + n == 0) & (magnitude == "minor")
        scored = (n >= 2) | (p >= 2) | one
        effective = F.concat(c["positive"], c["negative"])
        base = (
            F.when(n >= 2, F.lit(0.80) + F.least(F.lit(0.15), n * 0.05))
            .when(p >= 2, F.lit(0.80) + F.least(F.lit(0.10), p * 0.05))
            .when(magnitude == "major", 0.70)
            .when(magnitude == "minor", 0.50)
            .otherwise(0.60)
        )
        confidence = (
            F.when(cosmetic, 0.85)
            .when(scored, F.greatest(F.lit(0.0), base - c["reduction"]))
            .otherwise(0.75)
        )
        label = (
            F.when(cosmetic, "insignificant")
            .when((n >= 2) | (p >= 2) | (one & (magnitude == "major")), "significant")
            .when(one, "uncertain")
            .otherwise("insignificant")
        )
        notes = (
            F.when(cosmetic, "Only insignificant patterns detected with minor changes")
            .when(n >= 2, F.concat(F.lit("Multiple negative signals detected ("), n.cast("string"),
                                   F.lit(" negative keywords)")))
            .when(p >= 2, F.concat(F.lit("Multiple positive signals detected ("), p.cast("string"),
                                   F.lit(" positive keywords)")))
            .when(one, F.concat(F.lit("Single keyword with "),
                                F.when(magnitude.isin("major", "minor"), magnitude).otherwise("moderate"),
                                F.lit(" content change")))
            .otherwise("No significant keywords detected")
        )
        word = lambda h: h["keyword"]
        kind = lambda h: h["category"]
        quote = lambda h: F.concat(
            h["context_before"], F.lit(" ["), h["keyword"], F.lit("] "), h["context_after"])
        return F.struct(
            label.alias("classification"),
            F.when(scored, sentiment(p, n)).otherwise("neutral").alias("sentiment"),
            confidence.alias("confidence"),
            F.when(cosmetic, F.transform(c["cosmetic"], word))
            .when(scored, F.transform(effective, word)).otherwise(none).alias("keywords"),
            F.when(cosmetic, F.transform(c["cosmetic"], kind))
            .when(scored, F.array_sort(F.array_distinct(F.transform(effective, kind))))
            .otherwise(none).alias("categories"),
            notes.alias("notes"),
            F.when(scored, F.transform(effective, quote)).otherwise(none).alias("evidence"),
        )

    def counted(all_hits: Column) -> Column:
        good = lambda h: ~h["is_negated"] & ~h["is_false_positive"]
        scored = lambda h: h["polarity"] != "insignificant"
        negated = F.size(F.filter(all_hits, lambda h: scored(h) & h["is_negated"]))
        false = F.size(F.filter(all_hits, lambda h: scored(h) & h["is_false_positive"]))
        return let(F.struct(
            F.filter(all_hits, lambda h: (h["polarity"] == "positive") & good(h)).alias("positive"),
            F.filter(all_hits, lambda h: (h["polarity"] == "negative") & good(h)).alias("negative"),
            F.filter(all_hits, lambda h: h["polarity"] == "insignificant").alias("cosmetic"),
            (negated * 0.20 + false * 0.30).alias("reduction"),
        ), verdict)

    return let(hits, counted)
