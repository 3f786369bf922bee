"""Licence scans by a positional index of rare words, as column expressions from end to end.

Each template has a mandatory key phrase. Of the key's words the one with the highest inverse
document frequency (counted over all documents) is looked up in a file; each place gives a
possible start of the template, the key's next rarest word must stand at its relative position,
and the whole key is verified there. Any match holds the key, so the choice of rare words decides
the work, not the result. A template counts if enough of its other words stand in place too.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let
from .common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's words that must stand in place.
COVERAGE = 0.8


class Template(NamedTuple):
    label: str
    text: str
    #: The phrase within ``text`` that must stand as it is.
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i:i + len(k)] == k)


# The base phrases.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
# Wording of common licences, as notices quote it.
TEMPLATES = (
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("creative-commons", "creative commons attribution license", "creative commons attribution"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("isc", "released under the isc license", "isc license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "hereby granted free of charge"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2"),
    Template("proprietary", "unauthorized copying of this file is strictly prohibited", "unauthorized copying"),
    Template("public-domain", "released into the public domain", "into the public domain"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def rarity(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each licence word over all of ``docs``."""
    present = docs.select(F.array_intersect(words_of(F.col(text_col)), _texts(vocabulary)).alias("w"))
    counted = present.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counted}
    return {w: math.log((1 + found.get("", 0)) / (1 + found.get(w, 0))) for w in vocabulary}


class Place(NamedTuple):
    """Where in a template a rare word stands."""

    word: str
    offset: int


def rare_places(template: Template, idf: dict[str, float]) -> list[Place]:
    """The key's words, rarest first (the first in the key of equally rare ones)."""
    places = [Place(w, template.key_at + i) for i, w in enumerate(template.key_words)]
    return sorted(places, key=lambda p: (-idf[p.word], p.offset))


def _at(words: Column, start: Column, offset: int) -> Column:
    """The word ``offset`` words after ``start``, NULL outside the text."""
    place = start + offset
    return F.when(place >= 0, F.get(words, place))


def _matches(words: Column, hits: Column, template: Template, idf: dict[str, float], coverage: float) -> Column:
    """Matches of one template as ``(start, share)``: by its key's rarest word, then the next, then the whole key."""
    rare = rare_places(template, idf)
    starts = F.transform(F.filter(hits, lambda h: h["w"] == rare[0].word), lambda h: h["i"] - rare[0].offset)
    if len(rare) > 1:
        starts = F.filter(starts, lambda s: F.coalesce(_at(words, s, rare[1].offset) == rare[1].word, F.lit(False)))
    key = _texts(template.key_words)
    n = len(template.words)
    keyed = F.filter(starts, lambda s: (s + template.key_at >= 0) & (F.slice(words, F.greatest(s + template.key_at, F.lit(0)) + 1, F.lit(len(template.key_words))) == key))

    def share(s: Column) -> Column:
        good = [F.when(_at(words, s, i) == w, F.lit(1)).otherwise(F.lit(0)) for i, w in enumerate(template.words)]
        return sum(good[1:], good[0]) / F.lit(n)

    scored = F.transform(keyed, lambda s: F.struct(s.alias("start"), share(s).cast("double").alias("share")))
    return F.filter(scored, lambda m: m["share"] * n >= coverage * n - 1e-9)


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, base, found``: places of the base phrases and matches of the templates.

    ``base`` holds ``(label, start)``, ``found`` ``(label, start, share)``; starts count words from
    0, and a template that begins before its text may start below 0. NULL counts as empty: no
    words, no places. One row for each row of ``docs``; an empty table has no rows. Other columns
    aren't read.
    """
    vocabulary = sorted({w for t in (*BASE, *TEMPLATES) for w in t.key_words})
    idf = rarity(docs, text_col, vocabulary)
    anchors = sorted({rare_places(t, idf)[0].word for t in (*BASE, *TEMPLATES)})
    none = F.array().cast("array<struct<w:string,i:int>>")

    def labelled(matches: Column, label: str) -> Column:
        return F.transform(matches, lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start"), m["share"].alias("share")))

    def search(words: Column) -> Column:
        hits = F.when(F.arrays_overlap(words, _texts(anchors)), F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(anchors))).otherwise(none)
        return let(hits, lambda h: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.concat(*(labelled(_matches(words, h, t, idf, coverage), t.label) for t in BASE)).alias("base"),
            F.concat(*(labelled(_matches(words, h, t, idf, coverage), t.label) for t in TEMPLATES)).alias("found")))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(let(words_of(F.col(text_col)), search))))
    return stored(rows)


def license_labels(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: places of base phrases, labels, and the largest share of a template found (0: none)."""
    found = scan_licenses(docs, **options)
    starts = F.transform("base", lambda m: m["start"])
    names = lambda c: F.transform(c, lambda m: m["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), joined(names("base")).alias("base_labels"),
        joined(F.concat(names("base"), names("found"))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "found"), lambda m: m["share"])), F.lit(0.0)).alias("score"))


def license_sql(coverage: float = COVERAGE) -> str:
    """DuckDB SQL for the rows of ``license_labels`` over ``documents``."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    parts = []
    for base, t in [*((True, t) for t in BASE), *((False, t) for t in TEMPLATES)]:
        good = " + ".join(f"(CASE WHEN p.k - {t.key_at} + {i} >= 1 AND w[p.k - {t.key_at} + {i}] = '{x}' THEN 1 ELSE 0 END)" for i, x in enumerate(t.words))
        parts.append(f"SELECT row, {base} AS base, '{t.label}' AS label, k - {t.key_at} - 1 AS start, ({good}) / {len(t.words)}.0::DOUBLE AS share "
                     f"FROM p WHERE w[k:k + {len(t.key_words) - 1}] = {quoted(t.key_words)}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS k FROM d
      WHERE list_has_any(w, {quoted(sorted({t.key_words[-1] for t in (*BASE, *TEMPLATES)}))})),
m AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE share >= {coverage - 1e-9}),
g AS (SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM m GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (row)"""
