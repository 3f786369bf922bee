"""Leadership mentions in page text."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, col, let, lookup, strip
from .text import snippet


class Form(NamedTuple):
    """One way of naming a leader: pattern, groups of its names and title, priority (1 = surest)."""

    pattern: str
    names: tuple[int, ...]
    title: int
    priority: int


def _forms() -> tuple[Form, ...]:
    """The fixed patterns with the titles and names filled in; titles may be joined, in any case."""
    alternatives = "|".join(map(re.escape, fixed.MENTION_TITLES))
    titles = rf"(?:(?i:{alternatives})(?:\s+{fixed.TITLE_JOINERS}\s+(?i:{alternatives}))*)"
    fill = lambda p: p.replace("{titles}", titles).replace("{name}", fixed.PERSON_NAME)
    return tuple(Form(fill(pattern), *rest) for pattern, *rest in fixed.MENTION_PATTERNS)


FORMS = _forms()


def plain_markdown(text: ColumnOrName) -> Column:
    """Markdown links as their text, emphasis and code marks removed."""
    linked = F.regexp_replace(col(text), fixed.MARKDOWN_LINK, "$1")
    return F.regexp_replace(linked, fixed.MARKDOWN_MARKS, "")


def canonical_title(title: Column) -> Column:
    """Titles as "CEO", "Co-Founder", ...; several joined by "and"."""
    table = {k.lower(): v for k, v in fixed.MENTION_TITLES.items()}

    def one(t: Column) -> Column:
        return F.coalesce(lookup(table, F.lower(strip(t))), strip(t))

    return F.array_join(F.transform(F.split(strip(title), rf"(?iU)\s+{fixed.TITLE_JOINERS}\s+"), one), " and ")


def _spans(text: Column, pattern: str) -> Column:
    """Every match with its 0-based start: matches and the pieces between them alternate."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"))
    empty = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start:int,whole:string>>)").alias("spans"))
    step = lambda acc, p: F.struct(
        (acc["end"] + F.length(p["gap"]) + F.length(p["whole"])).alias("end"),
        F.concat(acc["spans"], F.array(F.struct(
            (acc["end"] + F.length(p["gap"])).alias("start"), p["whole"].alias("whole")))).alias("spans"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def _of_form(text: Column, form: Form) -> Column:
    pattern = "(?U)" + form.pattern

    def named(m: Column) -> Column:
        title = canonical_title(F.regexp_extract(m["whole"], pattern, form.title)) if form.title else F.lit("Founder")
        shown = snippet(text, m["start"], m["start"] + F.length(m["whole"]))
        return F.array(*[
            F.struct(strip(F.regexp_extract(m["whole"], pattern, g)).alias("person_name"), title.alias("title_context"),
                     F.lit(form.priority).alias("priority"), shown.alias("snippet"))
            for g in form.names
        ])

    return F.flatten(F.transform(_spans(text, pattern), named))


def leadership_mentions(markdown: ColumnOrName) -> Column:
    """``array<struct<person_name, title_context, priority, snippet>>`` of everyone named as a leader."""
    none = F.expr("cast(array() as array<struct<person_name:string,title_context:string,priority:int,snippet:string>>)")
    text = F.coalesce(col(markdown), F.lit(""))
    found = let(plain_markdown(text), lambda t: F.concat(*[_of_form(t, f) for f in FORMS]))
    return F.when(text.rlike(fixed.MENTION_HINT), found).otherwise(none)
