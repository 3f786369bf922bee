"""Leadership titles and person names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, blank_to_null, col, lookup, strip, text_array

CHIEF = "(?iU)" + fixed.CHIEF_OFFICER
VICE = "(?iU)" + fixed.VICE_PRESIDENT
ANY_TITLE = r"(?iU)\b(?:" + "|".join(re.escape(t) for t in fixed.TITLE_RANKS) + r")\b"


def _key(title: ColumnOrName) -> Column:
    return F.lower(strip(F.coalesce(col(title), F.lit(""))))


def is_leadership(title: ColumnOrName) -> Column:
    t = F.coalesce(col(title), F.lit(""))
    return t.rlike(ANY_TITLE) | t.rlike(CHIEF) | t.rlike(VICE)


def title_rank(title: ColumnOrName) -> Column:
    key = _key(title)
    return F.coalesce(
        lookup(fixed.TITLE_RANKS, key), F.when(key.rlike(CHIEF), 4), F.when(key.rlike(VICE), 5), F.lit(99))


def extract_title(text: ColumnOrName) -> Column:
    """The longest known title found in the text, as written; NULL when there is none."""
    text = col(text)
    longest_first = sorted(fixed.TITLE_RANKS, key=len, reverse=True)
    patterns = [rf"(?iU)\b({re.escape(t)})\b" for t in longest_first] + [f"({CHIEF})", f"({VICE})"]
    found = F.coalesce(*[blank_to_null(F.regexp_extract(text, p, 1)) for p in patterns])
    return F.when(is_leadership(text), found)


def normalize_title(title: ColumnOrName) -> Column:
    key, plain = _key(title), strip(title)
    short = F.upper(plain)
    return F.coalesce(
        lookup(fixed.TITLE_SHORT_FORMS, key), F.when(short.isin(*fixed.TITLE_ABBREVIATIONS), short),
        F.when(key.isin(*fixed.TITLE_RANKS), F.initcap(plain)), plain)


def classify_role(title: ColumnOrName) -> Column:
    key = _key(title)
    executive = key.rlike(CHIEF) | key.rlike(VICE) | key.isin(*fixed.TITLE_RANKS)
    return F.coalesce(lookup(fixed.TITLE_ROLES, key), F.when(executive, "other_executive"), F.lit("other"))


def departure_type(title: ColumnOrName) -> Column:
    return F.coalesce(lookup(fixed.DEPARTURE_TYPES, _key(title)), F.lit("executive_departure"))


def arrival_type(title: ColumnOrName) -> Column:
    return F.when(_key(title).isin("ceo", "chief executive officer"), "new_ceo").otherwise("new_leadership")


def change_severity(change_type: ColumnOrName) -> Column:
    kind = col(change_type)
    return (
        F.when(kind.isin(*sorted(set(fixed.DEPARTURE_TYPES.values()))), "critical")
        .when(kind.isin("new_ceo", "new_leadership", "executive_departure"), "notable").otherwise("minor")
    )


def name_tokens(name: ColumnOrName) -> Column:
    """The distinct words of a name that tell people apart: no honorifics, initials or punctuation."""
    words = F.split(F.lower(strip(F.coalesce(col(name), F.lit("")))), r"(?U)\s+")
    plain = F.transform(
        F.filter(words, lambda w: ~w.isin(*fixed.HONORIFICS)), lambda w: F.btrim(w, F.lit(".,;:()\"")))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda w: (F.length(w) > 1) & ~w.isin(*fixed.HONORIFICS))))


def token_pairs(name: ColumnOrName) -> Column:
    """All pairs of a name's words; two names share a pair when they share two words."""
    tokens = name_tokens(name)
    return F.flatten(F.transform(tokens, lambda a: F.transform(
        F.filter(tokens, lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))


def is_person_name(name: ColumnOrName, company: ColumnOrName | None = None) -> Column:
    name = strip(name)
    low = F.lower(name)
    words = F.split(low, r"(?U)\s+")
    ok = (
        F.length(name).between(3, 60) & (F.size(words) >= 2)
        & ~low.rlike(r"http|www|\.com")
        & F.forall(F.split(name, r"(?U)\s+"), lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}"))
        & ~F.arrays_overlap(words, text_array(fixed.NOT_NAME_WORDS))
    )
    if company is not None:
        ok = ok & ~low.eqNullSafe(F.lower(strip(company)))
    return F.coalesce(ok, F.lit(False))
