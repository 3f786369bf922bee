"""Small helpers shared by the column functions."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's ``str.strip`` removes.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row for use inside ``body``.

    Higher-order functions re-evaluate every free expression for each element, so
    anything costly used inside a lambda must first become a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: ColumnOrName) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(col(c), F.lit(""))


def has_text(c: ColumnOrName) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""


def moment(value: dt.datetime | dt.date | str | Column) -> Column:
    """A point in time as a zone-less UTC timestamp."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(str(value)).cast("timestamp_ntz")


def days_before(as_of: dt.datetime | str | Column, days: int) -> Column:
    return F.date_sub(F.to_date(moment(as_of)), days)


def on_or_after(c: ColumnOrName, as_of: dt.datetime | str | Column, days: int) -> Column:
    """``c`` falls on the cutoff date or later (dates are compared, not times)."""
    return F.to_date(col(c)) >= days_before(as_of, days)


def literal(value: object, schema: str) -> Column:
    """A nested constant as one expression, which the optimizer folds to a literal."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def text_array(values: Sequence[str]) -> Column:
    return literal(list(values), "array<string>")


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, NULL when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def first_match(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first true condition."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if chain is None:
        return F.lit(otherwise)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def quoted(c: Column) -> Column:
    """``c`` as a literal inside a Java regular expression."""
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def once(value: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Generator giving a struct's fields as columns, for rows where ``keep`` holds.

    Unlike a projected column, its result is not substituted into later filters, so a
    costly expression runs once per row however often its fields are used.
    """
    row = F.array(value)
    return F.inline(row if keep is None else F.filter(row, keep))
