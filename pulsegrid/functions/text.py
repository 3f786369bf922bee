"""Scalar functions on text, headers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import LINE_BREAK, ColumnOrName, col, empty_strings, let, strip


def normalize_company_name(name: ColumnOrName) -> Column:
    """Trimmed, single-spaced, and capitalised after every non-letter (``initcap`` only
    capitalises after a space)."""
    tidy = F.regexp_replace(strip(name), r"(?U)\s+", " ")
    runs = F.regexp_extract_all(tidy, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def json_array(c: ColumnOrName) -> Column:
    """JSON text to ``array<string>``; NULL, malformed and non-array text give an empty array."""
    return F.coalesce(F.from_json(col(c), "array<string>"), empty_strings())


def _utc(instant: Column) -> Column:
    """An instant as UTC wall time, whatever the session's zone: microseconds counted from a zone-less 1970."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def parse_iso(c: ColumnOrName) -> Column:
    """ISO-8601 text to UTC, NULL when malformed; without an offset it is UTC already."""
    text = strip(c)
    zoned = text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, _utc(F.try_to_timestamp(text))).otherwise(text.try_cast("timestamp_ntz"))


def parse_http_date(c: ColumnOrName) -> Column:
    """An RFC 2822 date such as ``Last-Modified`` to UTC, NULL when malformed."""
    bare = F.regexp_replace(strip(c), r"^[A-Za-z]{3},\s*", "")
    zoned = [_utc(F.try_to_timestamp(bare, F.lit(f"d MMM yyyy HH:mm:ss {z}"))) for z in ("z", "Z")]
    return F.coalesce(*zoned, F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"))


def header(headers: ColumnOrName, name: str) -> Column:
    """A header's value whatever the case of its name."""
    hits = F.map_filter(col(headers), lambda k, _: F.lower(k) == name.lower())
    return F.get(F.map_values(hits), F.lit(0))


def content_type(headers: ColumnOrName) -> Column:
    return strip(F.get(F.split(header(headers, "content-type"), ";"), F.lit(0)))


def is_html(content_type_value: ColumnOrName) -> Column:
    known = F.lower(col(content_type_value)).isin("text/html", "application/xhtml+xml")
    return F.coalesce(known, F.lit(False))


def md5_text(c: ColumnOrName) -> Column:
    return F.md5(col(c))


def is_md5(c: ColumnOrName) -> Column:
    return F.coalesce(col(c).rlike(r"^[0-9a-f]{32}$"), F.lit(False))


def snippet(text: ColumnOrName, start: Column, end: Column, width: int = 30) -> Column:
    """``text[start:end]`` with ``width`` characters around it, ``...`` where cut."""
    text = col(text)
    begin = F.greatest(start - width, F.lit(0))
    stop = F.least(end + width, F.length(text))
    body = strip(F.substring(text, begin + 1, stop - begin))
    return F.concat(
        F.when(begin > 0, "...").otherwise(""), body,
        F.when(stop < F.length(text), "...").otherwise(""),
    )


def magnitude(similarity: ColumnOrName) -> Column:
    s = col(similarity)
    return (
        F.when(s >= fixed.MINOR_FROM, "minor").when(s >= fixed.MODERATE_FROM, "moderate").otherwise("major")
    )


def hash_bits(c: ColumnOrName) -> Column:
    """A 16-digit hexadecimal hash as a 64-bit integer; anything else is NULL."""
    return F.when(col(c).rlike("^[0-9a-fA-F]{16}$"), F.conv(col(c), 16, -10).cast("bigint"))


def hash_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 minus the share of differing bits of two 64-bit hashes."""
    return F.lit(1.0) - F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b))) / F.lit(64.0)


def lines(text: ColumnOrName) -> Column:
    return F.split(col(text), LINE_BREAK, -1)


def company_description(markdown: ColumnOrName, limit: int | None = None) -> Column:
    """A page's running text, menu lines left out; with ``limit`` its first characters."""

    def keep(line: Column) -> Column:
        heading = strip(F.regexp_extract(line, r"^#{1,6}\s+(.*)", 1))
        return (
            (F.length(line) >= 20)
            & ~line.rlike(r"^!?\[.*?\]\(.*?\)$")
            & ~line.rlike(r"^https?://\S+$")
            & ~(line.rlike(r"^#{1,6}\s+") & (F.length(heading) < 20))
        )

    kept = F.filter(F.transform(lines(F.coalesce(col(markdown), F.lit(""))), strip), keep)
    running = F.array_join(kept, " ")
    return strip(running if limit is None else F.substring(running, 1, limit))


def copyright_year(text: ColumnOrName) -> Column:
    """The latest year after a copyright mark; of a range, its end."""
    mark = r"(?:\([cC]\)|[Cc]opyright|©)\s*\d{4}(?:\s*[-–]\s*\d{4})?"
    found = F.regexp_extract_all(col(text), F.lit(f"({mark})"), 1)
    return F.array_max(F.transform(found, lambda m: F.regexp_extract(m, r"(\d{4})$", 1).cast("int")))


def acquisition_mention(text: ColumnOrName) -> Column:
    """The first acquisition phrase (in order of precedence) with its surroundings.

    "sold to" followed by a word of plain commerce does not count.
    """
    text = col(text)

    def context(low: Column) -> Column:
        followers = "|".join(fixed.COMMERCE_FOLLOWERS)
        whole = []
        for phrase in fixed.ACQUISITION_PHRASES:
            if phrase == "sold to":
                head = F.regexp_extract(low, rf"(?s)^(.*?)sold to(?!\s*(?:{followers}))", 1)
                hit = low.rlike(rf"sold to(?!\s*(?:{followers}))")
                at = F.when(hit, F.length(head))
            else:
                place = F.locate(phrase, low)
                at = F.when(place > 0, place - 1)
            begin = F.greatest(at - 30, F.lit(0))
            stop = F.least(at + len(phrase) + 50, F.length(text))
            whole.append(F.when(at.isNotNull(), strip(F.substring(text, begin + 1, stop - begin))))
        return F.coalesce(*whole)

    return let(F.lower(text), context)
