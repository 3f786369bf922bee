"""The open elements around each part of a page, by one native fold over its tags and texts.

An end tag closes the last open element of its name and all opened since; one that closes nothing
is ignored, and what is never closed lasts to the end. What the fold tells of each part is kept in
chunks, so that a step copies a chunk at most and not all that was found before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, first_match, let, lookup
from .html import INSIDE_TAG, attribute, visible_markup

# Elements that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CHUNK = 256
TAG = rf"</?[a-zA-Z][a-zA-Z0-9]*{INSIDE_TAG}>"


def page_parts(html: ColumnOrName, texts: bool = True) -> Column:
    """Tags, and the texts between them, in order: ``array<string>``."""
    return F.regexp_extract_all(visible_markup(html), F.lit(f"{TAG}|[^<]+|<" if texts else TAG), 0)


def tag_name(tag: Column) -> Column:
    """Lower-case name of an opening or end tag; empty for a text."""
    return F.lower(F.regexp_extract(tag, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def fold_elements(
    parts: Column, entry: Callable[[Column, Column], Column], kind: str, told: Callable[[Column, Column], Column], shape: str,
    after: Callable[[Column, Column], Column] | None = None,
) -> Column:
    """``array<shape>``: what ``told(part, open)`` says of each part, where it isn't NULL.

    ``parts`` are structs with ``name``, ``closes`` and ``void`` at least (an empty name for a text);
    ``open`` are the elements around the part, outermost first, each as ``entry(part, open)`` of its
    opening tag: structs of ``kind``, with ``name``, and ``times``. Elements in each other that are
    alike are one entry with its ``times``, so tags that nobody closes don't pile up. ``told`` sees
    an element's own tag before it is open. ``after`` may change the open elements once a part was told.
    """
    fields = [f.split(":", 1)[0] for f in kind.split(",")]

    def times(x: Column, n: Column) -> Column:
        return F.struct(*(x[f].alias(f) for f in fields), n.cast("int").alias("times"))

    def opened(part: Column, around: Column) -> Column:
        def put(new: Column) -> Column:
            top = F.get(around, F.size(around) - 1)
            alike = F.lit(True)
            for f in fields:
                alike = alike & top[f].eqNullSafe(new[f])
            one = F.array(times(new, F.lit(1)))
            return F.when((F.size(around) > 0) & alike, F.concat(
                F.slice(around, F.lit(1), F.size(around) - 1), F.array(times(top, top["times"] + 1)))).otherwise(F.concat(around, one))

        return let(entry(part, around).cast(f"struct<{kind}>"), put)

    def closed(part: Column, around: Column) -> Column:
        def cut(from_end: Column) -> Column:
            at = F.get(around, F.size(around) - from_end)
            rest = F.slice(around, F.lit(1), F.size(around) - from_end)
            return F.when(from_end == 0, around).when(at["times"] > 1, F.concat(rest, F.array(times(at, at["times"] - 1)))).otherwise(rest)

        return let(F.array_position(F.reverse(F.transform(around, lambda x: x["name"])), part["name"]).cast("int"), cut)

    def step(acc: Column, part: Column) -> Column:
        around = acc["open"]
        still = F.when(part["name"] == "", around).when(part["closes"], closed(part, around)).when(part["void"], around).otherwise(opened(part, around))
        said = let(told(part, around), lambda x: F.when(x.isNull(), acc["said"]).otherwise(F.concat(acc["said"], F.array(x.cast(shape)))))
        return F.struct((still if after is None else after(part, still)).alias("open"), said.alias("said"))

    def empty(schema: str) -> Column:
        return F.array().cast(f"array<{schema}>")

    def of(items: Column) -> Column:
        start = F.struct(empty(f"struct<{kind},times:int>").alias("open"), empty(f"array<{shape}>").alias("chunks"))
        numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))

        def chunk(acc: Column, k: Column) -> Column:
            begin = F.struct(acc["open"].alias("open"), empty(shape).alias("said"))
            inner = F.aggregate(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), begin, step)
            return let(inner, lambda x: F.struct(x["open"].alias("open"), F.concat(acc["chunks"], F.array(x["said"])).alias("chunks")))

        return F.aggregate(numbers, start, chunk, lambda acc: F.flatten(acc["chunks"]))

    return let(parts, of)


def own_region(tag: Column, name: Column) -> Column:
    """The region an opening tag begins: by element, by role, by words in class or id; else NULL."""

    def by_word(words: Column) -> Column:
        cases = [(F.exists(F.array(*(F.lit(w) for w in listed)), lambda w: F.contains(words, w)), region)
                 for region, listed in fixed.REGION_WORDS]
        return first_match(cases, F.lit(None).cast("string"))

    words = F.lower(F.concat_ws(" ", attribute(tag, "class"), attribute(tag, "id")))
    return F.coalesce(
        lookup(fixed.REGION_TAGS, name),
        F.when(F.contains(tag, F.lit("=")), F.coalesce(lookup(fixed.REGION_ROLES, F.lower(attribute(tag, "role"))), let(words, by_word))))


def link_regions(html: ColumnOrName) -> Column:
    """``array<struct<href, region>>``: each link with the nearest region around it, ``unknown`` if none."""

    def read(tag: Column) -> Column:
        return let(tag_name(tag), lambda name: F.struct(
            name.alias("name"), tag.startswith("</").alias("closes"), (name.isin(*VOID) | tag.endswith("/>")).alias("void"),
            F.when(~tag.startswith("</"), own_region(tag, name)).alias("region"),
            F.when((name == "a") & ~tag.startswith("</"), attribute(tag, "href")).alias("href")))

    def region(part: Column, around: Column) -> Column:
        return F.coalesce(part["region"], F.get(around, F.size(around) - 1)["region"])

    return fold_elements(
        F.transform(page_parts(html, texts=False), read),
        lambda part, around: F.struct(part["name"].alias("name"), region(part, around).alias("region")), "name:string,region:string",
        lambda part, around: F.when(part["href"].isNotNull(), F.struct(
            part["href"].alias("href"), F.coalesce(region(part, around), F.lit("unknown")).alias("region"))), "struct<href:string,region:string>")
