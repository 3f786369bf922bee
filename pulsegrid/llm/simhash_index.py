"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut in two halves of 32 bits. Fingerprints that differ in at most three bits
differ in at most one bit of some half, so each one is looked up, half by half, under its own
value and under the values with one more bit set (of two values one bit apart, one is the other
with a bit set, so half of the ball is enough). Every match is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, Runs, Words, bytes_of, free_name, mixed, packs, stored
from .components import components

WORDS, SEED, DISTANCE = 3, 42, 3


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash over the XXH64 of word shingles: a bit is set if more than half of them have it."""
    found = data.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = [b" ".join(s) for s in zip(*(found[i:] for i in range(words)))]
    counts = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 1 << 16):
        part = shingles[start:start + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)[0])




def fingerprints(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint of each text as a signed long; without words (or NULL) it is zero."""

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            values = np.fromiter((fingerprint(t, words, seed) for t in bytes_of(texts)), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))

    return F.pandas_udf(each, "long")(text)


# ---- the index ------------------------------------------------------------------------------

#: Up to so many table entries under one segment value are compared one by one. Where more
#: entries share a value they meet at hubs instead (below); either way finds the same components.
CROWD = 64


#: A table entry's key: space and half in the high bits, the half's value in the low 32.
_LOW = 0xFFFFFFFF


def _half(fp: Column, key: Column, own: bool) -> Column:
    """The half of ``fp`` that ``key`` looks up, or the other one."""
    low = key.bitwiseAND(1 << 32) == 0
    return F.when(low if own else ~low, fp.bitwiseAND(_LOW)).otherwise(F.shiftrightunsigned(fp, 32))


def _keys(values: Column, seg: int) -> Column:
    """Keys of several values of one half."""
    base = F.shiftleft(F.col("space").cast("bigint") * 2 + seg, 32)
    return F.transform(values, lambda v: base.bitwiseOR(v))


def _ball(value: Column) -> Column:
    """``value`` and the values that have one more of its 32 bits set."""
    more = [F.when(value.bitwiseAND(1 << b) == 0, value.bitwiseOR(F.lit(1 << b))) for b in range(32)]
    return F.filter(F.array(value, *more), lambda x: x.isNotNull())


def _within(value: Column, distance: int) -> Column:
    """The 32-bit values at most ``distance`` (0 to 2) bits from ``value``, with their distance."""
    masks = [(0, 0)]
    masks += [(1 << b, 1) for b in range(32)] if distance else []
    masks += [((1 << b) | (1 << c), 2) for b in range(32) for c in range(b)] if distance > 1 else []
    table = F.from_json(F.lit("[" + ",".join(f'{{"m":{m},"d":{d}}}' for m, d in masks) + "]"),
                        "array<struct<m:bigint,d:int>>")
    return F.transform(table, lambda x: F.struct(value.bitwiseXOR(x.m).alias("hub"), x.d.alias("d")))


def hamming_links(prints: DataFrame) -> DataFrame:
    """Links ``(space, a, b)`` between distinct fingerprints of ``prints(space, fp)``.

    Two fingerprints of one space that differ in one to three bits get a link, or (under a
    segment value that more than ``CROWD`` entries share) a path of such links over third ones:
    their components are those of all links. The path exists because fingerprints x and y that
    share a half and differ in d <= 3 bits of the other have a value h at most one bit from x and
    at most two from y; everything near such a hub is linked to the smallest x of it, and each of
    these links is itself at most three bits long.
    """
    prints = prints.select("space", "fp").distinct()
    low, high = F.col("fp").bitwiseAND(_LOW), F.shiftrightunsigned("fp", 32)
    both = lambda values: F.explode(F.concat(_keys(values(low), 0), _keys(values(high), 1))).alias("key")
    homes = prints.select("fp", both(F.array))
    probes = prints.select("fp", both(_ball)).where("fp is not null and key is not null")
    sizes = homes.groupBy("key").agg(F.count("*").alias("n"))
    crowded = stored(sizes.where(F.col("n") > CROWD).select("key"))
    any_crowd = not crowded.isEmpty()
    # Merge joins by hint: the size of the stored fingerprints says nothing of their exploded balls.
    alone = probes.join(crowded.hint("merge"), "key", "left_anti") if any_crowd else probes
    few = homes.join(crowded, "key", "left_anti") if any_crowd else homes
    visit = _half(F.col("fp"), F.col("key"), True) != F.col("key").bitwiseAND(_LOW)
    space = F.shiftright("key", 33).cast("byte").alias("space")
    near = alone.join(few.select("key", F.col("fp").alias("other")).hint("merge"), "key").where(
        (visit | (F.col("fp") < F.col("other"))) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE))
    direct = near.select(space, F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    if not any_crowd:
        return direct

    # A value that is shared: hubs in the other half. One bit is spent on a visit's own half.
    busy = probes.join(crowded.hint("merge"), "key").select("key", "fp", visit.alias("visit"), _half(F.col("fp"), F.col("key"), False).alias("rest"))
    hubs = busy.where(~F.col("visit")).select("key", "fp", "visit", F.inline(_within(F.col("rest"), 2)))
    hubs = hubs.union(busy.where("visit").select("key", "fp", "visit", F.inline(_within(F.col("rest"), 1))))
    at = ["key", "hub"]
    centre = hubs.where(~F.col("visit") & (F.col("d") <= 1)).groupBy(*at).agg(F.min("fp").alias("centre"))
    star = hubs.join(centre.hint("merge"), at).where("fp <> centre").select(
        space, F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    return direct.union(star).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and class: the smallest id reachable over links of at most three bits.

    Returns one row for each row of ``docs``: ``doc_id``, ``fingerprint`` (16 hexadecimal digits)
    and ``component_id``. NULL, empty and blank texts have fingerprint zero and are linked like any
    other. Repeated ids stay; a NULL id is kept, and is no one's ``component_id`` unless a class
    has no other. An empty table gives no rows. Columns other than the two named aren't read.
    """
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = hamming_links(first.select(F.lit(0).cast("byte").alias("space"), "fp"))
    roots = components(links.select("a", "b"))
    known = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    known = stored(known)
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = known.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
