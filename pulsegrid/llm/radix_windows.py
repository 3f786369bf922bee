"""Repeated byte windows by a depth-limited radix sort over the most significant digits first.

Every window of ``width`` bytes is a suffix cut at the depth that matters. Passes split the
windows into ever finer groups, and what is alone in its group is done with:

1. by the window's anchor, the 32-byte gram with the smallest hash in it. Windows with one anchor
   stand side by side, so a run of them is one row;
2. by the whole context of the run. Runs with equal contexts need no finer pass: all of their
   windows repeat. Of several different contexts of one anchor, one run each goes on;
3. by the half of the context, left or right of the anchor, that the window must hold;
4. by blocks of ``GRID`` neighbouring windows: first by what all of them hold, then by what they
   hold together. Blocks that are equal as a whole are done, as in 2;
5. by the window itself. Equal groups are exactly the repeated windows.

Digits are 64-bit hashes, compared along the path (the window's with its anchor's), not bytes.
Every pass counts before it joins, so a gram or window that is everywhere is no hot group. Texts
without a repeated anchor are done after the first pass and aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, bytes_of, filter_slots, mixed, seed_filter, stored

WIDTH, GRAM = 400, 32
#: Texts are worked through in parts of so many window starts.
PART = 1 << 18
#: Windows of a block.
GRID = 16


def _parts(data: bytes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """First window start and bytes of each part; together they have every window once."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole) - width + 1, PART):
        yield start, whole[start:start + PART + width - 1]


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` neighbours."""
    reach, out = 1, values
    while 2 * reach <= span:
        out = np.minimum(out[:len(out) - reach], out[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def runs_of(data: bytes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: ``anchor, low, high`` (starts), and the hashes of gram, context, left and right half.

    A half's hash is 0 where no window of the run holds it.
    """
    out: list[tuple[np.ndarray, ...]] = []
    half = (width - gram) // 2
    for base, own in _parts(data, width):
        hashes = byte_runs(own)
        grams = hashes.windows(gram)
        # The place in the low bits: of equal grams the first is the anchor.
        keys = (grams >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
        at = (_smallest(keys, width - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        anchor, low, high = at[first], first, np.append(first[1:], len(at)) - 1
        context = mixed(hashes.hashes(low, high + width) + mixed((anchor - low).astype(np.uint64)))
        left, right = np.zeros(len(anchor), np.uint64), np.zeros(len(anchor), np.uint64)
        has = anchor - low >= half
        left[has] = hashes.hashes(anchor[has] - half, anchor[has] + gram)
        has = anchor - high < half
        right[has] = hashes.hashes(anchor[has], anchor[has] + width - half + 1)
        out.append((anchor + base, low + base, high + base, grams[anchor], context, left, right))
    if not out:
        return tuple(np.zeros(0, np.int64 if i < 3 else np.uint64) for i in range(7))
    return tuple(np.concatenate(c) for c in zip(*out))


def _gram_rows(parts: Iterator[pd.DataFrame], width: int, gram: int) -> Iterator[pd.DataFrame]:
    for df in parts:
        for a in range(0, len(df), 256):
            grams = [runs_of(data, width, gram)[3] for data in bytes_of(df.text.iloc[a:a + 256])]
            yield pd.DataFrame({"seed": np.concatenate(grams).view(np.int64)})


DIGITS = ("gram", "context", "left", "right")


def _scan_rows(parts: Iterator[pd.DataFrame], width: int, gram: int, repeated: np.ndarray, keep_text: bool) -> Iterator[pd.DataFrame]:
    """For each text its size, hash and the runs whose anchor may repeat; the text itself if there are any (or it is asked for)."""
    for df in parts:
        rows = []
        for data, text in zip(bytes_of(df.text), df.text):
            anchor, low, high, *digits = runs_of(data, width, gram)
            a, b = filter_slots(digits[0], len(repeated))
            at = np.flatnonzero(repeated[a] & repeated[b])
            columns = [x[at].tolist() for x in (anchor, low, high)] + [d[at].view(np.int64).tolist() for d in digits]
            runs = [dict(zip(("anchor", "low", "high", *DIGITS), r)) for r in zip(*columns)]
            rows.append((len(data), hashlib.sha256(data).hexdigest(), runs, text if runs or keep_text else None))
        made = pd.DataFrame(rows, columns=["n_bytes", "sha", "runs", "text"])
        yield pd.concat([df[["doc_id", "copy"]].reset_index(drop=True), made], axis=1)


def _block_rows(parts: Iterator[pd.DataFrame], width: int, grid: int) -> Iterator[pd.DataFrame]:
    """The windows of one text's open ranges in blocks of ``grid`` by their distance from the anchor.

    ``core`` is what every window of the whole block holds, ``hull`` all that those of the range
    hold together; with a grid of 1 both are the window.
    """
    for df in parts:
        for doc_id, copy, text, ranges in zip(df.doc_id, df["copy"], df.text, df.ranges):
            hashes = byte_runs(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
            anchor, low, high, gram = (np.array([r[n] for r in ranges], np.int64) for n in ("anchor", "low", "high", "gram"))
            first = (anchor - high) // grid
            count = (anchor - low) // grid - first + 1
            of = np.repeat(np.arange(len(ranges)), count)
            block = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            anchor, gram = anchor[of], gram[of]
            far, near = anchor - block * grid - grid + 1, anchor - block * grid  # first and last start of the whole block
            low, high = np.maximum(low[of], far), np.minimum(high[of], near)
            for a in range(0, len(of), 1 << 16):
                i = slice(a, a + (1 << 16))
                place = block[i].astype(np.uint64)
                clip = ((anchor[i] - low[i]) * width + (anchor[i] - high[i])).astype(np.uint64)
                core = mixed(hashes.hashes(near[i], far[i] + width) + mixed(place))
                hull = mixed(hashes.hashes(low[i], high[i] + width) + mixed(clip))
                yield pd.DataFrame({"doc_id": doc_id, "copy": copy, "gram": gram[i], "anchor": anchor[i], "low": low[i], "high": high[i],
                                    "core": core.view(np.int64), "hull": hull.view(np.int64)})


def _removals(parts: Iterator[pd.DataFrame], width: int, digest: bool) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = []
        for data, ranges in zip(bytes_of(df.text), df.ranges):
            edge = np.zeros(len(data) + 1, np.int64)
            if ranges is not None:
                np.add.at(edge, [r["low"] for r in ranges], 1)
                np.add.at(edge, [r["high"] + width for r in ranges], -1)
            gone = np.cumsum(edge[:-1]) > 0
            step = np.diff(gone.astype(np.int8), prepend=0, append=0)
            begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = hashlib.sha256(kept).hexdigest() if digest else [{"start": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist())]
            rows.append((len(data), int(gone.sum()), len(begins), spans) if digest else (spans, kept))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["spans", "kept"]
        yield pd.concat([df[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)


def _split(rows: DataFrame, group: list[str], unit: str, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pass: the rows that are equal to another one in ``unit``, and those that go on.

    Of each group that still holds several different units, one row for each unit goes on (a unit
    that repeats must be met by the others' parts); a group of one unit is done.
    """
    row = F.min(F.struct(*carried)).alias("row")
    units = stored(rows.groupBy(*group, unit).agg(F.count("*").alias("n"), row))
    equal = rows.join(units.where("n > 1").select(*group, unit), [*group, unit]).select("doc_id", "copy", "low", "high")
    several = units.groupBy(*group).agg(F.count("*").alias("units")).where("units > 1").select(*group)
    return equal, units.join(several, group).select("gram", "row.*")


def repeated_ranges(scanned: DataFrame, width: int, gram: int) -> DataFrame:
    """Ranges ``(doc_id, copy, low, high)`` of window starts of ``scanned(doc_id, copy, text, runs)`` whose windows occur twice or more."""
    kind = scanned.schema["doc_id"].dataType.simpleString()
    runs = scanned.select("doc_id", "copy", F.inline("runs"))
    place = ["doc_id", "copy", "low", "high", "anchor"]
    equal, contexts = _split(runs, ["gram"], "context", [*place, "left", "right"])

    # A window that begins `half` or more bytes before its anchor holds the left half, any other the right one.
    turn = F.col("anchor") - (width - gram) // 2
    side = lambda name, low, high: F.struct(
        F.lit(name == "left").alias("is_left"), F.col(name).alias("digit"), low.alias("low"), high.alias("high"))
    sides = contexts.select("gram", "doc_id", "copy", "anchor", F.inline(F.array(
        side("left", F.col("low"), F.least("high", turn)), side("right", F.greatest("low", turn + 1), F.col("high"))))).where("low <= high")
    halves = ["gram", "is_left", "digit"]
    sides = stored(sides)
    shared = sides.groupBy(*halves).agg(F.count("*").alias("n")).where("n > 1").select(*halves)
    open_ranges = sides.join(shared, halves)

    def blocks(ranges: DataFrame, grid: int) -> DataFrame:
        gathered = ranges.groupBy(F.col("doc_id").alias("in_doc"), F.col("copy").alias("in_copy")).agg(
            F.collect_list(F.struct("anchor", "low", "high", "gram")).alias("ranges"))
        same = scanned["doc_id"].eqNullSafe(gathered["in_doc"]) & (scanned["copy"] == gathered["in_copy"])
        texts = scanned.where(F.size("runs") > 0).join(gathered, same).select("doc_id", "copy", "text", "ranges")
        return stored(texts.mapInPandas(partial(_block_rows, width=width, grid=grid), (
            f"doc_id {kind}, copy long, gram long, anchor int, low int, high int, core long, hull long")))

    found, left = _split(blocks(open_ranges, GRID), ["gram", "core"], "hull", place)
    windows = blocks(left, 1)
    twice = windows.groupBy("gram", "core").agg(F.count("*").alias("n")).where("n > 1").select("gram", "core")
    single = windows.join(twice, ["gram", "core"]).select("doc_id", "copy", "low", "high")
    return equal.union(found).union(single)


def _removed(docs: DataFrame, width: int, gram: int, id_col: str, text_col: str, digest: bool, fields: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    grams = texts.where(F.octet_length("text") >= width).mapInPandas(partial(_gram_rows, width=width, gram=gram), "seed long")
    repeated = seed_filter(grams.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
    run = ", ".join(f"{n}:{'bigint' if n in DIGITS else 'int'}" for n in ("anchor", "low", "high", *DIGITS))
    scanned = stored(texts.mapInPandas(
        partial(_scan_rows, width=width, gram=gram, repeated=repeated, keep_text=not digest),
        f"doc_id {kind}, copy long, n_bytes long, sha string, runs array<struct<{run}>>, text string"))
    ranges = repeated_ranges(scanned, width, gram).groupBy(F.col("doc_id").alias("in_doc"), F.col("copy").alias("in_copy")).agg(
        F.collect_set(F.struct("low", "high")).alias("ranges"))
    mine = scanned.where(F.size("runs") > 0) if digest else scanned
    same = mine["doc_id"].eqNullSafe(ranges["in_doc"]) & (mine["copy"] == ranges["in_copy"])
    done = mine.join(ranges, same, "left").select("doc_id", "text", "ranges").mapInPandas(
        partial(_removals, width=width, digest=digest), f"doc_id {kind}, {fields}")
    if not digest:
        return done
    rest = scanned.where(F.size("runs") == 0).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return done.union(rest)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, kept`` for each row: removed byte spans ``(start, end)`` and the bytes that stay.

    A byte goes if a window of ``width`` bytes over it also starts anywhere else in the input.
    NULL counts as empty; texts shorter than ``width`` stay whole. Repeated rows are copies of
    each other. Other columns aren't read.
    """
    return _removed(docs, width, gram, id_col, text_col, False, "spans array<struct<start:int,end:int>>, kept binary")


def repeat_digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of what ``remove_repeats`` gives, without carrying it."""
    return _removed(docs, width, gram, id_col, text_col, True, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
