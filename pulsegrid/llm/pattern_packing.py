"""Packing documents into sequences of fixed capacity by patterns of a few lengths.

Only how many pieces there are of each length decides how they are packed. Patterns of up to three
lengths that fill a sequence to the last token are enumerated; how often each is used is fitted to
the histogram of lengths by non-negative least squares, weighted by length, and rounded to what
there is; the pieces left over are packed best fit, longest first, whole classes of equal lengths
and equal sequences at a time. All of this is as large as the capacity allows, however many
documents there are. Which piece goes where then follows from its rank among those of its length:
ranks are counted in the tasks that cut the pieces, and start where the tasks before have ended.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_encoder import byte_encoder
from .common import small_batches, stored

#: Tokens of a sequence, and the id that ends every document.
CAPACITY, END = 2048, 0
#: Rounds of fitting, patterns looked at in each, and the share of all tokens whose fit may still change.
ROUNDS, LOOKED_AT, SETTLED = 400, 4096, 1e-5


# ---- pieces ---------------------------------------------------------------------------------

_NUMBERS = ("piece", "start", "length", "ids_crc32", "part", "nth")


def _cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Starts and lengths of a document of ``n`` tokens: whole pieces, before them what is over."""
    at, length = 0, n % capacity or min(n, capacity)
    while at < n:
        yield at, length
        at, length = at + length, capacity


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, end = byte_encoder(path), np.array([END], "<u4").tobytes()
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        rows, at, ids = [], [], []
        for i, text in enumerate(batch.column(1)):
            encoded = encoder.encode(text.as_py() or "") + end
            for piece, (start, length) in enumerate(_cut(len(encoded) // 4, capacity)):
                own = encoded[4 * start:4 * (start + length)]
                rows.append((piece, start, length, zlib.crc32(own), part, seen[length]))
                seen[length] += 1
                at.append(i)
                if keep_ids:
                    ids.append(np.frombuffer(own, "<u4").astype(np.int32))
        columns = [batch.column(0).take(pa.array(at, pa.int64()))]
        numbers = np.array(rows, np.int64).reshape(-1, len(_NUMBERS))
        columns += [pa.array(numbers[:, k]) for k in range(len(_NUMBERS))]
        if keep_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_NUMBERS, *["ids"] * keep_ids])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth`` of each piece, stored; ``nth`` counts the pieces of equal length in ``part``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join([f"doc_id {docs.schema[id_col].dataType.simpleString()}", *(f"{n} bigint" for n in _NUMBERS), *["ids array<int>"] * keep_ids])
    return stored(rows.mapInArrow(partial(_piece_batches, path=path, capacity=capacity, keep_ids=keep_ids), fields))


# ---- patterns -------------------------------------------------------------------------------

class Pattern(NamedTuple):
    """``repeats`` sequences that each hold ``lengths``: pairs of a length and how many of it."""

    lengths: tuple[tuple[int, int], ...]
    repeats: int


def full_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` with two or three of the lengths ``present``, as ascending rows; a pair's first entry is 0."""
    there = np.zeros(capacity + 1, bool)
    there[present[present < capacity]] = True
    there[0] = True  # stands for no piece
    rows = []
    for a in np.flatnonzero(there[:capacity // 3 + 1]):
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        b = b[there[b] & there[capacity - a - b]]
        rows.append(np.stack([np.full(len(b), a), b, capacity - a - b], axis=1))
    return np.concatenate(rows).astype(np.int32)


def fit(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats of each pattern that come closest to ``counts`` (by length) in least squares, none below zero.

    A round takes the patterns of the largest gain that share no length and moves each to its own
    minimum, so the error never grows. A length weighs as much as it fills.
    """
    repeats = np.zeros(len(patterns))
    if not len(patterns):
        return repeats
    weight = np.arange(len(counts)) / len(counts)
    weight[0] = 0.0
    a, b, c = patterns.T
    # The square of a pattern's column: a length that stands twice counts four times.
    twice, twice_high, thrice = (a == b) & (a > 0), (b == c), (a == b) & (b == c)
    norm = weight[a] + weight[b] + weight[c] + 2 * weight[b] * twice + 2 * weight[b] * twice_high + 2 * weight[b] * thrice
    left = counts.astype(float)
    tokens = float((counts * np.arange(len(counts))).sum())
    for _ in range(ROUNDS):
        pull = left * weight
        step = np.maximum((pull[a] + pull[b] + pull[c]) / norm, -repeats)
        gain = step * step * norm
        some = np.argpartition(-gain, min(LOOKED_AT, len(gain)) - 1)[:LOOKED_AT]
        some = some[gain[some] > 0]
        some = some[np.argsort(-gain[some], kind="stable")]
        taken, chosen = set(), []
        for p, row in zip(some.tolist(), patterns[some].tolist()):
            own = {x for x in row if x}
            if taken.isdisjoint(own):
                taken |= own
                chosen.append(p)
        moved = step[chosen]
        repeats[chosen] += moved
        np.subtract.at(left, patterns[chosen], moved[:, None])
        if np.abs(moved).sum() * len(counts) <= SETTLED * tokens:
            break
    return repeats


def rounded(patterns: np.ndarray, repeats: np.ndarray, counts: np.ndarray) -> list[Pattern]:
    """Whole repeats, the most used pattern first, of the pieces there are; takes them from ``counts``."""
    made = []
    used = np.flatnonzero(repeats >= 0.5)
    for p in used[np.argsort(-repeats[used], kind="stable")].tolist():
        row = [x for x in patterns[p].tolist() if x]
        own = [(x, row.count(x)) for x in sorted(set(row), reverse=True)]
        n = min(round(repeats[p]), *(int(counts[x]) // m for x, m in own))
        if n:
            made.append(Pattern(tuple(own), n))
            for x, m in own:
                counts[x] -= n * m
    return made


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of the pieces in ``counts``, longest first; equal sequences are one entry throughout.

    A step either fills a class of equal sequences, places a length's last pieces, or opens new
    sequences, so there are some entries per length, not per piece.
    """
    classes: dict[int, list[list]] = {}  # by room: [lengths, repeats]
    state = np.zeros(capacity + 1, np.int64)  # classes by room

    def put(room: int, lengths: tuple, repeats: int) -> None:
        classes.setdefault(room, []).append([lengths, repeats])
        state[room] += 1

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(state[length:])
            if len(fitting):
                room = length + int(fitting[0])
                lengths, repeats = classes[room].pop()
                state[room] -= 1
            else:
                room, lengths, repeats = capacity, (), left  # as many new sequences as could be needed
            each = min(room // length, left)
            full = min(left // each, repeats)
            put(room - each * length, (*lengths, (length, each)), full)
            left -= full * each
            if repeats > full and lengths:
                put(room, lengths, repeats - full)
    return [Pattern(lengths, repeats) for own in classes.values() for lengths, repeats in own]


def packing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that use every piece in ``counts`` (pieces by length, to ``capacity``) once.

    Two fits are rounded and filled up, one of all patterns and one of those with a piece longer than
    half a sequence (where such pieces are many, what fits beside them shouldn't go elsewhere); the
    one with fewer sequences is taken.
    """
    short = counts.astype(np.int64)
    whole = [Pattern(((capacity, 1),), int(short[capacity]))] if short[capacity] else []
    short[capacity] = 0
    patterns = full_patterns(np.flatnonzero(short), capacity)
    made = []
    for some in (patterns, patterns[patterns[:, 2] > capacity // 2]):
        left = short.copy()
        made.append(rounded(some, fit(some, left), left) + best_fit(left, capacity))
    return whole + min(made, key=lambda m: sum(p.repeats for p in m))


# ---- places ---------------------------------------------------------------------------------

#: Bits for the rank of a piece among those of its length.
_RANK = 46


class Places:
    """Sequence and offset for a length and a rank: runs of ranks, each at one place of one pattern."""

    def __init__(self, patterns: list[Pattern], capacity: int) -> None:
        rank, first, runs = np.zeros(capacity + 1, np.int64), 0, []
        for p in patterns:
            offset = 0
            for length, each in p.lengths:
                runs.append(((length << _RANK) + int(rank[length]), first, each, offset))
                rank[length] += each * p.repeats
                offset += length * each
            first += p.repeats
        self.n_sequences = first
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 4)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << _RANK) + rank
        start, first, each, offset = self.runs[np.searchsorted(self.runs[:, 0], key, side="right") - 1].T
        nth = key - start
        return first + nth // each, offset + nth % each * length


def _place_batches(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            rest = batch.drop_columns(["rank"])
            yield rest.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece, and its ``ids`` if kept.

    A document is its ids and the id 0; one of more than ``capacity`` tokens is cut, and then only
    its first piece may be shorter. Each sequence is filled from 0 without gaps. NULL counts as
    empty: a piece of the id 0 alone. Rows that are repeated are documents of their own; an empty
    table has no rows. Other columns aren't read.
    """
    pieces = token_pieces(docs, path, capacity, id_col, text_col, keep_ids)
    counts = stored(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row.length] = row.n
    places = Places(packing(histogram, capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("before") + F.col("nth")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, " + "ids array<int>, " * keep_ids + "sequence_id bigint, offset bigint"
    return ranked.mapInArrow(partial(_place_batches, places=places), fields)
