"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared seeds (runs of five words). For each pair that meets,
the longest common runs of words are marked one after the other, none overlapping another, in
whatever order they stand in the document; an item counts as leaked if the marked runs cover at
least half of its words. So a passage is found although its parts were reordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_DIGIT, Runs, Words, bytes_of, filter_slots, packs, seed_filter, stored

SEED_WORDS, COVERAGE = 5, 0.5


def seeds_of(texts: list[bytes], k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each text its number, its count of words (of lower-cased letters and digits) and the hash of each run of ``k``."""
    for start, end in packs(texts):
        words = Words([t.lower() for t in texts[start:end]], LETTER_DIGIT)
        hashes = words.hashes()
        for i in range(end - start):
            own = hashes[words.first[i]:words.first[i + 1]]
            yield start + i, len(own), Runs(own).windows(k)


def _item_rows(parts: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = [(n, s.view(np.int64)) for _, n, s in seeds_of(bytes_of(df.text), k)]
        if rows:
            yield pd.DataFrame({"item_id": df.item_id, "n_words": [r[0] for r in rows], "seeds": [r[1] for r in rows]})


def _seed_rows(parts: Iterator[pd.DataFrame], k: int, bits: np.ndarray) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = []
        for i, _, seeds in seeds_of(bytes_of(df.text), k):
            a, b = filter_slots(seeds, len(bits))
            at = np.flatnonzero(bits[a] & bits[b])
            if len(at):
                rows.append((i, at, seeds[at].view(np.int64)))
        if rows:
            own = df.iloc[[r[0] for r in rows]]
            yield pd.DataFrame({"doc_id": own.doc_id.to_numpy(), "copy": own["copy"].to_numpy(), "at": [r[1] for r in rows], "seed": [r[2] for r in rows]})


class _Side:
    """One side of a comparison: seeds by position (0 where there is none) and words already marked."""

    def __init__(self, seeds: np.ndarray, present: np.ndarray, k: int) -> None:
        self.seeds, self.present, self.k = seeds, present, k
        self.marked = np.zeros(len(seeds) + k - 1, bool)
        self.runs = Runs(seeds)

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each unmarked run of ``words`` words whose seeds are all present."""
        n = words - self.k + 1
        at = np.arange(max(0, len(self.seeds) - n + 1))
        blocked = np.concatenate([[0], np.cumsum(self.marked)])
        missing = np.concatenate([[0], np.cumsum(~self.present)])
        at = at[(blocked[at + words] == blocked[at]) & (missing[at + n] == missing[at])]
        return at, self.runs.hashes(at, at + n)


def tile(at: np.ndarray, seeds: np.ndarray, item: np.ndarray, k: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """The tiles ``(item_start, doc_start, words)`` of one document and one item, longest first.

    ``at`` and ``seeds`` are the document's seeds that the item has as well, ``item`` all seeds of
    the item. Of tiles equally long, the first in the document and then in the item is marked first.
    """
    order = np.argsort(at, kind="stable")
    at, seeds = at[order], seeds[order]
    base = int(at[0])
    laid, present = np.zeros(int(at[-1]) - base + 1, np.uint64), np.zeros(int(at[-1]) - base + 1, bool)
    laid[at - base], present[at - base] = seeds, True
    doc, test = _Side(laid, present, k), _Side(item, np.ones(len(item), bool), k)
    out = []

    def longest(floor: int) -> int:
        """The most words, ``floor`` or more, of a common unmarked run (0: none); by halving, as shorter runs are within longer ones."""
        low, high = floor - 1, len(test.marked)
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(doc.windows(middle)[1], test.windows(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        return low if low >= floor else 0

    while words := longest(k):
        here, hashes = doc.windows(words)
        there: dict[int, list[int]] = {}
        for p, h in zip(*(x.tolist() for x in test.windows(words))):
            there.setdefault(h, []).append(p)
        for j, h in zip(here.tolist(), hashes.tolist()):
            for p in there.get(h, ()):
                n = words - k + 1
                if not doc.marked[j:j + words].any() and not test.marked[p:p + words].any() and (
                        doc.seeds[j:j + n] == test.seeds[p:p + n]).all():
                    doc.marked[j:j + words] = test.marked[p:p + words] = True
                    out.append((p, j + base, words))
                    break
        if not out or out[-1][2] != words:  # equal hashes of unequal runs: not seen, but it must end
            break
    return out


def _tile_rows(parts: Iterator[pd.DataFrame], k: int, coverage: float) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = []
        for doc_id, copy, item_id, n, item, hits in zip(df.doc_id, df["copy"], df.item_id, df.n_words, df.seeds, df.hits):
            at = np.fromiter((h["at"] for h in hits), np.int64, len(hits))
            seed = np.fromiter((h["seed"] for h in hits), np.int64, len(hits)).view(np.uint64)
            tiles = tile(at, seed, np.asarray(item, np.int64).view(np.uint64), k)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * n:
                rows.append((doc_id, copy, item_id, n, covered, covered / n, [dict(zip(("item_start", "doc_start", "words"), t)) for t in tiles]))
        yield pd.DataFrame(rows, columns=["doc_id", "copy", "item_id", "n_words", "n_covered", "coverage", "tiles"])


def leaked_items(docs: DataFrame, items: DataFrame, k: int = SEED_WORDS, coverage: float = COVERAGE, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which items each document leaks, and by which tiles.

    Returns ``doc_id, copy`` (a hash of the text: rows that share id and text give one row),
    ``item_id, n_words, n_covered, coverage, tiles``. NULL or empty texts and items of fewer than
    ``k`` words leak nothing. Rows of one item id with several texts are items of their own.
    Columns other than those named aren't read.
    """
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    tests = stored(tests.mapInPandas(partial(_item_rows, k=k), f"item_id {item_type}, n_words long, seeds array<long>")
                   .where(F.size("seeds") > 0).withColumn("item", F.monotonically_increasing_id()))
    index = stored(tests.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").agg(F.count("*").alias("times")))

    bits = seed_filter(index.select("seed"))
    found = texts.mapInPandas(partial(_seed_rows, k=k, bits=bits), f"doc_id {id_type}, copy long, at array<int>, seed array<long>")
    seeds = stored(found.distinct()).select("doc_id", "copy", F.inline(F.arrays_zip("at", "seed")))
    pairs = (seeds.join(index, "seed").groupBy("doc_id", "copy", "item")
             .agg(F.collect_list(F.struct("at", "seed", "times")).alias("hits")))
    schema = (f"doc_id {id_type}, copy long, item_id {item_type}, n_words long, n_covered long, coverage double, "
              "tiles array<struct<item_start:int,doc_start:int,words:int>>")
    # A pair's seeds bound what its tiles can cover.
    own = F.array_distinct(F.transform("hits", lambda h: F.struct(h["seed"], h["times"])))
    places = F.aggregate(own, F.lit(0).cast("long"), lambda total, h: total + h["times"])
    enough = places * k >= coverage * F.col("n_words")
    return pairs.join(tests, "item").where(enough).mapInPandas(partial(_tile_rows, k=k, coverage=coverage), schema)


def drop_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that leak an item; its columns stay as they are."""
    leaks = leaked_items(docs, items, id_col=id_col, text_col=text_col, **options)
    gone = stored(leaks.select(F.col("doc_id").alias("gone_id_"), F.col("copy").alias("gone_copy_")).distinct())
    same = docs[id_col].eqNullSafe(gone["gone_id_"]) & (F.xxhash64(docs[text_col]) == gone["gone_copy_"])
    return docs.join(gone, same, "left_anti")
