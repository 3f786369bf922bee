"""Ranked lexical search by groups of documents that hold the same terms of an item.

Documents are read once per block of items and kept as the terms of those items that they hold, with
their counts. Scoring takes some thousand documents at a time. For an item, each term's documents
set that term's bit, which gives every document a mask of the terms that it holds; documents of equal
mask form a group, and the largest worth of each term gives each distinct mask the highest score that
its documents can have. Masks are evaluated in descending order of that, exactly, until the next one
can't reach the score of the last place. A pilot over every ``PILOT``-th document sets what the last
place is at least worth, so that tasks give rows for what may be ranked, not for each task its own best.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER_DIGIT, Words, byte_runs, packs, small_batches, stored

#: Places of a ranking, documents of a block, one in how many documents is in the pilot.
TOP, BLOCK, PILOT = 10, 8192, 64
#: Bytes of items that are searched at once.
ITEM_BYTES = 1 << 22
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


# ---- terms ----------------------------------------------------------------------------------

class Vocabulary:
    """The terms of some items, numbered in the order of their hashes."""

    def __init__(self, terms: list[bytes]) -> None:
        lengths = np.array([len(t) for t in terms], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(terms), np.uint8)
        hashes = byte_runs(data).hashes(ends - lengths, ends) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.lengths = hashes[order], lengths[order]
        self.starts, self.data = (ends - lengths)[order], data
        self.number = {terms[k]: i for i, k in enumerate(order.tolist())}
        if len(np.unique(hashes)) != len(terms):
            raise ValueError("two terms of one block have the same 64-bit hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the number of each such term; compared byte by byte."""
        if not len(self.hashes) or not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == words.ends - words.starts))
        term = at[hit]
        same = np.ones(len(hit), bool)
        lengths = self.lengths[term]
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            step = max(1, (1 << 22) // n)
            for i in range(0, len(own), step):
                some, reach = own[i:i + step], np.arange(n)
                same[some] = (words.data[words.starts[hit[some], None] + reach] == self.data[self.starts[term[some], None] + reach]).all(axis=1)
        return hit[same], term[same]


_COUNTS = "n bigint, terms array<int>, times array<int>"


def _count_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    size = max(len(vocabulary.hashes), 1)
    for batch in batches:
        texts = [(t or b"").lower() for t in batch.column(1).to_pylist()]  # of bytes, lower() changes A-Z only
        n, per_doc, terms, times = [], [], [], []
        for a, b in packs(texts):
            words = Words(texts[a:b], LETTER_DIGIT)
            hit, term = vocabulary.find(words)
            doc = np.searchsorted(words.first, hit, side="right") - 1
            key, count = np.unique(doc * size + term, return_counts=True)
            n.append(np.diff(words.first))
            per_doc.append(np.bincount(key // size, minlength=b - a))
            terms.append((key % size).astype(np.int32))
            times.append(count.astype(np.int32))
        if texts:
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(per_doc))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), *lists], ["doc_id", "n", "terms", "times"])


# ---- scores ---------------------------------------------------------------------------------

def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class DocumentBlock:
    """Some documents, with what each of their terms is worth, by document and by term."""

    def __init__(self, ids: list, n: np.ndarray, per_doc: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids = ids
        self.first = np.concatenate([[0], np.cumsum(per_doc)])
        doc = np.repeat(np.arange(len(ids)), per_doc)
        m = 10 + 90 * n * n_docs // max(n_terms, 1)
        times = times.astype(np.int64)
        self.terms = terms
        self.worth = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.docs = doc[order]
        ends = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.of_term = ends
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, terms, self.worth)

    def masks(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents with a term of ``item``, and the mask of each: a bit per term, in bytes."""
        mask = np.zeros((len(self.ids), -(-len(item) // 8)), np.uint8)
        for k, t in enumerate(item.tolist()):
            mask[self.docs[self.of_term[t]:self.of_term[t + 1]], k >> 3] |= 1 << (k & 7)
        docs = np.flatnonzero(mask.any(axis=1))
        return docs, mask[docs]

    def highest(self, masks: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The highest score that documents of each mask can have, from a table for each byte."""
        out = np.zeros(len(masks), np.int64)
        for k in range(masks.shape[1]):
            own = np.zeros(8, np.int64)
            part = self.most[item[8 * k:8 * k + 8]]
            own[:len(part)] = part
            out += (_BITS @ own)[masks[:, k]]
        return out

    def scores(self, docs: np.ndarray, in_item: np.ndarray) -> np.ndarray:
        lengths = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1])) + np.repeat(self.first[docs] - (ends - lengths), lengths)
        total = np.concatenate([[0], np.cumsum(self.worth[at] * in_item[self.terms[at]])])
        return total[ends] - total[ends - lengths]


_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def _groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct masks, the rows in the order of their masks, and where each mask's rows begin."""
    width = -(-masks.shape[1] // 8) * 8
    wide = np.zeros((len(masks), width), np.uint8)
    wide[:, :masks.shape[1]] = masks
    words = wide.view(np.uint64)
    order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
    own = words[order]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
    return masks[order[starts]], order, np.append(starts, len(order))


def rank_key(score: int, doc_id) -> tuple:
    """Highest score first, then the smallest id, a missing one last."""
    return (-score, True, 0) if doc_id is None else (-score, False, doc_id)


def search_block(block: DocumentBlock, item: np.ndarray, in_item: np.ndarray, best: list, floor: int, top: int) -> list:
    """``best`` (keys as of ``rank_key``) with what ``block`` adds to it, by masks in descending order of their highest score."""
    docs, masks = block.masks(item)
    if not len(docs):
        return best
    distinct, rows, starts = _groups(masks)
    highest = block.highest(distinct, item)
    order = np.argsort(-highest, kind="stable")
    highest, sizes = highest[order], np.diff(starts)[order]
    reached, at, step = np.cumsum(sizes), 0, 4 * top
    while at < len(order):
        least = max(floor, -best[-1][0] if len(best) == top else 1)
        open_masks = int(np.searchsorted(-highest, -least, side="right"))  # those that can reach the last place
        until = min(open_masks, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + step)) + 1)
        if until <= at:
            break
        own = docs[np.concatenate([rows[starts[g]:starts[g + 1]] for g in order[at:until].tolist()])]
        scores = block.scores(own, in_item)
        able = np.flatnonzero(scores >= least)
        best = nsmallest(top, [*best, *(rank_key(s, block.ids[d]) for s, d in zip(scores[able].tolist(), own[able].tolist()))])
        at, step = until, 2 * step
    return best


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            if n and n + part.num_rows > size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _search_batches(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int,
                    floors: np.ndarray, top: int, size: int) -> Iterator[pa.RecordBatch]:
    best: list[list] = [[] for _ in items]
    kind = None
    in_item = np.zeros(len(weights), bool)
    for made in _blocks(batches, size):
        kind = made.schema.field("doc_id").type
        terms, times = (made.column(c).combine_chunks() for c in ("terms", "times"))
        block = DocumentBlock(
            made.column("doc_id").to_pylist(), made.column("n").to_numpy(), terms.value_lengths().to_numpy(zero_copy_only=False),
            terms.flatten().to_numpy(), times.flatten().to_numpy(), weights, n_docs, n_terms)
        for k, item in enumerate(items):
            in_item[item] = True
            best[k] = search_block(block, item, in_item, best[k], int(floors[k]), top)
            in_item[item] = False
    if kind is not None:
        rows = [(k, None if missing else doc_id, -score) for k, own in enumerate(best) for score, missing, doc_id in own]
        if rows:
            number, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


# ---- the operator ---------------------------------------------------------------------------

def _item_blocks(items: DataFrame, item_bytes: int) -> Iterator[pa.Table]:
    """The items in parts of about ``item_bytes``; rows of one id are in one part."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // item_bytes) + 1
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow()


def search_terms(text: bytes | None) -> set[bytes]:
    return set(_TERM.findall((text or b"").lower()))


def _ranked(found: DataFrame, key: str, top: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _search(docs: DataFrame, kind: str, table: pa.Table, top: int, size: int, pilot: int) -> DataFrame | None:
    terms: dict = {}
    for item_id, text in zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()):
        terms.setdefault(item_id, set()).update(search_terms(text))
    ids = [i for i, own in terms.items() if own]
    if not ids:
        return None
    vocabulary = Vocabulary(sorted(set().union(*(terms[i] for i in ids))))
    items = [np.array(sorted(vocabulary.number[t] for t in terms[i]), np.int64) for i in ids]
    counts = stored(docs.mapInArrow(partial(_count_batches, vocabulary=vocabulary), f"doc_id {kind}, {_COUNTS}"))
    totals = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(vocabulary.hashes), np.int64)
    for row in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of these items
        df[row["t"]] = row["count"]
    weights = np.array([term_weight(totals.docs, int(x)) for x in df], np.int64)
    # Terms of great weight first, so that the masks of a byte differ in what is worth most.
    items = [i[np.argsort(-weights[i], kind="stable")] for i in items]
    holding = counts.where(F.size("terms") > 0)
    search = partial(_search_batches, items=items, weights=weights, n_docs=totals.docs, n_terms=totals.terms or 0, top=top, size=size)

    def found(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        return rows.mapInArrow(partial(search, floors=floors), f"item int, doc_id {kind}, score bigint")

    floors = np.zeros(len(items), np.int64)
    some = holding.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(pilot)) == 0)
    for row in _ranked(found(some, floors), "item", top).where(F.col("rank") == top).collect():  # a row an item
        floors[row["item"]] = row["score"]
    best = _ranked(found(holding, floors), "item", top)
    names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, table.schema.field("item_id").type)}))
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", item_bytes: int = ITEM_BYTES, block: int = BLOCK, pilot: int = PILOT) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item its ``top`` documents of score above 0, equal scores by id.

    Items with the same id are one item of all their terms; items and documents without a term (NULL,
    empty) have no rows. Every row of ``docs`` is a document of its own, repeated ones included; a
    missing id comes last among equal scores. Empty tables give no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    out = docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    for part in _item_blocks(asked, item_bytes):
        made = _search(rows, kind, part, top, block, pilot)
        out = out if made is None else out.union(made)
    return out


def search_sql(top: int = TOP) -> str:
    """DuckDB SQL for the rows of ``search_documents`` over ``documents`` and ``benchmark``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark),
v AS (SELECT DISTINCT t FROM q),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN v USING (t) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY t),
g AS (SELECT p.r, p.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w)::BIGINT * big_n) // big_l))) AS x FROM p JOIN f USING (t) JOIN d USING (r), s),
c AS (SELECT item_id, doc_id, r, CAST(sum(x) AS BIGINT) AS score FROM g JOIN q USING (t) JOIN d USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {top}"""
