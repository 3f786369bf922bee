from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD

from pulsegrid.llm import presence_masks as pm

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=10):
    """The definition: every document against every item."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    big_n, big_l = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms_of(text))
    out = []
    for item_id, terms in asked.items():
        found = []
        for (doc_id, c), n in zip(counts, lengths):
            m = 100 - 90 + ((90 * n * big_n) // big_l if big_l else 0)
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], 0 if x[2] is None else x[2]))
        out += [(item_id, k + 1, f[2], -f[0]) for k, f in enumerate(found[:top])]
    return sorted(out, key=str)


def got(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


def world(seed, n=400, vocabulary=60, wide=False):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéZ日09") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    prose = lambda k: rng.choice(" -_.").join(rng.choice(words[:1 + int(rng.random() ** 3 * vocabulary)]) for _ in range(k))
    docs = [(i, prose(rng.randrange(40))) for i in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(n // 3)]  # groups of copies: ties
    docs += [(2 * n + k, t) for k, t in enumerate(ODD)]
    items = [(k, prose(rng.randrange(1, 90 if wide else 20))) for k in range(25)]
    return docs, items + [(100, None), (101, ""), (102, "--"), (103, "nowhere"), (3, "same ID again"), (3, "same ID again")]


@pytest.mark.parametrize("seed, wide, block, pilot, item_bytes", [(1, False, 8192, 64, 1 << 22), (2, True, 50, 3, 1 << 22), (3, False, 7, 1, 300), (4, True, 1, 10**6, 1000)])
def test_against_every_pair(spark, corpus, seed, wide, block, pilot, item_bytes):
    docs, items = world(seed, wide=wide)
    frame = corpus([t for _, t in docs], [i for i, _ in docs]).withColumnRenamed("source", "terms").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(pm.search_documents(frame, asked, block=block, pilot=pilot, item_bytes=item_bytes)) == expected(docs, items)


def test_test_table(spark, corpus, sample):
    docs = list(zip(sample.doc_id.tolist(), sample.text.tolist()))
    items = [(k, t[:300]) for k, (_, t) in enumerate(docs[::9])]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(pm.search_documents(corpus([t for _, t in docs], [i for i, _ in docs]), asked)) == expected(docs, items)


def test_missing_and_repeated_ids(spark):
    docs = [(None, "one two"), (None, "one two"), (5, "one two"), (5, "one two"), (2**62 + 1, "one"), (2**62, "one"), (8, None)] + [(100 + k, f"other{k}") for k in range(9)]
    items = [(None, "one two"), (1, "ONE")]
    frame = spark.createDataFrame(docs, "score long, item string")
    asked = spark.createDataFrame(items, "rank long, doc_id string")
    rows = pm.search_documents(frame, asked, id_col="score", text_col="item", item_col="rank", item_text_col="doc_id")
    assert got(rows) == expected(docs, items)


def test_more_ties_than_places(spark):
    docs = [(k, "tie here") for k in range(500, 0, -1)] + [(1000 + k, f"w{k}") for k in range(600)]
    items = [(1, "tie"), (2, "here tie w3")]
    rows = pm.search_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), block=64)
    assert got(rows) == expected(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty_tables(spark, docs, items):
    rows = pm.search_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and rows.count() == 0


def test_masks_spare_documents():
    """Only documents whose masks can reach the last place are scored."""
    rng = np.random.default_rng(0)
    n, v = 5000, 12
    there = rng.random((n, v)) < np.linspace(0.02, 0.6, v)
    per_doc = there.sum(axis=1)
    terms = np.nonzero(there)[1].astype(np.int32)
    weights = np.linspace(9000, 100, v).astype(np.int64)
    block = pm.DocumentBlock(list(range(n)), np.full(n, 50), per_doc, terms, np.ones(len(terms), np.int32), weights, n, 50 * n)
    item, scored = np.arange(v), []
    whole = block.scores
    block.scores = lambda docs, own: scored.append(len(docs)) or whole(docs, own)
    best = pm.search_block(block, item, np.ones(v, bool), [], 0, 10)
    every = sorted(pm.rank_key(int(s), d) for d, s in enumerate(whole(np.arange(n), np.ones(v, bool))) if s > 0)
    assert best == every[:10] and sum(scored) < 300
