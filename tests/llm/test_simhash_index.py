from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD

from pulsegrid.llm import simhash_index as sh


def by_hand(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def check(corpus, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    got = sh.near_duplicate_classes(corpus(texts, ids)).collect()
    prints = [by_hand(t) for t in texts]
    want = sorted(map(repr, zip(ids, (f"{p:016x}" for p in prints), classes_by_hand(ids, prints))))
    assert sorted(repr(tuple(r)) for r in got) == want


def test_sample(corpus, sample):
    check(corpus, list(sample.text), list(sample.doc_id))


def test_odd_texts_and_ids(corpus):
    check(corpus, ODD)
    check(corpus, ["a b c d", "a b c d", "x y z"], [None, 7, None])
    assert sh.near_duplicate_classes(corpus([])).count() == 0


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_give_all_components(spark, monkeypatch, crowd):
    """Crowded segment values meet at hubs: the components stay those of all links."""
    monkeypatch.setattr(sh, "CROWD", crowd)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(centre)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(0, s) for s in signed], "space tinyint, fp long")
    links = [(r.a, r.b) for r in sh.hamming_links(df).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in links)
    roots = {r.node: r.root for r in sh.components(sh.hamming_links(df).select("a", "b")).collect()}
    want = classes_by_hand(list(range(len(prints))), prints)
    got = [roots.get(s, s) for s in signed]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))
