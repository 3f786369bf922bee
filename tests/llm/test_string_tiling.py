from __future__ import annotations

import random

import pytest
from conftest_llm import ODD

from pulsegrid.llm import string_tiling as st


def tiles_by_hand(doc, item, k=st.SEED_WORDS):
    """Greedy string tiling, word by word."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = 0, 0, 0
        for j in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while j + n < len(doc) and p + n < len(item) and doc[j + n] == item[p + n] and not used_d[j + n] and not used_i[p + n]:
                    n += 1
                best = max(best, (n, -j, -p))
        n, j, p = best[0], -best[1], -best[2]
        if n < k:
            return out
        used_d[j:j + n], used_i[p:p + n] = [True] * n, [True] * n
        out.append((p, j, n))


@pytest.fixture
def items(spark):
    return lambda texts: spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_against_brute_force(corpus, items):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    tests = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 40))] for _ in range(12)]
    tests.append(["a", "b"] * 10)
    docs = []
    for t in tests:
        cut = len(t) // 2
        filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
        docs += [
            filler(9) + t + filler(9),  # whole
            filler(5) + t[cut:] + filler(8) + t[:cut] + filler(3),  # reordered
            filler(20) + t[:cut // 2] + filler(20),  # a small part
            t[:cut] + t[:cut] + filler(4) + t[cut:],  # a part twice
        ]
    got = {(r.doc_id, r.item_id): [tuple(t) for t in r.tiles] for r in st.leaked_items(
        corpus([", ".join(d).upper() for d in docs]), items([" ".join(t) for t in tests])).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(tests):
            found = tiles_by_hand(d, t)
            if sum(n for *_, n in found) >= st.COVERAGE * len(t):
                want[i, j] = found
    assert got == want
    assert {(4 * j + 1, j) for j in range(len(tests))} <= set(got)  # reordered ones are found


def test_odd_rows(corpus, items):
    tests = items([None, "", "four words are few", "five words are a seed", "five words are a seed", "word " * 40])
    got = {(r.doc_id, r.item_id) for r in st.leaked_items(corpus([*ODD, "Five words, are a seed!", "Five words, are a seed!"]), tests).collect()}
    assert got == {(6, 5), (10, 3), (10, 4), (11, 3), (11, 4)}
    assert st.leaked_items(corpus([]), tests).count() == 0
    assert st.leaked_items(corpus(ODD), items([])).count() == 0


def test_stage_drops_leaks_alone(corpus, items):
    docs = corpus([*ODD, "before it five words are a seed after it", "clean words that no test item has"], ids=[None, *range(1, 12)])
    docs = docs.withColumnRenamed("source", "copy").withColumnRenamed("lang", "gone_id_")
    out = st.drop_leaking(docs, items(["five words are a seed"]))
    assert out.columns == docs.columns
    assert out.count() == 11 and 10 not in {r.doc_id for r in out.collect()}
