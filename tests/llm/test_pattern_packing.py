from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from conftest_llm import ODD
from tokenizers import Tokenizer

from pulsegrid.llm import pattern_packing as pp
from pulsegrid.llm.byte_encoder import byte_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_library(library):
    encoder, rng = byte_encoder(PATH), random.Random(3)
    assert encoder.fast is not None
    letters = "abz  \n\t\r'st'll019.,-=é日😀ñ́  \x1c᠎“—<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", " " * 50_000, "=" * 50_000, "a" * 50_000, *[t or "" for t in ODD]]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_files_go_to_the_library(name):
    path = public_tokenizers.path(name)
    encoder, other = byte_encoder(path), Tokenizer.from_file(path)
    assert encoder.fast is None
    assert np.frombuffer(encoder.encode("Some text, é"), "<u4").tolist() == other.encode("Some text, é", add_special_tokens=False).ids


def verified(rows, ids, capacity):
    """Every document is there once, cut as asked; every sequence is gapless. Gives the number of sequences."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        want = ids[doc_id]
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(want)
        assert all(r.length == capacity for r in own[1:]) and 1 <= own[0].length <= capacity
        for r in own:
            part = want[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert "ids" not in r.asDict() or r.ids == part
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity, keep", [(2048, False), (16, True), (1, False)])
def test_packed(corpus, library, sample, capacity, keep):
    texts = [*ODD, *(sample.text if capacity > 100 else sample.text[:15])]
    docs = corpus(texts).withColumnRenamed("source", "length").repartition(5)
    ids = {i: ids_of(library, t) for i, t in enumerate(texts)}
    n = verified(pp.pack_documents(docs, PATH, capacity, keep_ids=keep).collect(), ids, capacity)
    low = -(-sum(map(len, ids.values())) // capacity)
    assert low <= n <= low * 1.02 + 1


def test_repeated_rows_and_missing_ids(spark, library):
    docs = spark.createDataFrame([(None, "one two"), (2**62 + 1, "three"), (2**62 + 1, "three"), (5, None)], "piece long, offset string")
    rows = pp.pack_documents(docs, PATH, 2048, "piece", "offset").collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == sorted(
        [(0, 0, 1 + len(library.encode("one two").ids)), (2**62 + 1, 0, 2), (2**62 + 1, 0, 2), (5, 0, 1)])
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4 and {r.sequence_id for r in rows} == {0}


def test_empty_table(corpus):
    assert pp.pack_documents(corpus([]), PATH).count() == 0


def fewest(lengths, capacity):
    """The smallest number of sequences, by trying all ways."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i]:
                place(i + 1, [*free[:k], free[k] - lengths[i], *free[k + 1:]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


def test_packing_near_the_fewest():
    rng, over = random.Random(5), 0
    for _ in range(120):
        capacity = rng.choice((6, 10, 20))
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(9))), reverse=True)
        made = pp.packing(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)
        assert sorted(itertools.chain.from_iterable([x] * (m * p.repeats) for p in made for x, m in p.lengths)) == sorted(lengths)
        assert all(p.repeats > 0 and sum(x * m for x, m in p.lengths) <= capacity for p in made)
        over += sum(p.repeats for p in made) - fewest(lengths, capacity)
    assert over <= 2


def test_patterns_fill_and_fit():
    present = np.array([2, 3, 4, 5, 6, 10])
    rows = {tuple(x for x in r if x) for r in pp.full_patterns(present, 12).tolist()}
    want = {c for k in (2, 3) for c in itertools.combinations_with_replacement(present.tolist(), k) if sum(c) == 12}
    assert rows == want
    patterns = pp.full_patterns(present, 12)
    truth = np.zeros(len(patterns))
    truth[[0, 3]] = 40, 70
    counts = np.zeros(13)
    np.add.at(counts, patterns, truth[:, None])
    counts[0] = 0
    found, fitted = pp.fit(patterns, counts), np.zeros(13)
    np.add.at(fitted, patterns, found[:, None])
    assert (found >= 0).all() and np.abs(fitted - counts)[1:].max() < 1


def test_recipe_does_not_grow_with_documents():
    rng = np.random.default_rng(1)
    shape = rng.integers(1, 40, 257)
    shape[0] = 0
    sizes = [len(pp.packing((shape * k).astype(np.int64), 256)) for k in (1, 100, 10**8)]
    assert max(sizes) < 6 * 256
    for k in (100, 10**8):
        made = pp.packing((shape * k).astype(np.int64), 256)
        plain = sum(p.repeats for p in pp.best_fit((shape * k).astype(np.int64), 256))
        assert sum(p.repeats for p in made) <= 1.01 * plain
