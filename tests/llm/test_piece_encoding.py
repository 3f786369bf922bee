from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece
from conftest_llm import ODD

from pulsegrid.llm.piece_encoding import encode_documents, encoding_digests, prefix_table
from pulsegrid.llm.piece_vocabulary import spaced
from pulsegrid.llm.token_transducer import token_counts, transducer


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def random_texts(pieces, n):
    rng = random.Random(11)
    letters = "ab  \nthe▁ in.é日😀=-_/()0123"
    for _ in range(n):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        yield "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(12)))
    yield from ("", " ", "\n", " " * 40, "x" + " " * 17 + "y", " " * 33 + "z", "a" * 500, "<s>", "<0x0A>", "ﬁ①", "   def f(x):\n        return x")


def test_encoder_equals_library(model_path, library):
    table = prefix_table(model_path)
    for text in random_texts(table.vocabulary.pieces, 1500):
        assert np.frombuffer(table.encode(text), np.uint32).tolist() == library.encode(text)


def test_decoder_equals_library(model_path, library):
    table, rng = prefix_table(model_path), random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(1, 32000) if rng.random() < .5 else rng.randrange(1, 260) for _ in range(rng.randrange(12))]
        assert table.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_merging_is_the_definition(model_path, library):
    """The step by step merges that pairs are judged by end as the library's."""
    vocabulary = prefix_table(model_path).vocabulary
    for text in ["therefore", "internationalization", "    x", "=====", "oooooooo"]:
        assert [vocabulary.ids[p] for p in vocabulary.merge(spaced(text))[0]] == library.encode(text)


def test_documents(corpus, model_path, library, sample):
    texts = [*ODD, *sample.text]
    whole = {r.doc_id: r for r in encode_documents(corpus(texts), model_path).collect()}
    digests = {r.doc_id: r for r in encoding_digests(corpus(texts), model_path).collect()}
    assert len(whole) == len(digests) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        assert whole[i].ids == ids and whole[i].decoded == decoded
        assert tuple(digests[i])[1:] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                                         hashlib.sha256(decoded.encode()).hexdigest())
    assert encode_documents(corpus([]), model_path).count() == 0


def test_transducer_composes_any_chunks(model_path, library):
    machine = transducer(model_path)
    for text in random_texts(machine.pieces, 600):
        marked = spaced(text)
        for size in (1, 2, 3, 7, 1000):
            assert machine.scan([machine.chunk_map(marked[i:i + size]) for i in range(0, len(marked), size)]) == len(library.encode(text))


@pytest.mark.parametrize("chunk", [1 << 16, 100])
def test_counts(corpus, model_path, library, sample, chunk):
    texts = [*ODD, *sample.text, "one long text twice " * 100, "one long text twice " * 100]
    ids = [*range(len(texts) - 1), len(texts) - 2]  # the last two rows are equal
    got = sorted(tuple(r) for r in token_counts(corpus(texts, ids), model_path, chunk=chunk).collect())
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in zip(ids, texts))
    assert got == want
    assert token_counts(corpus([]), model_path).count() == 0
