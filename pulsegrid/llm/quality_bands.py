"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks.

Text that repeats itself compresses too well, noise too badly. What is too well or too badly
depends on length, so whole documents have bands by length; chunks have one size and one band.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of

LEVEL, CHUNK = 3, 4096


class Band(NamedTuple):
    """Documents of ``size`` bytes and more, up to the next band: the ratios that are kept."""

    size: int
    low: float
    high: float


#: A frame's own bytes weigh on short texts, so there the low limits are below 1.
BANDS = (
    Band(0, 0.0, 3.0), Band(128, 0.9, 2.6), Band(256, 1.15, 2.8), Band(512, 1.25, 3.0), Band(1024, 1.35, 3.3),
    Band(4096, 1.45, 4.0), Band(16384, 1.55, 4.5), Band(65536, 1.6, 5.5),
)
#: The kept ratios of chunks (base64 has 1.31 to 1.33), and the share of chunks that may lie outside.
CHUNK_BAND, CHUNK_SHARE = Band(CHUNK, 1.4, 3.6), 0.25
MIN_WORDS, SYMBOLS = 50, b"#*$%&|<>"

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, band_low double, band_high double, n_chunks long, n_chunks_outside long")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    first: dict[tuple, int] = {}
    marked = np.zeros(len(words) + 2, bool)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            marked[j:j + 3] = True
            marked[i:i + 3] = True
    return int(marked.sum())


def measure(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple:
    """A row of ``SCHEMA`` for one text."""
    words = data.split()
    tally = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    code_points = len(data) - int(tally[0x80:0xC0].sum())
    word_chars = code_points - int(tally[0x20] + tally[0x09:0x0E].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > 50 * len(words)
    band = max(b for b in BANDS if b.size <= len(data))
    ratio = len(data) / len(compressor.compress(data))
    chunks = [data[i:i + CHUNK] for i in range(0, len(data) - CHUNK + 1, CHUNK)]
    if len(data) > CHUNK and len(data) % CHUNK:
        chunks.append(data[-CHUNK:])
    outside = sum(not CHUNK_BAND.low <= len(c) / len(compressor.compress(c)) <= CHUNK_BAND.high for c in chunks)
    kept = not failed and band.low <= ratio <= band.high and outside <= CHUNK_SHARE * len(chunks)
    return (len(words), word_chars, sum(int(tally[s]) for s in SYMBOLS), len(lines) - len(set(lines)), n_repeat, failed,
            kept, ratio, band.low, band.high, len(chunks), outside)


def quality(text: Column) -> Column:
    """Struct of ``SCHEMA``: the base counts, the ratios and the verdict ``kept`` for each text.

    NULL counts as empty. A text of fewer than 50 words, or with more than half of its words in
    repeated windows, fails the base rules. Otherwise it is kept if its ratio lies in the band for
    its length and at most a quarter of its chunks lie outside the chunk band. The last chunk is
    the text's final 4 KB, whatever it shares with the one before; a text shorter than a chunk has
    the whole ratio only.
    """

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for texts in parts:
            yield pd.DataFrame([measure(t, compressor) for t in bytes_of(texts)], columns=names)

    return F.pandas_udf(each, SCHEMA)(text)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and every field of ``quality``, one row for each row of ``docs``; other columns aren't read."""
    return docs.select(F.col(id_col).alias("doc_id"), quality(F.col(text_col)).alias("q")).select("doc_id", "q.*")
