"""Language identification as a mixture of languages.

Training counts character trigrams by language. A document is then taken as a mixture: its
trigrams are drawn from the languages' distributions in unknown proportions, which expectation-
maximisation estimates. Languages join the set one by one as long as the likelihood gains more
than a penalty for each; the prediction is the language of the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

#: Trigrams are counted in so many bins; the model has a row of them for each language.
BINS = 1 << 15
SMOOTHING, STEPS = 0.1, 12
#: What a further language must gain in log-likelihood, times the logarithm of the trigrams' number.
PENALTY = 6.0
#: A model of more languages would not be small; training stops with an error beyond it.
MAX_LANGUAGES = 1024
UNKNOWN = "und"


class LanguageModel(NamedTuple):
    """Learned languages in order, their trigram probabilities, and documents learned from."""

    languages: tuple[str, ...]
    probabilities: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of the text's lower-cased letters; whatever parts them is one space. Empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 0x20)
    keep = letter | np.concatenate([[False], letter[:-1]])  # of a run of others, the first
    codes = np.concatenate([[0x20], codes[keep], [0x20]]).astype(np.uint64)
    if len(codes) > 3 and codes[-2] == 0x20:
        codes = codes[:-1]
    packed = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return (mixed(packed) >> np.uint64(49)).astype(np.int64)


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for df in parts:
        for lang, text in zip(df.lang, df.text):
            if isinstance(text, str) and lang is not None:
                if lang not in totals:
                    if len(totals) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    totals[lang] = np.zeros(BINS, np.int64)
                totals[lang] += np.bincount(trigrams(text), minlength=BINS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bin": at, "n": total[at]})


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of all rows that have a language and text.

    Tasks add up their own counts; a row for each language and bin is summed and comes to the
    driver, so what it gets is bounded by the number of languages (at most ``MAX_LANGUAGES``)
    and bins, not by documents. Languages without a letter in any text aren't learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.mapInPandas(_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found.lang.unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(languages), BINS), SMOOTHING)
    table[found.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["bin"].to_numpy(int)] += found.n.to_numpy(float)
    return LanguageModel(tuple(languages), table / table.sum(axis=1, keepdims=True))


def _proportions(p: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages whose trigram probabilities are ``p``, and the log-likelihood."""
    share, n = start, counts.sum()
    for _ in range(STEPS):
        total = share @ p
        share = share * (p @ (counts / total)) / n
    return share, float(counts @ np.log(share @ p))


def mixture(model: LanguageModel, text: str) -> dict[int, float]:
    """Number and proportion of each language that the text mixes; empty without a letter or model."""
    grams = trigrams(text)
    if not len(grams) or not model.languages:
        return {}
    bins, counts = np.unique(grams, return_counts=True)
    p, counts = model.probabilities[:, bins], counts.astype(float)
    single = np.log(p) @ counts
    chosen = [int(np.argmax(single))]
    share, likelihood = np.ones(1), float(single[chosen[0]])
    price = PENALTY * np.log(len(grams) + 1)
    most = float(counts @ np.log(p.max(axis=0)))
    while len(chosen) < len(model.languages) and most - likelihood > price:
        best = None
        for other in range(len(model.languages)):
            if other not in chosen:
                start = np.append(share * 0.8, 0.2)
                tried, value = _proportions(p[[*chosen, other]], counts, start)
                if best is None or value > best[1]:
                    best = (tried, value, other)
        if best[1] - likelihood <= price:
            break
        share, likelihood = best[:2]
        chosen.append(best[2])
    return {c: float(s) for c, s in zip(chosen, share)}


def _predict(parts: Iterator[pd.DataFrame], model: LanguageModel) -> Iterator[pd.DataFrame]:
    for df in parts:
        rows = []
        for text in df["text"]:
            found = mixture(model, text) if isinstance(text, str) else {}
            top = max(found, key=lambda c: (found[c], -c), default=None)
            ordered = sorted(found.items(), key=lambda x: (-x[1], x[0]))
            rows.append((UNKNOWN, 0.0, "") if top is None else (
                model.languages[top], min(1.0, found[top]), ",".join(f"{model.languages[c]}:{s:.3f}" for c, s in ordered)))
        made = pd.DataFrame(rows, columns=["lang_pred", "score", "mixture"])
        yield pd.concat([df[["doc_id", "held_out"]].reset_index(drop=True), made], axis=1)


def identify(docs: DataFrame, model: LanguageModel, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, mixture`` for each row of ``docs``.

    Texts that are NULL or have no letter, and all texts where nothing was learned, are ``und``
    with score 0. The score is the proportion of the predicted language; of equal proportions the
    language first in order is taken. The prediction reads the text only.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    flag = F.lit(None).cast("boolean") if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), flag.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(partial(_predict, model=model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture string")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learns from documents whose ``crc32(doc_id) mod 4`` isn't 2 and predicts all; a NULL id is learned from."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, learn(docs.where(~fold)), fold)
