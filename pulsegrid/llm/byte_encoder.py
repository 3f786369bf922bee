"""Ids of byte-level vocabularies (files of the tokenizers library), as bytes of 32-bit numbers."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level vocabularies of this kind part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that no version of Unicode classes differently: up to Latin Extended-B, and dashes, quotes and dots.
_SETTLED = re.compile("[^\x00-ɏ‐-‧]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """``encode`` gives what tokenizers gives without added special tokens, in little-endian 32-bit numbers.

    Vocabularies whose ids count their merges are merged by tiktoken, some three times as fast;
    texts with characters on whose classes two libraries may differ, and other kinds of files, go to
    tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranks(json.load(f))

    @staticmethod
    def _ranks(file: dict) -> tiktoken.Encoding | None:
        model, first, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        usual = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not file.get("normalizer")
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not usual or not plain or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            return None
        letters, vocab = _byte_letters(), model["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        special = {t["content"]: t["id"] for t in added}
        if merged != sorted(set(merged)) or len(merged) + 256 != len(set(vocab) - set(special)):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        if self.fast is None or _SETTLED.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
