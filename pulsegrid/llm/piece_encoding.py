"""Encoding into merged pieces by a table over prefixes, and decoding.

For each prefix of a text exactly one piece can end its encoding. The table is filled from left
to right: an automaton names the pieces that end at a place, longest first, and the one that may
follow the last piece of what is before it is the answer. Ids are then read off backwards. Time
is proportional to length, whatever the text; nothing is merged step by step.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_vocabulary import SPACE, Memory, spaced, vocabulary

#: Longer stretches between spaces aren't remembered.
WORD_CHARS = 48


class PrefixTable:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = vocabulary(path)
        self.matches = v.automaton().iter
        self.cut, self.known = v.words().findall, v.known().findall
        self.lengths = [len(p) for p in v.pieces]
        self.compatible = Memory(lambda pair: v.compatible(v.pieces[pair >> 20], v.pieces[pair & 0xFFFFF]))
        self.remembered = Memory(self._encode)
        pieces = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for i, b in v.byte_of.items():
            pieces[i] = bytes([b])
        for i, control in enumerate(v.control):
            if control:
                pieces[i] = b""
        pieces[v.unk] = " ⁇ ".encode()
        self.bytes_of_piece, self.controls = pieces, np.array(v.control)

    def last_pieces(self, text: str) -> list[int]:
        """For each prefix of a text of known characters, the id of the last piece of its encoding."""
        last = [-1] * len(text)
        compatible = self.compatible
        for end, match in self.matches(text):
            if last[end] < 0:
                piece, length = match
                start = end - length
                if start < 0 or compatible[last[start] << 20 | piece]:
                    last[end] = piece
        return last

    def _known(self, text: str) -> list[int]:
        last, lengths, end, ids = self.last_pieces(text), self.lengths, len(text) - 1, []
        while end >= 0:
            piece = last[end]
            ids.append(piece)
            end -= lengths[piece]
        ids.reverse()
        return ids

    def _encode(self, text: str) -> bytes:
        v = self.vocabulary
        if v.chars.issuperset(text):
            return array("I", self._known(text)).tobytes()
        ids = array("I")
        for run in self.known(text):
            if run[0] in v.chars:
                ids.extend(self._known(run))
            elif v.id_of_byte:
                ids.extend([v.id_of_byte[b] for b in run.encode("utf-8", "surrogatepass")])
            else:
                ids.append(v.unk)
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers (of this machine's byte order), without begin and end."""
        remembered = self.remembered
        return b"".join([remembered[w] if len(w) <= WORD_CHARS else self._encode(w) for w in self.cut(spaced(text))])

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids: control ids vanish, one space before the first piece goes, bytes that are no UTF-8 become U+FFFD."""
        v = self.vocabulary
        listed = ids.tolist()
        runs: list[list[int]] = [[]]  # control ids part runs of byte ids
        for at in [*np.flatnonzero(self.controls[ids]).tolist(), len(listed)]:
            runs.append(listed[sum(map(len, runs)) + len(runs) - 1:at])
        text = "".join([self._text(r) for r in runs if r])
        first = next((r[0] for r in runs if r), None)
        strip = first is not None and first not in v.byte_of and v.pieces[first].startswith(SPACE)
        return text[1:] if strip else text

    def _text(self, ids: list[int]) -> str:
        joined = b"".join([self.bytes_of_piece[i] for i in ids])
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _repaired(joined)


def _repaired(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that begins no whole character."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def _rows(parts: Iterator[pd.DataFrame], path: str, digest: bool) -> Iterator[pd.DataFrame]:
    table = prefix_table(path)
    v = table.vocabulary
    begin, end = array("I", [v.bos]).tobytes(), array("I", [v.eos]).tobytes()
    for df in parts:
        rows = []
        for text in df.text:
            ids = begin + table.encode(text if isinstance(text, str) else "") + end
            values = np.frombuffer(ids, np.uint32)
            decoded = table.decode(values)
            rows.append((len(values), hashlib.sha256(values.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                        if digest else (values.astype(np.int32), decoded))
        made = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])
        yield pd.concat([df[["doc_id"]].reset_index(drop=True), made], axis=1)
    table.remembered.clear()  # a worker may next serve another stage


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool, fields: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(partial(_rows, path=path, digest=digest), f"doc_id {kind}, {fields}")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for each row: ids with begin and end, and the text they decode to.

    NULL counts as empty, which has the begin and end ids alone. One row for each row of ``docs``,
    repeated ones included; other columns aren't read.
    """
    return _encoded(docs, model_path, id_col, text_col, False, "ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``encode_documents`` gives, without carrying it."""
    return _encoded(docs, model_path, id_col, text_col, True, "n_tokens long, ids_sha256 string, decoded_sha256 string")
