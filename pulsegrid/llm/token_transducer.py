"""Token counts by a finite-state transducer over characters.

A state holds what later tokens can depend on: the longest end of the text read so far that
begins some piece, and for each place in it the last token before that place with its count
relative to the current one. Each transition is annotated with the change of the count. States
are made when first reached and numbered, so equal ones are one; reading a text is then one look
per character. Places where no piece can reach across forget the token before them, so states
don't grow with what stands before a word.

A text is read in chunks. A chunk's state map is its head (up to the first place that no piece
crosses, which needs the state before it), the count of its body, and its tail (from the last
such place, whose tokens aren't final). Maps compose associatively, by a prefix scan in pairs;
chunks of long texts are separate rows, so one text keeps many tasks busy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .piece_vocabulary import MEMORY, SPACE, Memory, spaced, vocabulary

#: Characters of a chunk, and from how long a stretch its count isn't remembered.
CHUNK, WORD_CHARS = 1 << 16, 48
#: Tokens of a text from which on it is over the limit.
LIMIT = 4096


class ChunkMap(NamedTuple):
    """What a chunk does to the count. Without a cut inside, all of it is ``head``."""

    head: str
    cut: bool
    count: int
    tail: str


class Transducer:
    def __init__(self, path: str) -> None:
        self.vocabulary = v = vocabulary(path)
        self.ids = {p: v.ids[p] for p in v.whole}
        self.pieces = v.pieces
        self.prefixes = {p[:i] for p in self.ids for i in range(len(p) + 1)}
        self.fits = Memory(lambda pair: v.compatible(v.pieces[pair >> 20], v.pieces[pair & 0xFFFFF]))
        self.words = v.words().findall
        self.crossed = any(x[1] == SPACE and x[0] != SPACE for x in v.inner)
        self.remembered = Memory(self.read)
        self._reset()

    def _reset(self) -> None:
        #: By state: its window, and per place in it the last token (-1: none matters) and relative count.
        self.states: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []
        self.number: dict[tuple, int] = {}
        self.next: list[dict[str, tuple[int, int]]] = []
        self._state(("", (-1,), (0,)))

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return n

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from ``state`` on ``char``: next state and change of the count."""
        window, tokens, counts = self.states[state]
        v = self.vocabulary
        if char not in v.chars:
            return 0, len(char.encode("utf-8", "surrogatepass")) if v.id_of_byte else 1
        if window and window[-1] + char not in v.inner:
            window, tokens, counts = "", (-1,), counts[-1:]
        grown = window + char
        for start in range(len(grown)):
            token = self.ids.get(grown[start:])
            if token is not None and (tokens[start] < 0 or self.fits[tokens[start] << 20 | token]):
                break
        change = counts[start] + 1
        keep = next(i for i in range(len(grown) + 1) if grown[i:] in self.prefixes)
        tokens, counts = (*tokens, token)[keep:], (*(c - change for c in counts), 0)[keep:]
        return self._state((grown[keep:], tokens, counts)), change

    def read(self, text: str) -> int:
        """Tokens of a text, from the first state."""
        state = count = 0
        after = self.next
        for char in text:
            step = after[state].get(char)
            if step is None:
                step = after[state][char] = self._compile(state, char)
            state, change = step
            count += change
        if len(self.states) > MEMORY:
            self._reset()
        return count

    def chunk_map(self, text: str) -> ChunkMap:
        if self.crossed:
            return ChunkMap(text, False, 0, "")
        parts = self.words(text)
        # A chunk may begin or end inside a word: those two words are its head and its tail.
        if len(parts) < 2:
            return ChunkMap(text, False, 0, "")
        remembered = self.remembered
        count = sum([remembered[w] if len(w) <= WORD_CHARS else self.read(w) for w in parts[1:-1]])
        return ChunkMap(parts[0], True, count, parts[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not b.cut:
            # The text of b may begin a new word.
            joined = self.chunk_map((a.tail if a.cut else a.head) + b.head)
            return joined if not a.cut else ChunkMap(a.head, True, a.count + self._all_but_tail(joined), joined.tail or joined.head)
        if not a.cut:
            joined = self.chunk_map(a.head + b.head)
            if not joined.cut:
                return ChunkMap(joined.head, True, b.count, b.tail)
            return ChunkMap(joined.head, True, joined.count + self.read(joined.tail) + b.count, b.tail)
        joined = self.chunk_map(a.tail + b.head)
        return ChunkMap(a.head, True, a.count + self._all_but_tail(joined) + self.read(joined.tail or joined.head) + b.count, b.tail)

    def _all_but_tail(self, joined: ChunkMap) -> int:
        return self.read(joined.head) + joined.count if joined.cut else 0

    def scan(self, maps: list[ChunkMap]) -> int:
        """Tokens of the chunks' text: maps composed in pairs, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.read(t) for t in (maps[0].head, maps[0].tail)) + maps[0].count if maps else 0


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _first(parts: Iterator[pd.DataFrame], path: str, chunk: int) -> Iterator[pd.DataFrame]:
    """Counts of texts of one chunk, and the chunks of the others (``chunks`` of them, from number 0)."""
    machine = transducer(path)
    for df in parts:
        rows = []
        for doc_id, copy, text in zip(df.doc_id, df["copy"], df.text):
            text = text if isinstance(text, str) else ""
            n_bytes, marked = len(text.encode("utf-8", "surrogatepass")), spaced(text)
            if len(marked) <= chunk:
                rows.append((doc_id, copy, n_bytes, machine.scan([machine.chunk_map(marked)]), 0, 1, None))
            else:
                starts = range(0, len(marked), chunk)
                rows += [(doc_id, copy, n_bytes, None, i, len(starts), marked[s:s + chunk]) for i, s in enumerate(starts)]
        yield _frame(rows, "doc_id copy n_bytes n_tokens number chunks chunk")


def _frame(rows: list[tuple], names: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names.split(), dtype=object)
    return out


def _maps(parts: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    machine = transducer(path)
    for df in parts:
        made = pd.DataFrame([machine.chunk_map(t) for t in df.chunk], columns=["head", "cut", "count", "tail"])
        yield pd.concat([df.drop(columns="chunk").reset_index(drop=True), made], axis=1)


def _composed(parts: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    machine = transducer(path)
    for df in parts:
        totals = [machine.scan([ChunkMap(m["head"], m["cut"], m["count"], m["tail"]) for m in maps]) for maps in df.maps]
        yield df.drop(columns="maps").assign(n_tokens=totals)


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, without begin and end tokens.

    NULL counts as empty: no bytes, no tokens. Characters without a piece count a token for each
    of their bytes. Texts of more than ``chunk`` characters go out chunk by chunk. Repeated rows
    each get a row; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    first = rows.mapInPandas(
        partial(_first, path=model_path, chunk=chunk),
        f"doc_id {kind}, copy long, n_bytes long, n_tokens long, number long, chunks long, chunk string")
    first = stored(first)
    short = first.where("chunks = 1").select("doc_id", "n_bytes", "n_tokens")
    # Equal rows have equal chunks: each number is there as often as the row.
    long = first.where("chunks > 1").drop("n_tokens")
    spread = long.repartition("doc_id", "copy", "number")
    maps = spread.mapInPandas(
        partial(_maps, path=model_path),
        f"doc_id {kind}, copy long, n_bytes long, number long, chunks long, head string, cut boolean, count long, tail string")
    each = ["doc_id", "copy", "n_bytes"]
    once = maps.groupBy(*each, "number").agg(F.min(F.struct("head", "cut", "count", "tail")).alias("map"), F.count("*").alias("times"))
    gathered = once.groupBy(*each).agg(
        F.min("times").alias("times"),
        F.transform(F.array_sort(F.collect_list(F.struct("number", "map"))), lambda x: x.map).alias("maps"))
    total = gathered.mapInPandas(partial(_composed, path=model_path), (
        f"doc_id {kind}, copy long, n_bytes long, times long, n_tokens long"))
    long_rows = total.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("time"))
    return short.union(long_rows.drop("time")).withColumn("over_limit", F.col("n_tokens") > limit)
