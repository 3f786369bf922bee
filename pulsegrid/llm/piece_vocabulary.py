"""A piece vocabulary with byte fallback, and which of its pieces may stand next to each other."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import sentencepiece

SPACE = "▁"
#: Entries of a task's memory of pairs, pieces of text or states; a full one is emptied.
MEMORY = 200_000


class Memory(dict):
    """What ``make`` gives for a key, remembered for at most ``MEMORY`` keys."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Vocabulary:
    """Pieces by id, and their order of merging: higher scores first, then further left."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.control = [model.is_control(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        normal = [i for i in range(size) if not (self.control[i] or i in self.byte_of or model.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        scores = {p: model.get_score(i) for p, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Of each piece, its place in the order of merging; equal scores share one.
        self.rank = {p: order[s] for p, s in scores.items()}
        self.chars = {c for p in self.ids for c in p}
        #: Neighbouring characters inside any piece: elsewhere no merge is possible.
        self.inner = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._derive()
        if any(len(c) == 1 and c not in self.ids and self.chars for c in self.chars):
            raise ValueError("a character of a piece is no piece itself")

    def merge(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """Pieces of a short text by merging step by step, and the merged pairs. The definition; not used on texts."""
        parts, done = list(text), []
        while True:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts, done
            i = ranks.index(best)
            done.append((parts[i], parts[i + 1]))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _derive(self) -> None:
        """For each piece that its own characters merge into: how its edges grow, from a character to the whole."""
        split: dict[str, tuple[str, str]] = {}
        whole = []
        for p in self.ids:
            parts, done = self.merge(p)
            if parts == [p]:
                whole.append(p)
                split.update({a + b: (a, b) for a, b in done if a + b == p})
        self.left: dict[str, list[str]] = {}
        self.right: dict[str, list[str]] = {}
        self.steady: dict[str, bool] = {}
        for p in sorted(whole, key=len):
            if p not in split:
                self.left[p], self.right[p], self.steady[p] = [p], [p], True
                continue
            a, b = split[p]
            known = a in self.left and b in self.right
            self.left[p], self.right[p] = [*self.left.get(a, [a]), p], [*self.right.get(b, [b]), p]
            rank = lambda x: self.rank[x] if len(x) > 1 else -1
            self.steady[p] = known and self.steady[a] and self.steady[b] and rank(p) > max(rank(a), rank(b))
        self.whole = whole

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two pieces' text ends in just these two.

        Their facing edges grow in the order of their ranks; the pair fails if at some moment the
        two edges could merge before either grows. Pieces whose parts don't merge in that order
        (equal ranks, as in runs of spaces) are merged step by step.
        """
        if a[-1] + b[0] not in self.inner:
            return True
        if not (self.steady[a] and self.steady[b]):
            return self.merge(a + b)[0] == [a, b]
        rights, lefts, rank, i, j = self.right[a], self.left[b], self.rank, 0, 0
        never = len(rank)
        while True:
            across = rank.get(rights[i] + lefts[j], never)
            grow_a = rank[rights[i + 1]] if i + 1 < len(rights) else never
            grow_b = rank[lefts[j + 1]] if j + 1 < len(lefts) else never
            if across < grow_a and across <= grow_b:
                return False
            if grow_a == grow_b == never:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def automaton(self) -> ahocorasick.Automaton:
        """Finds all pieces in a text, as id and length; of those that end at one place, the longest first."""
        found = ahocorasick.Automaton()
        for p in self.whole:
            found.add_word(p, (self.ids[p], len(p)))
        found.make_automaton()
        return found

    def words(self) -> re.Pattern:
        """Cuts a text where no merge is possible between a character and a space."""
        apart = all(x[1] != SPACE or x[0] == SPACE for x in self.inner)
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s).+")

    def known(self) -> re.Pattern:
        """Runs of characters of the vocabulary, and single other ones."""
        inside = "".join(map(re.escape, sorted(self.chars)))
        return re.compile(f"[{inside}]+|[^{inside}]", re.S)


def spaced(text: str) -> str:
    """The text as pieces have it: a space before it, and marks for spaces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
