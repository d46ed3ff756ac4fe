"""Cutting texts into pieces that a byte-level tokenizer treats alike wherever they stand.

The tokenizers' split pattern attaches one space to the letters, digits or signs behind it. So a text may be
cut at every single space between two characters that are no white space, and the pieces encoded apart, each with
its space in front. Pieces repeat far more often than texts; a bounded cache keeps what they encode to.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

_ALONE = regex.compile(r"(?<=\S) (?=\S)")
_SPACES = [c for c in map(chr, range(sys.maxunicode + 1)) if regex.match(r"\s", c)]

#: Entries that a worker's cache may hold before it is emptied; a bound on memory, not on the input.
CACHE_ENTRIES = 700_000


def pieces(text: str) -> list[str]:
    """``text`` cut at its single spaces; joined by spaces they give the text."""
    other = [c for c in _SPACES if c in text]
    runs = text[:1] == " " or text[-1:] == " " or "  " in text or any(c + " " in text or " " + c in text for c in other if c != " ")
    return _ALONE.split(text) if runs else text.split(" ")


class _Numbers(dict):
    """Pieces numbered as they are met; ``new`` are those met since it was emptied last. A tuple is a piece that begins a text."""

    def __init__(self):
        self.new: list[str | tuple[str]] = []

    def __missing__(self, piece: str | tuple[str]) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class Encoded:
    """texts -> bytes; ``encode`` gets all unknown pieces of a group of texts at once.

    What pieces encode to lies in one array of 32-bit ids, from which texts are gathered by their pieces' numbers. A full cache keeps
    the pieces that were met again, the more frequent ones up to half its size.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.encode, self.entries = encode, entries
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.ends = _Numbers(), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        least = max(2, int(np.sort(self.met)[-(self.entries // 2) - 1]) + 1)
        kept = np.flatnonzero(self.met >= least)
        names, lengths, begin = list(self.numbers), np.diff(self.ends)[kept], self.ends[kept]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lengths)]
        self.ends, self.met, self.numbers = ends, self.met[kept], _Numbers()
        self.numbers.update((names[k], i) for i, k in enumerate(kept.tolist()))

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        found = self.encode([x[0] if isinstance(x, tuple) else " " + x for x in new])
        ends = self.ends[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self.ids, self.ends = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")]), np.concatenate([self.ends, ends])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if len(self.numbers) > self.entries:
            self._shrink()
        cut = [pieces(t) for t in texts]
        for c in cut:
            c[0] = (c[0],)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if self.numbers.new:
            try:
                self._learn()
            except BaseException:
                self._forget()  # numbers without ids
                raise
        met = np.bincount(at, minlength=len(self.numbers))
        met[: len(self.met)] += self.met
        self.met = met
        begin = self.ends[at]
        lengths = self.ends[at + 1] - begin
        after = np.cumsum(lengths)
        out = self.ids[np.arange(after[-1]) + np.repeat(begin - after + lengths, lengths)].tobytes()
        bounds = [0, *(4 * after[np.cumsum(counts) - 1]).tolist()]
        return [out[i:j] for i, j in zip(bounds, bounds[1:])]


def grouped(lengths: list[int], most: int = 1 << 21) -> list[slice]:
    """Slices of neighbours that together have about ``most`` at most; a longer one is alone."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            out.append(slice(begin, i))
            begin, held = i, 0
        held += n
    return [*out, slice(begin, len(lengths))] if lengths else out
