"""Vectors over whole texts: code points, hashed words and shapes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20

# Odd 64-bit constants with well-mixed bits.
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about `most` characters, with the place of the first; null is empty."""
    first, size, part = 0, 0, []
    for k, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > most:
            yield first, part
            first, size, part = k, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield first, part


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text begins (and the last ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return codes, bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _is(kind: str) -> np.ndarray:
    """Whether a code point is of a kind: a method name of str, `unspaced`, or `visible` (no white space for str)."""
    if kind == "visible":
        return ~_is("isspace")
    if kind == "unspaced":
        table = np.ones(0x110000, dtype=bool)
        table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
        return table
    return np.fromiter((getattr(chr(c), kind)() for c in range(0x110000)), dtype=bool, count=0x110000)


class Words:
    """Hashed words of a chunk: runs of code points of a kind within one text."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, kind: str, stem: int = 0):
        inside = _is(kind)[codes]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < len(codes)]
        begins[edges] = inside[edges]
        self.starts = np.flatnonzero(begins)
        at = np.flatnonzero(inside)
        self.text = np.searchsorted(bounds, self.starts, side="right") - 1
        #: Words of text k: first[k] to first[k + 1].
        self.first = np.searchsorted(self.starts, bounds)
        if not len(at):
            self.hashes = self.stems = np.zeros(0, dtype=np.uint64)
            self.lengths = np.zeros(0, dtype=np.int64)
            return
        heads = np.searchsorted(at, self.starts)
        self.lengths = lengths = np.diff(np.append(heads, len(at)))
        place = np.arange(len(at)) - np.repeat(heads, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
        terms = mixed((codes[at].astype(np.uint64) + np.uint64(1)) * _GOLD) * powers[place]
        self.hashes = mixed(np.add.reduceat(terms, heads) + lengths.astype(np.uint64))
        if stem:
            terms[place >= stem] = 0
            self.stems = mixed(np.add.reduceat(terms, heads))

    def runs(self, n: int, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words (each `gap` after the last) within one text, and their texts."""
        reach = (n - 1) * gap
        if len(self.hashes) <= reach:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        count = len(self.hashes) - reach
        out = self.hashes[:count].copy()
        for k in range(1, n):
            out = mixed(out * _BASE + self.hashes[k * gap : k * gap + count])
        whole = self.text[:count] == self.text[reach:]
        return out[whole], self.text[:count][whole]
