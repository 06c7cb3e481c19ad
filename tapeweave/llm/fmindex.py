"""A bidirectional FM-index over a block of words, searched for words one edit away.

The text of a block is its words, each between delimiters. Two Burrows-Wheeler transforms,
of the text and of its reverse, hold the same pattern as two intervals of suffix ranks; a step
to the left moves the first and narrows the second with it, a step to the right the other way
round. A search scheme for one edit has two searches: one half of the word is matched exactly
from the middle outwards, then the search turns and extends over the other half with one
error. All queries of a length take their steps together, as vectors.

T. Lam et al., "High throughput short read alignment via bi-directional BWT" (BIBM 2009);
G. Kucherov et al., "Approximate string matching using a bidirectional index" (CPM 2014).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

END, DELIMITER, LETTERS = 0, 1, 2
#: Intervals up to this size are read symbol by symbol; larger ones try every letter.
SMALL = 24
#: Half-made matches that wait at once.
MOST_STATES = 400_000


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the sorted suffixes of text, whose last symbol is its only 0. Prefix doubling."""
    n = len(text)
    bits = max(1, int(symbols - 1).bit_length())
    reach = max(1, 62 // bits)
    padded = np.append(text.astype(np.int64), np.zeros(reach, dtype=np.int64))
    key = np.zeros(n, dtype=np.int64)
    for k in range(reach):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        fresh[0] = 0
        fresh[1:] = key[order][1:] != key[order][:-1]
        np.cumsum(fresh, out=fresh)
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        key = rank * (n + 1)
        key[: max(0, n - reach)] += rank[reach:] + 1
        reach *= 2


class Ranks:
    """The Burrows-Wheeler transform of a text with counts of its symbols before any place.

    For each 64 places and symbol c: how many symbols up to c stand before, and a bit for each
    of the places whose symbol is c or less. Column c + 1 belongs to c; column 0 to none.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text, symbols)
        self.n = len(text)
        self.symbols = symbols
        self.transform = text[order - 1]
        counts = np.bincount(text, minlength=symbols)
        #: Rows of suffixes that begin with a smaller symbol; the symbol past the last is one that no text holds.
        self.first = np.append(np.append(0, np.cumsum(counts)), 0)[: symbols + 1].astype(np.int64)
        self.delimiter_at = order[self.first[DELIMITER] : self.first[DELIMITER] + counts[DELIMITER]]
        words = self.n // 64 + 1
        self.width = symbols + 2
        bits = np.zeros((self.width, words), dtype=np.uint64)
        room = np.zeros(words * 64, dtype=bool)
        for c in range(symbols):
            room[: self.n] = self.transform <= c
            bits[c + 1] = np.packbits(room, bitorder="little").view("<u8")
        bits[symbols + 1] = bits[symbols]
        before = np.zeros((self.width, words), dtype=np.int32)
        before[:, 1:] = np.cumsum(np.bitwise_count(bits)[:, :-1], axis=1, dtype=np.int32)
        self.bits = np.ascontiguousarray(bits.T).ravel()
        self.before = np.ascontiguousarray(before.T).ravel()

    def at_most(self, column: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of the symbols before place are in the column's range."""
        spot = (place >> 6) * self.width + column
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[spot] + np.bitwise_count(self.bits[spot] & below)

    def step(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put on: low, size, and how many smaller symbols could be put on."""
        high = low + size
        smaller = self.at_most(symbol, low)
        ahead = self.at_most(symbol + 1, low) - smaller
        skipped = self.at_most(symbol, high) - smaller
        inside = self.at_most(symbol + 1, high) - smaller - skipped - ahead
        return self.first[symbol] + ahead, inside, skipped


class BidirectionalIndex:
    """Index of distinct words; near() finds those one inserted, deleted or replaced code point away."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.letters = np.unique(codes)
        self.symbols = LETTERS + len(self.letters)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.append(0, np.cumsum(lengths + 1))  # of the delimiters
        text = np.full(int(starts[-1]) + 1, DELIMITER, dtype=np.int32)
        place = np.arange(len(codes)) + np.repeat(np.arange(len(words)), lengths) + 1
        text[place] = np.searchsorted(self.letters, codes) + LETTERS
        last = len(text) - 1
        self.leftward = Ranks(np.append(text, END), self.symbols)
        self.rightward = Ranks(np.append(text[::-1], END), self.symbols)
        # The word that begins behind, or ends before, the delimiter of each row.
        self.leftward_words = np.searchsorted(starts, self.leftward.delimiter_at)
        self.rightward_words = np.searchsorted(starts, last - self.rightward.delimiter_at) - 1

    def spelled(self, words: list[str], length: int) -> np.ndarray:
        """Words of one length as rows of symbols; a letter that the index lacks is the symbol past the last."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), length)
        if not len(self.letters):
            return np.full(codes.shape, self.symbols, dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[spot] == codes, spot + LETTERS, self.symbols).astype(np.int64)

    def near(self, words: list[str], keep: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in words, indexed word) of the pairs one edit apart whose edit lies outside the half kept.

        keep: `head` for pairs that share the first len // 2 code points of the query, `tail`
        for pairs that share the others and not the first ones. Both together find each pair
        once. Words have two code points or more.
        """
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, places in sorted(by_length.items()):
            half = length // 2
            symbols = self.spelled([words[k] for k in places], length)
            edge = np.full((len(places), 1), DELIMITER, dtype=np.int64)
            head = np.hstack([symbols[:, :half][:, ::-1], edge])  # from the middle to the left
            tail = np.hstack([symbols[:, half:], edge])  # from the middle to the right
            if keep == "head":
                found = self._search(head, tail, self.leftward, self.rightward, self.rightward_words)
            else:
                found = self._search(tail, head, self.rightward, self.leftward, self.leftward_words)
            for query, word in found:
                if keep == "tail":
                    shared = np.fromiter(
                        (self.words[v].startswith(words[places[q]][:half]) for q, v in zip(query, word, strict=True)),
                        dtype=bool,
                        count=len(query),
                    )
                    query, word = query[~shared], word[~shared]
                yield np.array(places, dtype=np.int64)[query], word

    def _search(
        self, exact: np.ndarray, loose: np.ndarray, first: Ranks, second: Ranks, words: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Matches exact with `first`, turns, and extends over loose with one error by `second`."""
        query = np.arange(len(exact))
        low, other, size = np.zeros(len(exact), dtype=np.int64), np.zeros(len(exact), dtype=np.int64), np.full(len(exact), first.n)
        for k in range(exact.shape[1]):
            low, size, skipped = first.step(low, size, exact[query, k])
            other = other + skipped
            live = size > 0
            query, low, other, size = query[live], low[live], other[live], size[live]
        low, end = other, loose.shape[1] - 1
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0
        matched: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(end + 1):
            if not len(query):
                break
            wanted = loose[query, k]
            state, letter = self._choices(low, size, second)
            other_letter = letter != wanted[state]
            state, letter = state[other_letter], letter[other_letter]
            new_low, new_size, _ = second.step(low[state], size[state], letter)
            live = new_size > 0
            state, new_low, new_size = state[live], new_low[live], new_size[live]
            # A letter put in, one replaced, one left out.
            waiting.append((query[state], np.full(len(state), k), new_low, new_size))
            if k < end:
                waiting.append((query[state], np.full(len(state), k + 1), new_low, new_size))
                waiting.append((query, np.full(len(query), k + 1), low, size))
            held += 2 * len(state) + len(query)
            if held > MOST_STATES:
                matched.append(self._finish(waiting, loose, second, words))
                waiting, held = [], 0
            low, size, _ = second.step(low, size, wanted)
            live = size > 0
            query, low, size = query[live], low[live], size[live]
        if waiting:
            matched.append(self._finish(waiting, loose, second, words))
        if matched:
            both = np.unique(np.concatenate([q * len(self.words) + w for q, w in matched]))
            yield both // len(self.words), both % len(self.words)

    def _choices(self, low: np.ndarray, size: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter): the letters that each interval could be extended by, and perhaps more for large ones."""
        few = np.flatnonzero(size <= SMALL)
        many = np.flatnonzero(size > SMALL)
        reps = size[few]
        offset = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        state = np.repeat(few, reps)
        letter = ranks.transform[np.repeat(low[few], reps) + offset].astype(np.int64)
        pairs = np.unique((state * self.symbols + letter)[letter >= LETTERS])
        letters = np.arange(LETTERS, self.symbols)
        return (
            np.concatenate([pairs // self.symbols, np.repeat(many, len(letters))]),
            np.concatenate([pairs % self.symbols, np.tile(letters, len(many))]),
        )

    def _finish(
        self, waiting: list[tuple[np.ndarray, ...]], loose: np.ndarray, ranks: Ranks, words: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Extends states that have had their error to the end of the word: (query, word) of those that get there."""
        query, at, low, size = (np.concatenate(parts) for parts in zip(*waiting, strict=True))
        queries, found = [], []
        while len(query):
            low, size, _ = ranks.step(low, size, loose[query, at])
            at = at + 1
            done = (size > 0) & (at == loose.shape[1])
            if done.any():
                queries.append(query[done])
                found.append(words[low[done] - ranks.first[DELIMITER]])
            live = (size > 0) & (at < loose.shape[1])
            query, at, low, size = query[live], at[live], low[live], size[live]
        if not queries:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(queries), np.concatenate(found)
