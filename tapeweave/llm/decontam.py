"""Benchmark decontamination by edit distance over words.

The CGK embedding walks through a word sequence: step j writes the word under the pointer and
moves on if a random bit of (j, word) says so. Sequences a small edit distance apart mostly
write the same words at the same steps, so edit distance becomes Hamming distance, and
sampled steps are a locality-sensitive hash.

Windows are the items themselves, or parts of WINDOW words of longer ones: of the parts of a
near enough copy one has no more than its share of the edits. An edit touches one word, so of
a part's seeds, one place more than it may have edits, rarest words first, one stands
unchanged in the document. From there walks go to both ends of the part. The bands of sampled
steps are repeated until the chance to share one, measured on edited sequences with as many
edits as allowed, reaches RECALL for each seed. What shares a band and enough words is
verified exactly: the least edit distance of the whole item to any part of the document
around the window.

Items reach the tasks in blocks of BLOCK_ITEMS or BLOCK_CHARS, documents are read in place: no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.llm.textcodes import Words, chunks, code_points, mixed

MAX_EDITS = 0.2
RECALL = 0.99
#: Words of a part of an item.
WINDOW = 64
SAMPLED = 3
WALKS = 4
#: Steps of a walk for each word of a window: fewer than two, so it seldom runs out of words.
STEPS_A_WORD = 1.6
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8 << 20
#: The walks to each side are sized to the largest of these that the part still fills.
SIDES = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
FILTER_BITS = 20
#: Seeds in documents that are walked from at once.
MOST_STARTS = 1 << 15

PAD = np.uint64(0)


def words_of(texts: list[str]) -> Words:
    return Words(*code_points([t.lower() for t in texts]), "isalnum")


def steps_for(words: np.ndarray | int) -> np.ndarray | int:
    return (STEPS_A_WORD * words).astype(np.int64) if isinstance(words, np.ndarray) else int(STEPS_A_WORD * words)


class Walks:
    """The random bits of walks over some words, 64 steps in a number."""

    def __init__(self, words: np.ndarray):
        self.padded = np.append(words, PAD)
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def bits(self, walk: int, step: int) -> np.ndarray:
        key = walk, step // 64
        if key not in self.known:
            seed = mixed(np.array([walk << 20 | step // 64 * 64], dtype=np.uint64) + np.uint64(0x51ED))
            self.known[key] = mixed(self.padded ^ seed)
        return self.known[key]


def embed(
    words: np.ndarray | Walks, starts: np.ndarray, ends: np.ndarray, walk: int, steps: int | np.ndarray, back: bool = False
) -> np.ndarray:
    """CGK embeddings: row k holds `steps` words of the walk from starts[k], padded past ends[k].

    With an array of steps, each row has its own number; what follows it is not set. back:
    walks to the left, ends[k] is the first word that may be read.
    """
    walks = words if isinstance(words, Walks) else Walks(words)
    padded, last = walks.padded, len(walks.padded) - 1
    counts = np.broadcast_to(steps, len(starts))
    order = np.argsort(-counts, kind="stable")
    top = int(counts.max(initial=0))
    out = np.empty((top, len(starts)), dtype=np.uint64)
    at, bound = starts.astype(np.int64)[order], ends[order]
    active = np.searchsorted(-counts[order], -np.arange(top), side="left")
    for j in range(top):
        n = active[j]
        here = at[:n]
        inside = here >= bound[:n] if back else here < bound[:n]
        here = np.where(inside, here, last)
        out[j, order[:n]] = padded[here]
        moves = (walks.bits(walk, j)[here] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
        at[:n] += -moves if back else moves
    return out.T


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        k, kind = int(rng.integers(len(out) + 1)), int(rng.integers(3))
        fresh = int(rng.integers(1, 1 << 62))
        if kind == 1 or not out:
            out.insert(k, fresh)
        elif kind == 0:
            out[k % len(out)] = fresh
        else:
            del out[k % len(out)]
    return np.array(out, dtype=np.uint64)


@lru_cache(maxsize=256)
def step_shares(size: int, max_edits: float = MAX_EDITS, trials: int = 200) -> np.ndarray:
    """Row k: for each walk, the share of steps that agree on trial k's pair, of `size` words and the most edits.

    A third of the words stand left of the seed, which both have, and walks go both ways.
    """
    rng = np.random.default_rng(size)
    left, pairs, seeds = (size - 1) // 3, [], []
    for _ in range(trials):
        a = rng.integers(1, 1 << 62, size=size).astype(np.uint64)
        edits = int(max_edits * size) if size > 1 else 0
        before = int(rng.binomial(edits, left / max(1, size - 1)))
        b = np.concatenate([edited(a[:left], before, rng), a[left : left + 1], edited(a[left + 1 :], edits - before, rng)])
        pairs += [a, b]
        seeds += [left, int(np.flatnonzero(b == a[left])[0])]
    ends = np.cumsum([len(x) for x in pairs])
    firsts = np.append(0, ends[:-1])
    at = firsts + np.array(seeds)
    walks = Walks(np.concatenate(pairs))
    out = np.empty((trials, WALKS))
    for walk in range(WALKS):
        rows = np.hstack(
            [embed(walks, at, ends, walk, max(1, steps_for(size - left))), embed(walks, at - 1, firsts, walk, steps_for(left), back=True)]
        )
        out[:, walk] = (rows[0::2] == rows[1::2]).mean(axis=1)
    return out


def same_step_share(size: int, max_edits: float = MAX_EDITS) -> float:
    """Chance that a sampled step agrees on sequences of `size` words with that many edits."""
    return float(step_shares(size, max_edits).mean())


@lru_cache(maxsize=256)
def band_count(size: int, max_edits: float = MAX_EDITS, recall: float = RECALL) -> int:
    """Bands, the same number from each walk, that pairs of `size` words with the most edits need to share one at this rate."""
    missed = 1 - np.minimum(step_shares(size, max_edits), 1 - 1e-9) ** SAMPLED
    each = 1
    while (missed.prod(axis=1) ** each).mean() > 1 - recall:
        each += 1
    return each * WALKS


def bands_for(left: int, right: int, max_edits: float = MAX_EDITS, recall: float = RECALL) -> np.ndarray:
    """Sampled steps of walks to both sides, one row a band: the steps to the right come first, but for the seed's own.

    Row k belongs to walk k % WALKS. A seed alone has bands without steps.
    """
    steps = np.append(np.arange(1, steps_for(right)), max(1, steps_for(right)) + np.arange(steps_for(left)))
    if not len(steps):
        return np.zeros((WALKS, 0), dtype=np.int64)
    count = band_count(left + right, max_edits, recall)
    return steps[np.random.default_rng(1000 * left + right).integers(0, len(steps), size=(count, SAMPLED))]


def distances(pattern: list[int], text: list[int], anchored: bool) -> list[int]:
    """Least edit distance of pattern to a part of text that ends at each place (Myers' bit vectors).

    anchored: the part must begin where text begins.
    """
    n = len(pattern)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    places: dict[int, int] = {}
    for k, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << k
    up, down, score, out = mask, 0, n, []
    for w in text:
        equal = places.get(w, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rises = down | ~(horizontal | up) & mask
        falls = up & horizontal
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
        rises = (rises << 1 | int(anchored)) & mask
        falls = falls << 1 & mask
        up = falls | ~(vertical | rises) & mask
        down = rises & vertical
        out.append(score)
    return out


class ItemIndex:
    """Bands of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS, recall: float = RECALL):
        words = words_of([text for _, text in items])
        spans = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(items))]
        kept = [k for k in range(len(items)) if len(spans[k])]
        self.ids = [items[k][0] for k in kept]
        self.words = [spans[k].tolist() for k in kept]
        self.distinct = [frozenset(ws) for ws in self.words]
        self.lengths = np.array([len(ws) for ws in self.words], dtype=np.int64)
        self.max_edits = max_edits
        first = np.append(0, np.cumsum(self.lengths))
        seeds = self._seeds()
        #: Pairs of side lengths, and the bands of each.
        self.shapes = sorted({(left, right) for _, _, left, right in seeds})
        self.sides = np.array(self.shapes, dtype=np.int64).reshape(-1, 2)
        self.bands = [bands_for(left, right, max_edits, recall) for left, right in self.shapes]
        shape = {s: k for k, s in enumerate(self.shapes)}
        item, k = (np.array([s[x] for s in seeds], dtype=np.int64) for x in (0, 1))
        shapes = np.array([shape[s[2:]] for s in seeds], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *(spans[x] for x in kept)])
        word = flat[first[item] + k]
        # Seed words with their shapes: shapes of seed s are shaped[by_seed[s] : by_seed[s + 1]].
        self.seeds = np.unique(word)
        pairs = np.unique(np.searchsorted(self.seeds, word) * max(1, len(self.shapes)) + shapes)
        self.shaped = pairs % max(1, len(self.shapes))
        self.by_seed = np.searchsorted(pairs // max(1, len(self.shapes)), np.arange(len(self.seeds) + 1))
        self.maybe_seed = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe_seed[(self.seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        # Bands of all seeds, sorted: entries[k] is the seed that made known[k].
        at, keys = [], []
        for rows, found in self._keys(Walks(flat), first[item] + k, first[item], first[item + 1], np.arange(len(seeds)), shapes):
            at.append(np.broadcast_to(rows, found.shape).ravel())
            keys.append(found.ravel())
        keys_flat = np.concatenate([np.zeros(0, dtype=np.uint64), *keys])
        at_flat = np.concatenate([np.zeros(0, dtype=np.int64), *at])
        order = np.argsort(keys_flat, kind="stable")
        self.known = keys_flat[order]
        self.known_item, self.known_k = item[at_flat[order]], k[at_flat[order]]
        self.maybe_known = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe_known[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _seeds(self) -> list[tuple[int, int, int, int]]:
        """(item, place, words to the left, words to the right with the seed's own) of every part's seeds."""
        in_items = Counter(w for ws in self.distinct for w in ws)
        out = []
        for item, ws in enumerate(self.words):
            parts = -(-len(ws) // WINDOW)
            cuts = [len(ws) * p // parts for p in range(parts + 1)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                met: Counter[int] = Counter()
                ranked = []
                for k in range(lo, hi):
                    ranked.append((met[ws[k]], in_items[ws[k]], ws[k], k))  # a word's first place comes first
                    met[ws[k]] += 1
                for *_, k in sorted(ranked)[: int(self.max_edits * (hi - lo)) + 1]:
                    left, right = (max(x for x in SIDES if x <= side) for side in (k - lo, hi - k))
                    out.append((item, k, left, right))
        return out

    def _keys(
        self, walks: Walks, starts: np.ndarray, lows: np.ndarray, highs: np.ndarray, row_start: np.ndarray, row_shape: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, keys) of the bands of rows, each a start with a shape: keys has one line for each band."""
        lefts, rights = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        np.maximum.at(lefts, row_start, steps_for(self.sides[row_shape, 0]))
        np.maximum.at(rights, row_start, np.maximum(1, steps_for(self.sides[row_shape, 1])))
        order = np.argsort(row_shape, kind="stable")
        cuts = np.searchsorted(row_shape[order], np.arange(len(self.shapes) + 1))
        for walk in range(WALKS):
            right = embed(walks, starts, highs, walk, rights).T
            left = embed(walks, starts - 1, lows, walk, lefts, back=True).T
            for shape, (_, width) in enumerate(self.shapes):
                rows = order[cuts[shape] : cuts[shape + 1]]
                if not len(rows):
                    continue
                at = row_start[rows]
                bands = self.bands[shape][walk::WALKS]
                turn = max(1, steps_for(width))
                numbers = np.arange(walk, len(self.bands[shape]), WALKS, dtype=np.uint64) | np.uint64(shape << 16)
                keys = mixed(walks.padded[starts[at]][None, :] ^ mixed(numbers)[:, None])
                for column in bands.T:
                    words = np.empty(keys.shape, dtype=np.uint64)
                    for b, step in enumerate(column):
                        words[b] = right[step, at] if step < turn else left[step - turn, at]
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + words)
                yield rows, keys

    def starts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of seed words, and which seed each is."""
        if not len(self.seeds):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        near = np.flatnonzero(self.maybe_seed[(words >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.seeds, words[near]), len(self.seeds) - 1)
        found = self.seeds[spot] == words[near]
        return near[found], spot[found]

    def candidates(self, words: Words) -> np.ndarray:
        """Rows (text, item, word at which the item would begin) of windows that share a band, in order."""
        places, seeds = self.starts(words.hashes)
        walks, out = Walks(words.hashes), []
        for lo in range(0, len(places), MOST_STARTS):
            starts, seed = places[lo : lo + MOST_STARTS], seeds[lo : lo + MOST_STARTS]
            text = words.text[starts]
            counts = self.by_seed[seed + 1] - self.by_seed[seed]
            row_start = np.repeat(np.arange(len(starts)), counts)
            within = np.arange(len(row_start)) - np.repeat(np.cumsum(counts) - counts, counts)
            row_shape = self.shaped[self.by_seed[seed[row_start]] + within]
            for rows, keys in self._keys(walks, starts, words.first[text], words.first[text + 1], row_start, row_shape):
                band, row = np.nonzero(self.maybe_known[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                key, at = keys[band, row], row_start[rows[row]]
                begin = np.searchsorted(self.known, key, side="left")
                many = np.searchsorted(self.known, key, side="right") - begin
                at = np.repeat(at, many)
                entry = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
                out.append(np.stack([text[at], self.known_item[entry], starts[at] - self.known_k[entry]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), dtype=np.int64)

    def stretches(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, last word) around candidates, overlapping ones together."""
        found = self.candidates(words)
        if not len(found):
            return
        text, item, begin = found.T
        most = (self.max_edits * self.lengths[item]).astype(np.int64)
        lows = np.maximum(words.first[text], begin - most)
        highs = np.minimum(words.first[text + 1], begin + self.lengths[item] + most)
        same = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (lows[1:] <= highs[:-1])
        cuts = np.append(0, np.flatnonzero(~same) + 1)
        yield from zip(text[cuts].tolist(), item[cuts].tolist(), lows[cuts].tolist(), highs[np.append(cuts[1:], len(text)) - 1].tolist(), strict=True)

    def verify(self, words: Words, text: int, item: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(distance, first word, words) of the best part of words lo to hi, if it is near enough."""
        pattern = self.words[item]
        most = int(self.max_edits * len(pattern))
        part = words.hashes[lo:hi].tolist()
        # An edit takes one distinct word away at most.
        if len(self.distinct[item].intersection(part)) < len(self.distinct[item]) - most:
            return None
        scores = distances(pattern, part, anchored=False)
        if not scores or min(scores) > most:
            return None
        end = scores.index(min(scores))
        back = distances(pattern[::-1], part[end::-1], anchored=True)
        length = back.index(min(back)) + 1
        return min(scores), lo + end + 1 - length - int(words.first[text]), length

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text: (item_id, first_word, n_words, distance, item_words) of its items, the nearest part of each."""
        words = words_of(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, lo, hi in self.stretches(words):
            found = self.verify(words, text, item, lo, hi)
            if found and (found < best.get((text, item), (1 << 60,))):
                best[text, item] = found
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        for (text, item), (distance, first, length) in sorted(best.items()):
            out[text].append((self.ids[item], first, length, distance, len(self.words[item])))
        return out


HITS = "array<struct<item_id: long, first_word: long, n_words: long, distance: long, item_words: long>>"


def finder(benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL):
    """A column function: text to the array of benchmark items in it.

    The items come to the driver in blocks of BLOCK_ITEMS or BLOCK_CHARS (one longer item is a
    block), a fixed bound for what a broadcast holds; a larger benchmark takes more passes
    over the words.
    """
    spark = benchmark.sparkSession
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks, room = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if not blocks or len(blocks[-1]) == BLOCK_ITEMS or room < len(row["text"]):
            blocks.append([])
            room = BLOCK_CHARS
        blocks[-1].append((row["item_id"], row["text"]))
        room -= len(row["text"])

    def one(block: list[tuple[int, str]]):
        shared = spark.sparkContext.broadcast(ItemIndex(block, max_edits, recall))

        @F.pandas_udf(HITS)
        def found(texts: pd.Series) -> pd.Series:
            index, out = shared.value, []
            for _, part in chunks(texts.tolist()):
                for hits in index.hits(part):
                    out.append(
                        [
                            dict(zip(("item_id", "first_word", "n_words", "distance", "item_words"), h, strict=True))
                            for h in hits
                        ]
                    )
            return pd.Series(out)

        return found

    found = [one(b) for b in blocks]
    if not found:
        return lambda text: F.array().cast(HITS)
    return lambda text: F.concat(*[f(text) for f in found])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item in it.

    doc_id, item_id, first_word, n_words (the part, in words from 0), distance (word edits)
    and item_words. An item is in a document if a part of it is within MAX_EDITS edits a word
    of the item; case and signs between words don't count. Null and empty texts and items
    hold nothing. Repeated rows and items give repeated results; an empty table on either
    side gives an empty one. Other columns are left out.
    """
    found = finder(benchmark)
    return docs.select("doc_id", F.explode(found(F.col("text"))).alias("hit")).select("doc_id", "hit.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that hold no benchmark item, with the columns of docs."""
    found: Column = finder(table(spark, sf_dir, "benchmark"))(F.col("text"))
    return docs.filter(F.size(found) == 0)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
