"""Packing of documents into token sequences as a cutting-stock problem.

Documents are tokenized where they lie; a document longer than a sequence gives full pieces
and one rest. Piece lengths fall into classes of WIDTH tokens. The class histogram (at most
CAPACITY / WIDTH rows, over all pieces) goes to the driver, where a linear program over
patterns (how many pieces of each class fill a sequence) is solved by column generation: a
knapsack dynamic program prices the next pattern from the duals. Rounded down, its patterns
serve almost all pieces; what is left of the histogram, fewer sequences than there are
classes, is filled largest first. Pieces are ranked within their class over hash buckets and
take the pattern slot of their rank, so no class meets in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.llm.textcodes import Words, chunks, code_points
from tapeweave.session import written

CAPACITY = 2048
WIDTH = 8
BUCKETS = 256
#: Ends the search for better patterns; what is found by then is still a whole packing.
MOST_PATTERNS = 4000
#: What a Python worker remembers: bytes of the ids of words, and of pieces of words in each of
#: two generations; what a piece takes besides its characters and ids, and the longest piece.
TABLE_BYTES, PIECE_BYTES = 48 << 20, 12 << 20
ENTRY_BYTES = 160
LONGEST_REMEMBERED = 64
#: Characters whose words are looked up at once.
CHUNK = 1 << 19
END_ID = np.array([1], dtype="<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- tokens -------------------------------------------------------------------------------

#: The pieces that the tokenizer's own pattern cuts words into.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that lower() and the tokenizer's normalizer treat alike, without special tokens.
_PLAIN = re.compile("[\x21-\x3b\x3d-\x7eÀ-įı-ſ]+")
#: str.split() takes these for white space, the tokenizer does not.
_CONTROL = re.compile("[\x1c-\x1f]")


class PieceTokens(dict):
    """Ids of the pieces that the tokenizer's pattern cuts; remembers what it has seen, bound in bytes.

    The younger generation is here, the one before in `older`. When the younger is full it
    becomes the older and the one before goes; what is asked for again moves up, so frequent
    pieces stay.
    """

    def __init__(self, model, most: int = PIECE_BYTES):
        super().__init__()
        self.model = model
        self.most = most
        self.held = 0
        self.older: dict[str, tuple[int, ...]] = {}
        self.letters = _byte_letters()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            ids = tuple(t.id for t in self.model.tokenize(spelled))
        if len(piece) <= LONGEST_REMEMBERED:
            self.held += len(piece) + 8 * len(ids) + ENTRY_BYTES
            if self.held > self.most:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids


class WordTokens:
    """Ids of texts by way of their words; remembers the ids of words by their hash, bound in bytes.

    The tokenizer drops white space before it cuts, so the ids of a text are those of its
    words one after another. Words of plain letters go to the tokenizer's model piece by
    piece, all others through the whole tokenizer. A word is known by a 64-bit hash.
    """

    def __init__(self, path: str, most: int = TABLE_BYTES):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cut = regex.compile(_PIECES).findall
        self.pieces = PieceTokens(self.whole.model)
        self.piece = self.pieces.__getitem__
        self.most = most
        self.forget()

    def forget(self) -> None:
        #: Hashes of known words in order, where their ids begin in the pool, and how many they are.
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")
        self.pieces.clear()
        self.pieces.older, self.pieces.held = {}, 0

    def answer(self, word: str) -> list[int] | tuple[int, ...]:
        if not _PLAIN.fullmatch(word):
            return self.whole.encode(word, add_special_tokens=False).ids
        lowered = word.lower()
        if lowered.isalpha():
            return self.piece(lowered)
        if lowered[-1] in ".,;:!?" and lowered[:-1].isalpha():
            return self.piece(lowered[:-1]) + self.piece(lowered[-1])
        return [i for piece in self.cut(lowered) for i in self.piece(piece)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds the ids of words, whose hashes are in order and not known."""
        answers = [self.answer(w) for w in words]
        counts = np.array([len(a) for a in answers], dtype=np.int64)
        firsts = len(self.pool) + np.cumsum(counts) - counts
        spot = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, spot, hashes)
        self.first = np.insert(self.first, spot, firsts)
        self.count = np.insert(self.count, spot, counts)
        self.pool = np.concatenate([self.pool, np.fromiter((i for a in answers for i in a), dtype="<u4", count=int(counts.sum()))])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        codes, bounds = code_points(texts)
        words = Words(codes, bounds, "visible")
        hashes, places, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if 24 * len(self.known) + self.pool.nbytes > self.most:
            self.forget()
        spot = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        missing = np.flatnonzero(self.known[spot] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(missing):
            whole = "".join(texts)
            starts = words.starts[places[missing]]
            ends = starts + words.lengths[places[missing]]
            self._learn(hashes[missing], [whole[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        spot = np.searchsorted(self.known, hashes)[inverse]
        counts = self.count[spot]
        ahead = np.append(0, np.cumsum(counts))
        ids = self.pool[np.arange(int(ahead[-1])) + np.repeat(self.first[spot] - ahead[:-1], counts)]
        cuts = ahead[words.first]
        return [ids[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def text(self, text: str) -> bytes:
        """The ids of one text, little-endian."""
        return next(self.texts([text])).tobytes()

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, without the end id; null is empty. Texts are worked on in chunks."""
        for _, part in chunks(texts, CHUNK):
            odd = {k for k, text in enumerate(part) if _CONTROL.search(text)}
            found = self._plain(["" if k in odd else text for k, text in enumerate(part)])
            for k, text in enumerate(part):
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4") if k in odd else found[k]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_TOKENS: dict[str, WordTokens] = {}


@contextmanager
def word_tokens(path: str) -> Iterator[WordTokens]:
    """The worker's tokenizer, kept between tasks; what it remembers goes with the task."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    try:
        yield _TOKENS[path]
    finally:
        _TOKENS[path].forget()


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity ids of every row; a null text is one piece with the end id."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        with word_tokens(tokenizer) as tokens:
            for batch in batches:
                out = []
                for doc_id, found in zip(batch["doc_id"], tokens.texts(batch["text"].tolist()), strict=True):
                    ids = found.tobytes() + END_ID
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
                frame = pd.DataFrame(out, columns=columns)
                yield frame.astype({c: "int64" for c in columns[1:]} | {"doc_id": "Int64"})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(cut, PIECE_SCHEMA)


# ---- patterns -----------------------------------------------------------------------------


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within capacity: its value and the count of each size."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 0)
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        fits = useful[: np.searchsorted(sizes[useful], room, side="right")]
        if len(fits):
            gains = best[room - sizes[fits]] + values[fits]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], choice[room] = gains[k], fits[k]
    counts = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for these small matrices, without the threads that a linear algebra library starts."""
    return np.einsum("ij,j->i" if b.ndim == 1 else "ij,jk->ik", a, b)


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = MOST_PATTERNS
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (as columns) and their real-valued uses that serve demand with least sequences.

    Revised simplex with the inverse of the basis kept up to date. sizes ascend.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    uses = _times(inverse, demand)
    for step in range(most):
        duals = inverse.sum(axis=0)
        value, column = knapsack(duals, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        direction = _times(inverse, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, uses / direction, np.inf)
        leaves = int(ratios.argmin())
        if not np.isfinite(ratios[leaves]):
            break
        basis[:, leaves] = column
        pivot = inverse[leaves] / direction[leaves]
        inverse -= direction[:, None] * pivot[None]
        inverse[leaves] = pivot
        if step % 200 == 199:  # a Newton step takes out what rounding has added up
            inverse = 2 * inverse - _times(inverse, _times(basis, inverse))
        uses = np.maximum(_times(inverse, demand), 0.0)
    return basis.astype(np.int64), uses


def rounded_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of uses whose pieces are exactly the demand."""
    basis, uses = column_generation(sizes, demand.astype(float), capacity)
    times = np.floor(uses + 1e-6).astype(np.int64)
    left = demand - basis @ times
    for k in np.argsort(-times):  # rounding errors: no class may get more slots than pieces
        while (left < 0).any() and times[k] > 0 and (basis[left < 0, k] > 0).any():
            times[k] -= 1
            left = left + basis[:, k]
    plan = [(basis[:, k], int(times[k])) for k in range(basis.shape[1]) if times[k] > 0]
    while left.any():  # fewer sequences than classes: largest first
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        uses_left = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, uses_left))
        left = left - pattern * uses_left
    return plan


def slot_ranges(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence) of each class in each pattern."""
    taken, first, rows = dict.fromkeys(map(int, sizes), 0), 0, []
    for pattern, times in plan:
        for k in np.flatnonzero(pattern):
            size, each = int(sizes[k]), int(pattern[k])
            rows.append((size, taken[size], taken[size] + each * times, each, first))
            taken[size] += each * times
        first += times
    return rows


# ---- the operator -------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """One row per piece of docs(doc_id, text).

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every row of docs is
    cut, also with null or repeated doc_id; null and empty texts are the end id alone. Equal
    pieces take neighbouring slots. An empty table gives an empty result. Other columns are
    left out.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    keys = ["doc_id", "start", "ids_crc32", "length"]
    classed = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    )
    counts = classed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "class-counts")
    histogram = {row["class"]: row["n"] for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(histogram), dtype=np.int64)
    plan = rounded_patterns(sizes, np.array([histogram[s] for s in sizes]), capacity // width) if histogram else []
    ranges = spark.createDataFrame(
        slot_ranges(sizes, plan), "class int, first_rank long, end_rank long, each long, first_sequence long"
    )
    # One row per class and bucket, and one per class and pattern: both bounded by parameters.
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "bucket").orderBy(*keys)
    ranked = (
        classed.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["class", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place"))
    )
    placed = ranked.join(F.broadcast(ranges), "class").filter("rank >= first_rank AND rank < end_rank")
    placed = placed.withColumn(
        "sequence_id",
        (F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))).cast("long"),
    )
    ahead = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("length"), "class", "rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packed ids: sequence_id, ids, and the lengths of its pieces in order.

    For docs whose doc_ids are unique. A sequence holds at most capacity ids, so what is
    gathered for one is bounded.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with word_tokens(path) as tokens:
            for batch in batches:
                ids = []
                for found, start, length in zip(tokens.texts(batch["text"].tolist()), batch["start"], batch["length"], strict=True):
                    whole = found.tobytes() + END_ID
                    ids.append(np.frombuffer(whole[4 * start : 4 * (start + length)], dtype="<u4").astype("int32"))
                yield batch[["sequence_id", "offset", "length"]].assign(ids=ids)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut_ids = (
        pieces.join(texts, "doc_id")
        .select("sequence_id", "offset", "start", "length", "text")
        .mapInPandas(cut, "sequence_id long, offset long, length long, ids array<int>")
    )
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        cut_ids.groupBy("sequence_id")
        .agg(ordered.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of what is left, in sequences."""
    return pack(docs)


def op1_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
