"""Spelling variants: words one edit apart, each led to its most frequent form.

The counted vocabulary is laid out twice, sorted by the words and by the words read backwards,
and cut into blocks of BLOCK_SYMBOLS. A block is a bidirectional FM-index (fmindex.py). Words
that share a word's first half stand in the few consecutive blocks of the one layout whose range
holds that half, words that share its second half in those of the other: so each word is a
query to these blocks only, and every pair one edit apart keeps one of the two halves. Queries
of a block are dealt by where they come from into slices, each with the block's index, so no
task holds more than a block and the queries of SLICE_BLOCKS others, streamed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.llm.fmindex import BidirectionalIndex
from tapeweave.session import written

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form is at least so many times as frequent.
FORM_RATIO = 2
#: One in so many (document, run) pairs loses a code point.
SPOILED = 97
#: Letters and delimiters of a block, and of the words that a task counts at once.
BLOCK_SYMBOLS = 1 << 19
COUNTED_SYMBOLS = 1 << 22
#: Blocks whose words a slice of another block's queries may come from.
SLICE_BLOCKS = 4
#: Queries that take their steps together.
BATCH = 8192
#: Code points of a word that its place among the blocks is decided by.
MARK = 64

_LOWERED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """A-Z in lower case, all else as it is."""
    return run.lower() if run.isascii() else run.translate(_LOWERED)


def spelled(doc_id: str, run: str) -> str:
    """The word that a lower-cased run counts as in a document: one in SPOILED lacks a code point."""
    drawn = zlib.crc32(f"{doc_id}:{run}".encode())
    if drawn % SPOILED:
        return run
    gone = drawn % len(run)
    return run[:gone] + run[gone + 1 :]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text) long and frequent enough. Words are counted in tasks first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                before = len(total)
                for run, n in Counter(RUNS.findall(text)).items():
                    word = spelled(doc_id, lowered(run))
                    if len(word) >= least_length:
                        total[word] += n
                        held += len(word) if n == total[word] else 0
                held += 8 * (len(total) - before)
                if held > COUNTED_SYMBOLS:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total.clear()
                    held = 0
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter("text IS NOT NULL")
    parts = narrow.mapInPandas(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---- blocks -------------------------------------------------------------------------------


def laid_out(words: DataFrame, symbols: int, backwards: bool) -> DataFrame:
    """words(word, n) in order, as (word, n, block): block numbers follow the order, a block has about BLOCK_SYMBOLS."""
    key = F.reverse("word") if backwards else F.col("word")
    parts = max(1, -(-symbols // BLOCK_SYMBOLS))
    ranged = words.withColumn("key", key).repartitionByRange(parts, "key")
    ranged = ranged.withColumn("part", F.spark_partition_id().cast("long"))
    # A range is a block; one with many long words is cut further.
    ahead = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.floor(F.sum(F.length("word") + 1).over(ahead) / F.lit(2 * BLOCK_SYMBOLS))
    return written(
        written(ranged, "spelling-ranges").select("word", "n", (F.col("part") * (1 << 31) + within).alias("block")),
        "spelling-blocks",
    )


def block_marks(layout: DataFrame, backwards: bool) -> tuple[list[int], list[str]]:
    """Block numbers in order and the start of each one's first key: a row for about BLOCK_SYMBOLS letters."""
    key = F.reverse("word") if backwards else F.col("word")
    rows = layout.groupBy("block").agg(F.min(F.substring(key, 1, MARK)).alias("mark")).collect()
    rows.sort(key=lambda r: r["block"])
    return [r["block"] for r in rows], [r["mark"] for r in rows]


def blocks_with(head: str, marks: list[str]) -> range:
    """Places of the blocks that may hold keys beginning with head. Marks are starts of each block's first key."""
    head = head[:MARK]
    return range(max(0, bisect_left(marks, head) - 1), bisect_right(marks, head + "\U0010ffff"))


def routed(layout: DataFrame, backwards: bool) -> DataFrame:
    """(keep, block, slice, query, word, n): each word as a query to the blocks that share a half, and the blocks' own words."""
    blocks, marks = block_marks(layout, backwards)
    place = {block: k for k, block in enumerate(blocks)}

    def queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n, block in zip(batch["word"], batch["n"], batch["block"], strict=True):
                half = len(word) // 2
                head = word[half:][::-1] if backwards else word[:half]
                home = place[block] // SLICE_BLOCKS
                out += [(k, home, word, n) for k in blocks_with(head, marks)]
            yield pd.DataFrame(out, columns=["block", "slice", "word", "n"]).astype({"block": "int64", "slice": "int64", "n": "int64"})

    if not blocks:
        return layout.select(F.lit(backwards).alias("backwards"), F.lit(0).alias("slice"), F.lit(True).alias("query"), "word", "n", "block")
    asked = layout.mapInPandas(queries, "block long, slice long, word string, n long")
    slices = asked.select("block", "slice").distinct()
    numbers = layout.sparkSession.createDataFrame(list(place.items()), "number long, place long")
    own = layout.join(F.broadcast(numbers), F.col("block") == F.col("number")).select(F.col("place").alias("block"), "word", "n")
    indexed = own.join(slices, "block")
    columns = ["block", "slice", "query", "word", "n"]
    both = indexed.withColumn("query", F.lit(False)).select(columns).unionByName(asked.withColumn("query", F.lit(True)).select(columns))
    return both.withColumn("backwards", F.lit(backwards))


LINKS = "word string, near string, near_n long"


def linked(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one partition, whose rows come by block and slice, the words of the index first."""
    index, key, words, counts = None, None, [], []
    for batch in rows:
        keys = batch[["backwards", "block", "slice"]].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(batch))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if not hi > lo:
                continue
            part = batch.iloc[lo:hi]
            if key is None or (keys[lo] != key).any():
                index, key, words, counts = None, keys[lo], [], []
            own = part[~part["query"]]
            words += own["word"].tolist()
            counts += own["n"].tolist()
            asked = part.loc[part["query"], "word"].tolist()
            if not asked:
                continue
            if index is None:
                index, n = BidirectionalIndex(words), np.array(counts, dtype=np.int64)
                names = np.array(words, dtype=object)
            keep = "tail" if key[0] else "head"
            for first in range(0, len(asked), BATCH):
                group = asked[first : first + BATCH]
                for query, word in index.near(group, keep):
                    yield pd.DataFrame({"word": np.array(group, dtype=object)[query], "near": names[word], "near_n": n[word]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words(word, n), distinct words of two code points or more, one edit apart."""
    symbols = words.agg(F.sum(F.length("word") + 1).alias("s")).first()["s"] or 0
    both = [routed(laid_out(words, symbols, backwards), backwards) for backwards in (False, True)]
    spark = words.sparkSession
    # A task for every block's slice where there are enough, dealt in turn.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * symbols // BLOCK_SYMBOLS))
    turn = F.pmod(2 * F.col("block") + F.col("backwards").cast("long") + 7919 * F.col("slice"), F.lit(tasks)).cast("int")
    dealt = both[0].unionByName(both[1]).repartitionById(tasks, turn)
    return dealt.sortWithinPartitions("backwards", "block", "slice", "query").mapInPandas(linked, LINKS)


# ---- forms --------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of forms(word, form) that have a form: the last of the chain.

    Every round leads each word as far as its target has been led, so rounds grow with the
    logarithm of a chain's length; each is written to the shared folder.
    """
    led = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "spelling-roots")
    while True:
        target = led.select(F.col("word").alias("to"), F.col("to").alias("next"))
        led = written(
            led.select("word", "to")
            .join(target, "to", "left")
            .select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if led.filter("moved").isEmpty():
            return led.select("word", F.col("to").alias("root"))
        led = led.drop("moved")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word of docs(doc_id, text): word, form, root, n, n_near, form_n.

    Near words differ by one inserted, deleted or replaced code point; the form is the near
    word of largest n (ties: smallest), if at least FORM_RATIO times as frequent. Null and
    empty texts hold no words; a null doc_id counts as empty; repeated rows count each. A
    run of any length is a word. An empty table gives an empty result. Other columns are
    left out.
    """
    words = written(vocabulary(docs, least_length, least_count), "spelling-words")
    none = F.lit(None)
    said = words.select("word", "n", none.cast("string").alias("near"), none.cast("long").alias("near_n"))
    links = near_words(words).select("word", none.cast("long").alias("n"), "near", "near_n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near"))))
    found = said.unionByName(links).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    leads = F.coalesce(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.lit(False))
    forms = written(
        found.select(
            "word",
            F.when(leads, F.col("best.near")).alias("form"),
            "n",
            "n_near",
            F.when(leads, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The same words and links in SQL: crc32 byte by byte, near words by what is left without one code point.
OP11_SQL = f"""
WITH RECURSIVE
steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
lowered AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs GROUP BY ALL),
drawn AS (
  SELECT run, n, xor(list_reduce(
      flatten(list_transform(string_split(doc || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM lowered, steps),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {SPOILED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn)
  GROUP BY word HAVING length(word) >= {LEAST_LENGTH} AND sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
without AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM places),
shorter AS (SELECT w.word AS longer, v.word AS short FROM without w JOIN words v ON w.rest = v.word),
links AS (
  SELECT a.word, b.word AS near FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT longer, short FROM shorter UNION SELECT short, longer FROM shorter),
best AS (
  SELECT l.word, count(*) AS n_near, max(v.n) AS most, min(struct_pack(less := -v.n, near := l.near)).near AS near
  FROM links l JOIN words v ON v.word = l.near GROUP BY l.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN most >= {FORM_RATIO} * w.n THEN near END AS form, CASE WHEN most >= {FORM_RATIO} * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL"""
