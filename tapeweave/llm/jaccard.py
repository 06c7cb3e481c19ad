"""Size-aware n-gram Jaccard join.

A document is the set of its hashed shingles. Equal sets are one class. Classes are joined
by size: below a boundary, two sets that link share a subset of the size that the link asks
of their sizes, so all such subsets of a small set are its keys; from the boundary on, sets
scan the inverted lists of their rarest shingles (prefix, length and positional filters).
The boundary is where the counted keys of both kinds are fewest. The order of shingles comes
from a sketch of their frequencies over all documents: a fixed number of counters, which only
moves cost, never results, as every set uses the same order and every candidate is verified
on its full set.

A list is not expanded into its pairs. First its members are compared with one hub, the
member with the fewest rarer shingles, which is all that a list of two needs; the components
of those links leave few longer lists with several components, and only pairs across
components are compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import table, take_rows, whole_text
from tapeweave.llm.components import components
from tapeweave.llm.textcodes import _BASE, Words, chunks, code_points, mixed
from tapeweave.session import written

SHINGLE = 4
PERCENT = 85
#: The pipeline's stage: words a shingle and least similarity in percent.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
SKETCH_BITS = 18
#: Bits of a set's parity map: bit k says whether an odd number of shingles falls on k. Two maps
#: differ in no more bits than their sets in shingles, so most pairs end before sets are read.
PARITY_BITS = 1024
#: Sizes up to which subsets may be enumerated; the boundary is chosen within.
MOST_SMALL = 24
#: Ids of so many classes may be broadcast (8 bytes each); beyond, they are joined.
BROADCAST_ROWS = 1_000_000


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def need_column(a: Column, b: Column, percent: int = PERCENT) -> Column:
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9).cast("long")


def fits(a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


# ---- sets ---------------------------------------------------------------------------------


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z."""
    codes, bounds = code_points(texts)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    words = Words(codes, bounds, "unspaced")
    hashes, text = words.runs(width)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        own = hashes[edges[k] : edges[k + 1]]
        if not len(own):
            own = words.hashes[words.first[k] : words.first[k + 1]]
            if len(own):  # fewer words than a shingle: the sequence is one
                whole = np.array([len(own)], dtype=np.uint64)
                for h in own:
                    whole = mixed(whole * _BASE + h)
                own = whole
        out.append(np.unique(own))
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = mixed(shingles).sum(dtype=np.uint64)
    b = mixed(shingles * np.uint64(0xD1342543DE82EF95) + np.uint64(7)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def parity_map(shingles: np.ndarray) -> list[int]:
    at = (shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def described(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Rows (row_key, doc_id, n, k1, k2, parity) of all documents, and rows (bucket, count) of the sketch."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64), set()
        for batch in batches:
            n, k1, k2, parity = [], [], [], []
            for _, part in chunks(batch["text"].tolist()):
                for shingles in shingle_sets(part, width):
                    key = set_key(shingles)
                    n.append(len(shingles))
                    k1.append(key[0])
                    k2.append(key[1])
                    parity.append(parity_map(shingles))
                    if key not in seen:  # copies within a task count once
                        seen.add(key)
                        counters += np.bincount(_bucket(shingles), minlength=len(counters)) if len(shingles) > 4096 else 0
                        if len(shingles) <= 4096:
                            np.add.at(counters, _bucket(shingles), 1)
            yield pd.DataFrame(
                {
                    "row_key": batch["row_key"],
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n": n,
                    "k1": k1,
                    "k2": k2,
                    "parity": parity,
                    "bucket": pd.Series([None] * len(n), dtype="Int64"),
                    "count": pd.Series([None] * len(n), dtype="Int64"),
                }
            )
        at = np.flatnonzero(counters)
        nothing = pd.Series([None] * len(at), dtype="Int64")
        yield pd.DataFrame(
            {
                "row_key": pd.Series([None] * len(at), dtype=object),
                "doc_id": nothing,
                "n": nothing,
                "k1": nothing,
                "k2": nothing,
                "parity": pd.Series([None] * len(at), dtype=object),
                "bucket": at,
                "count": counters[at],
            }
        )

    narrow = docs.select(document_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInPandas(
        describe,
        "row_key string, doc_id long, n long, k1 long, k2 long, parity array<long>, bucket long, count long",
    )


def document_key() -> Column:
    """Names a row by doc_id and text."""
    return F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2(whole_text().cast("binary"), 256)
    )


# ---- keys ---------------------------------------------------------------------------------


def subset_keys(n: int, boundary: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) under which a small set of size n has keys."""
    out = []
    for other in range(1, boundary):
        a, b = min(n, other), max(n, other)
        if fits(a, b, percent):
            out.append((a, b, need(a, b, percent)))
    return out


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary with the fewest keys: subsets below it, twice (made and scanned) the prefix from it on."""
    best, least = 1, None
    for boundary in range(1, MOST_SMALL + 2):
        cost = 0
        for n, count in sizes.items():
            if n < boundary:
                cost += count * sum(comb(n, c) for _, _, c in subset_keys(n, boundary, percent))
                if fits(n, boundary, percent):
                    cost += count * prefix_length(n, percent)
            else:
                cost += count * 2 * prefix_length(n, percent)
        if least is None or cost < least:
            best, least = boundary, cost
    return best


def keys_of(shingles: np.ndarray, sketch: np.ndarray, boundary: int, percent: int = PERCENT):
    """(keys, places) of a set. Places are those in the common order; -1 marks a subset."""
    n = len(shingles)
    keys, places = [], []
    if n < boundary:
        values = shingles.tolist()
        for a, b, size in subset_keys(n, boundary, percent):
            tag = (a << 16 | b) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            parts = np.array(list(combinations(values, size)), dtype=np.uint64)
            key = np.full(len(parts), np.uint64(tag))
            for column in parts.T:
                key = mixed(key * _BASE + column)
            keys.append(key)
            places.append(np.full(len(key), -1, dtype=np.int64))
    if n >= boundary or fits(n, boundary, percent):
        first = prefix_length(n, percent)
        order = np.lexsort((shingles, sketch[_bucket(shingles)]))[:first]
        keys.append(shingles[order])
        places.append(np.arange(len(order)))
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(places)


def shared_keys(docs: DataFrame, sketch: np.ndarray, boundary: int, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, k1, k2, n, place) of the keys that several classes have."""
    # The sketch has a fixed size.
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            for _, part in chunks(batch["text"].tolist(), 1 << 19):
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for shingles in shingle_sets(part, width):
                    name = set_key(shingles)
                    if not len(shingles) or name in seen:
                        continue
                    seen.add(name)
                    keys, places = keys_of(shingles, shared.value, boundary, percent)
                    same = np.ones(len(keys), dtype=np.int64)
                    for column, values in zip(
                        columns, (keys.astype(np.int64), same * name[0], same * name[1], same * len(shingles), places), strict=True
                    ):
                        column.append(values)
                if columns[0]:
                    names = ("key", "k1", "k2", "n", "place")
                    yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, columns, strict=True)})

    posted = docs.select("text").mapInPandas(post, "key long, k1 long, k2 long, n int, place int")
    of_key = Window.partitionBy("key")
    # Of a pair, the smaller set has the key within the prefix that sets of its own size need;
    # a member beyond that place has use only for a smaller one within it.
    n, place = F.col("n"), F.col("place")
    within = (place < 0) | (n - place >= need_column(n, n, percent))
    smallest = F.min(F.when(within, n)).over(of_key)
    useful = smallest.isNotNull() & (within | (smallest <= n))
    several = (F.min("k1").over(of_key) != F.max("k1").over(of_key)) | (F.min("k2").over(of_key) != F.max("k2").over(of_key))
    of_use = posted.withColumn("useful", useful).filter("useful").drop("useful")
    return of_use.withColumn("several", several).filter("several").drop("several").distinct()


# ---- links --------------------------------------------------------------------------------


def _linkable(a: str, b: str, percent: int = PERCENT) -> Column:
    """Length filter, and the positional one where the key is a shingle."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    asked = need_column(na, nb, percent)
    behind = 1 + F.least(na - 1 - F.col(f"{a}.place"), nb - 1 - F.col(f"{b}.place"))
    of_subset = (F.col(f"{a}.place") < 0) & (F.col(f"{b}.place") < 0)
    of_list = (F.col(f"{a}.place") >= 0) & (F.col(f"{b}.place") >= 0) & (behind >= asked)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (of_subset | of_list)


def _pairs(joined: DataFrame) -> DataFrame:
    a, b = F.col("a.node"), F.col("b.node")
    return joined.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def with_hub(lists: DataFrame) -> DataFrame:
    """The lists with their number of members, their hub, the member that has the fewest rarer shingles, and the last one.

    The three are combined before the shuffle, so a key of any size is one small row.
    """
    member = F.struct("place", "node", "n")
    return lists.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(member).alias("b"), F.max(member).alias("a"))


def pairs_of_two(ends: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs of lists with two members: hub and last one are the list."""
    return _pairs(ends.filter("members = 2 AND a.node != b.node").filter(_linkable("a", "b", percent)))


def long_lists(lists: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, node, n, place, hub) of the members of lists with more than two."""
    return lists.join(ends.filter("members > 2").select("key", F.col("b").alias("hub")), "key")


def hub_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each member of a long list with its hub."""
    both = lists.select(F.struct("place", "node", "n").alias("a"), F.col("hub").alias("b")).filter("a.node != b.node")
    return _pairs(both.filter(_linkable("a", "b", percent)))


def crossing_pairs(lists: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of members of a long list that are in different components so far, without its hub.

    One side of such a pair is outside its list's component of most members, so only those
    members are paired with all others. Pairs with the hub were compared before.
    """
    others = lists.filter("node != hub.node").drop("hub")
    known = others.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("members", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")
    )
    several = largest.filter("kinds > 1").select("key", F.col("most.component").alias("main"))
    left = written(known.join(several, "key"), "open-lists")
    minority = left.filter("component != main")
    joined = minority.alias("a").join(left.alias("b"), "key")
    crossing = F.col("a.component") != F.col("b.component")
    # Pairs of two outside members would come twice.
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    return _pairs(joined.filter(crossing & once & _linkable("a", "b", percent)))


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose parity maps allow as few different shingles as a link has."""
    u = classes.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("parity").alias("parity_u"))
    v = classes.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("parity").alias("parity_v"))
    both = pairs.join(u, "u").join(v, "v")
    bits = F.zip_with("parity_u", "parity_v", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    differ = F.aggregate(bits, F.lit(0).cast("long"), lambda total, x: total + x)
    allowed = F.col("n_u") + F.col("n_v") - 2 * need_column(F.col("n_u"), F.col("n_v"), percent)
    return both.filter(differ <= allowed).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["set_u"], batch["set_v"], strict=True):
                x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["u", "v"]]

    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v")), "v")
    both = with_v.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u")), "u")
    return both.select("u", "v", "set_u", "set_v").mapInPandas(check, "u long, v long").distinct()


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, shingles as bytes) of the wanted(node) classes, at least once each.

    Rows that repeat a doc_id and text give one set a task.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            done = [s for _, part in chunks(batch["text"].tolist()) for s in shingle_sets(part, width)]
            keys = [set_key(s) for s in done]
            right = []
            for key, a, b, node in zip(keys, batch["k1"], batch["k2"], batch["node"].tolist(), strict=True):
                right.append(key == (a, b) and node not in seen)
                if right[-1]:
                    seen.add(node)
            frame = pd.DataFrame({"node": batch["node"], "shingles": [s.astype("<u8").tobytes() for s in done]})
            yield frame[right]

    chosen = classes.join(wanted, "node").select("node", "k1", "k2", F.col("doc_id").alias("class_doc"))
    chosen = written(chosen, "wanted-classes")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("class_doc"))).select("node", "k1", "k2", "text")
    return found.mapInPandas(sets, "node long, shingles binary")


def linked_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs(u, v) that link. Only sets of classes in a near enough pair are made again."""
    pairs = written(near_enough(pairs, classes, percent), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = written(full_sets(docs, classes, wanted, width), "full-sets")
    return written(verified(pairs, sets, percent), "linked-pairs")


def grouped(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs(doc_id, text): row_key, doc_id, n_shingles, group (null: no shingles), component_id."""
    spark = docs.sparkSession
    told = written(described(docs, width), "shingle-sets")
    rows = told.filter("bucket IS NULL").select("row_key", "doc_id", "n", "k1", "k2", "parity")
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    counters = told.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")).toPandas()
    sketch[counters["bucket"].to_numpy(dtype=np.int64)] = counters["count"]
    classes = rows.filter("n > 0").groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("parity").alias("parity")
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= 2 * MOST_SMALL).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, percent)

    posted = written(shared_keys(docs, sketch, boundary, width, percent), "shared-keys")
    lists = posted.join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("key", "node", "n", "place")
    lists = written(lists, "lists")
    ends = written(with_hub(lists), "list-ends")
    lists = written(long_lists(lists, ends), "long-lists")
    first = pairs_of_two(ends, percent).unionByName(hub_pairs(lists, percent)).distinct()
    links = linked_pairs(docs, classes, first, width, percent)
    more = linked_pairs(docs, classes, crossing_pairs(lists, components(links), percent), width, percent)
    found = components(links.unionByName(more))

    named = classes.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    named = written(named.select("k1", "k2", "group", "doc_id"), "groups")
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    members = named.select("k1", "k2", "group").join(least, "group")
    linked = rows.filter("n > 0").join(members, ["k1", "k2"]).select("row_key", "doc_id", "n", "group", "component_id")
    alone = rows.filter("n = 0").select(
        "row_key", "doc_id", "n", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")


def joined(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are linked with nothing. A null doc_id is
    linked by its text like any other; component_id is the smallest doc_id that is not null,
    and null if there is none. Repeated rows are in one component. An empty table gives an
    empty result. Other columns are left out.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id (null last), with the columns of docs.

    Its shingles and threshold are the stage's (STAGE_SHINGLE, STAGE_PERCENT), not those of op9.
    """
    rows = grouped(docs, STAGE_SHINGLE, STAGE_PERCENT).select(
        "row_key", F.col("doc_id").isNull().alias("no_id"), "doc_id", F.coalesce(F.col("group").cast("string"), "row_key").alias("group")
    )
    kept = rows.groupBy("group").agg(F.min(F.struct("no_id", "doc_id", "row_key")).alias("least"))
    return take_rows(docs, document_key(), written(kept.select("least.row_key"), "kept-rows"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))
