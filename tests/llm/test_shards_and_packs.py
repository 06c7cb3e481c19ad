"""Sharding and packing: permutations, exact covers, and ids against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeweave.llm import packing, sharding


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 100, 257, 1000])
def test_permutation_and_inverse(spark, size):
    permutation = sharding.Permutation(size)
    rows = (
        spark.range(size)
        .withColumn("to", permutation.forward(F.col("id")))
        .withColumn("back", permutation.backward(F.col("to")))
        .collect()
    )
    assert sorted(r["to"] for r in rows) == list(range(size))
    assert all(r["back"] == r["id"] for r in rows)


def test_permutation_shuffles(spark):
    rows = spark.range(4000).select(sharding.Permutation(4000).forward(F.col("id")).alias("x")).collect()
    x = np.array([r.x for r in rows])
    assert abs(np.corrcoef(np.arange(4000), x)[0, 1]) < 0.1 and (x != np.arange(4000)).mean() > 0.99


def test_shards_do_not_depend_on_partitions(spark, corpus):
    docs = spark.createDataFrame(corpus[["doc_id", "text"]])
    first = {r.doc_id: r for r in sharding.shard_rows(docs.repartition(2)).collect()}
    again = {r.doc_id: r for r in sharding.shard_rows(docs.repartition(7)).collect()}
    assert first == again
    for doc_id, text in zip(corpus.doc_id, corpus.text, strict=True):
        assert first[doc_id]["size"] == len(text.encode()) + 1
        assert first[doc_id].text_crc32 == zlib.crc32(text.encode())


def test_written_shards(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus[["doc_id", "text"]])
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=4)
    assert spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "text").exceptAll(docs).count() == 0
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


ODD_TEXTS = [
    "İSTANBUL ǅ straße ſ K ﬁ", "don't <|endoftext|> we'LL 'S", "a\x1cb\x85c d é ñ", "日本語 テスト 한국어 ①②",
    "ΣΑΣ ΟΔΟΣ x² ½ ª", "﻿hi ​zero", "___ a_b -- ...", "é ́x", "A B", "\x00 \x7f",
]


def test_ids_are_the_tokenizers(corpus):
    whole = Tokenizer.from_file(packing.default_tokenizer())
    words = packing.WordTokens(packing.default_tokenizer())
    for text in [*corpus.text.head(60), *ODD_TEXTS]:
        expected = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.text(text), dtype="<u4").tolist() == expected


def test_ids_do_not_depend_on_what_is_remembered(corpus, monkeypatch):
    """Tiny bounds, chunks of a text each, and words of a megabyte give the same ids."""
    monkeypatch.setattr(packing, "CHUNK", 100)
    whole = Tokenizer.from_file(packing.default_tokenizer())
    words = packing.WordTokens(packing.default_tokenizer(), most=2_000)
    words.piece.__self__.most = 1_000
    texts = [*corpus.text.head(40), None, "", *ODD_TEXTS, "ab" * 500_000 + " end", "x" * 70 + " " + "x" * 70]
    for text, ids in zip(texts, words.texts(texts), strict=True):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert 24 * len(words.known) + words.pool.nbytes < 2_000_000 + 2_000
    assert sum(map(len, words.piece.__self__.older)) < 2_000


def test_packing_round_trip(spark, corpus):
    docs = spark.createDataFrame(corpus[["doc_id", "text"]]).repartition(3)
    pieces = packing.pack(docs).cache()
    rows = pieces.collect()
    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: whole.encode(t, add_special_tokens=False).ids + [1] for d, t in zip(corpus.doc_id, corpus.text, strict=True)}
    covered = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part)
    assert covered == {d: len(x) for d, x in ids.items()}
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    assert 1 - sum(used.values()) / (2048 * len(used)) < 0.03
    packed = {r.sequence_id: r for r in packing.sequences(docs, pieces).collect()}
    assert {s: len(r.ids) for s, r in packed.items()} == used
    some = rows[0]
    start = some.offset
    assert packed[some.sequence_id].ids[start : start + some.length] == ids[some.doc_id][some.start : some.start + some.length]


def test_patterns_serve_the_demand_exactly():
    rng = np.random.default_rng(3)
    for _ in range(5):
        sizes = np.sort(rng.choice(np.arange(1, 65), size=20, replace=False))
        demand = rng.integers(1, 500, size=20)
        plan = packing.rounded_patterns(sizes, demand, 64)
        assert (sum(pattern * times for pattern, times in plan) == demand).all()
        assert all((pattern * sizes).sum() <= 64 for pattern, _ in plan)
        used, least = sum(times for _, times in plan), (sizes * demand).sum() / 64
        _, uses = packing.column_generation(sizes, demand.astype(float), 64)
        assert uses.sum() >= least - 1e-6 and used <= uses.sum() + len(sizes)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 4, 7, 9])
    for _ in range(20):
        values = rng.uniform(-0.2, 1, size=4)
        value, counts = packing.knapsack(values, sizes, 20)
        best = max(
            a * values[0] + b * values[1] + c * values[2] + d * values[3]
            for a in range(7) for b in range(6) for c in range(3) for d in range(3)
            if 3 * a + 4 * b + 7 * c + 9 * d <= 20
        )
        assert abs(value - best) < 1e-9 and abs((counts * values).sum() - best) < 1e-9 and (counts * sizes).sum() <= 20
