"""Every operator on nulls, empty, blank and very long texts, ties, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from tapeweave.llm import decontam, exact_dedup, htmltext, jaccard, language, licenses, packing, quality, secrets, sharding, spelling, toxicity


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame(
        [(0, "past the old mill while people waited on the bank for news"), (1, None), (2, ""), (None, "word " * 20)],
        "item_id long, text string",
    )


OPERATORS = {
    "pack": packing.pack,
    "dedup": exact_dedup.deduplicated,
    "contaminated": lambda d: decontam.contaminated(d, benchmark(d.sparkSession)),
    "language": language.identify,
    "quality": quality.scored,
    "shard": sharding.shard_rows,
    "toxicity": lambda d: toxicity.scored(d, labels(d.sparkSession)),
    "jaccard": jaccard.joined,
    "license": licenses.license_scan,
    "secrets": secrets.secrets,
    "spelling": spelling.variants,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_documents):
    assert OPERATORS[name](no_documents).collect() == []


def test_pack(odd_documents):
    out = by_id(packing.pack(odd_documents))
    assert [(r.start, r.length, r.doc_tokens) for r in out[4]] == [(0, 1, 1)]
    assert sum(r.length for r in out[7]) == 60_001 and len(out[7]) == 30
    assert len(out[1]) == 2 and len(out[None]) == 2 and len(out[3]) == 2


def test_dedup(odd_documents):
    out = by_id(exact_dedup.deduplicated(odd_documents))
    # PROSE four times: the one with doubled spaces has the most code points.
    assert {r.keep_id for r in out[1]} == {2} and {r.group_size for r in out[1]} == {4}
    assert [r.kept for r in out[2]] == [True]
    blank = [r for i in (3, 4, 5) for r in out[i] if r.group_size == 3]
    assert {r.doc_id: r.kept for r in blank} == {3: False, 4: False, 5: True}
    assert sum(r.kept for rows in out.values() for r in rows) == 8


def test_dedup_keeps_one_of_repeated_rows(spark, odd_documents, documents_schema):
    twice = spark.createDataFrame(odd_documents.filter("doc_id = 1").collect(), documents_schema)
    assert [r.kept for r in exact_dedup.deduplicated(twice).orderBy("kept").collect()] == [False, True]
    assert exact_dedup.keep_one_each(spark, twice, "").columns == twice.columns
    assert exact_dedup.keep_one_each(spark, twice, "").count() == 1


def test_contaminated(odd_documents):
    out = by_id(decontam.contaminated(odd_documents, benchmark(odd_documents.sparkSession)))
    assert set(out) == {1, 2, None, 10, 7}
    assert all(r.item_id == 0 and r.distance == 0 for i in (1, 2, 10) for r in out[i])
    assert [r.item_id for r in out[7]] == [None]


def test_contaminated_by_an_empty_benchmark(odd_documents):
    none = benchmark(odd_documents.sparkSession).limit(0)
    assert decontam.contaminated(odd_documents, none).collect() == []


def test_spelling(odd_documents):
    found = {r.word: r for r in spelling.variants(odd_documents).collect()}
    assert found["river"].n == 5 and found["river"].root == "river" and "word" not in found
    assert all(r.form is None and r.form_n is None for r in found.values())


def test_language(odd_documents):
    out = by_id(language.identify(odd_documents))
    assert all(r.lang_pred == "und" and r.score == 0 for i in (4, 5, 9) for r in out[i])
    assert {r.lang_pred for r in out[3]} == {"und", "en"}
    assert all(not r.held_out for r in out[None])
    assert all(0 <= r.score <= 1 for rows in out.values() for r in rows)


def test_quality_and_stage(spark, odd_documents):
    out = by_id(quality.scored(odd_documents))
    assert sum(map(len, out.values())) == 13 and all(0 <= r.score <= 1 for rows in out.values() for r in rows)
    assert quality.accepted(spark, odd_documents, "").columns == odd_documents.columns


def test_shards(odd_documents):
    rows = sharding.shard_rows(odd_documents, shards=4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k % 4, k // 4) for k in range(13))
    assert {r["size"] for r in rows if r.doc_id == 4} == {1} and {r["size"] for r in rows if r.doc_id == 8} == {7}


def test_toxicity(odd_documents):
    out = by_id(toxicity.scored(odd_documents, labels(odd_documents.sparkSession)))
    assert sum(map(len, out.values())) == 13
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for rows in out.values() for r in rows)


def test_jaccard_and_stage(spark, odd_documents):
    out = by_id(jaccard.joined(odd_documents))
    assert all((r.n_shingles, r.component_id) == (0, r.doc_id) for i in (4, 5) for r in out[i])
    assert {r.component_id for r in out[1] + out[2]} == {1}
    assert [(r.n_shingles, r.component_id) for r in out[7]] == [(1, 7)]
    assert {r.component_id for r in out[None]} == {1, None}
    kept = jaccard.keep_one_each(spark, odd_documents, "")
    assert kept.columns == odd_documents.columns
    # One of the copies of PROSE (1, 1, 2 and null); 10 is longer by more than 15 %.
    assert kept.filter(F.col("text").like("The river%news of the harvest.")).count() == 1
    assert kept.count() == 10


def test_licenses(odd_documents):
    out = by_id(licenses.license_scan(odd_documents))
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in out[4]] == [(0, 0, None, "", 0.0)]
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out[10]] == [(1, 23, 23, "mit", "mit")]
    assert len(out[1]) == 2 and out[7][0].n_words == 60_000


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, lines string"
    page = "<nav>menu</nav><p>own text</p>"
    rows = [(1, "http://h/a", page, "", ""), (1, "http://h/a", page, "", ""), (2, None, None, "", ""), (None, "", "", "", ""), (3, "http://h/b", "<p>long " * 20_000, "", "")]
    out = htmltext.extracted(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.count() == 5
    assert found[1] == ("own text", 8) and found[2] == ("", 0) and found[None] == ("", 0)
    assert found[3][1] == 5 * 20_000 - 1
    assert htmltext.extracted(spark.createDataFrame([], schema)).collect() == []
