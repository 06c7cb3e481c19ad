"""License scan: exact containment join of text blocks with license templates.

A block is a set of words: a line of a text, or, for notices wrapped over lines, words in a row
that cross line breaks, as many as the template has (whole lines would mix notices that stand
below each other). A line without words, be it of comment signs, ends what is joined. A template
matches a block that holds at least CONTAINMENT of the template's distinct words. Words are
ordered by how many blocks of the whole corpus hold them, rarest first; a match needs one of the
template's first n - o + 1 words (n: its words, o: the overlap asked for), at least o words in
the block, and enough words behind the first common one on both sides. The overlap of what
passes these prefix, length and positional filters is counted exactly.

Only words of templates leave the scan, so what is joined is narrow. Beside it stands the
plain search for phrases. No Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import table, whole_text
from tapeweave.session import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without the line break.
SPACES = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.85

# Phrases of the contract with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common license notices with their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]


def template_sets(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, text in templates]


def least_overlap(size: int, containment: float = CONTAINMENT) -> int:
    """Smallest whole number of words that is containment of size words or more."""
    return -(-round(size * containment * 1000) // 1000)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _places(words: Column, phrase: str) -> Column:
    """Positions from 0 where the words of phrase stand one after another."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - 1)

    def stands(i: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.get(words, i + k) == part for k, part in enumerate(parts)))

    return F.when(F.size(words) > 0, F.filter(at, lambda i: F.coalesce(stands(i), F.lit(False))))


def _windows(templates: list[tuple[str, str]], containment: float) -> list[tuple[list[str], int, int]]:
    """Per template its distinct words, the overlap asked for, and how many words it has in a row."""
    sets = template_sets(templates)
    return [
        (words, least_overlap(len(words), containment), len(text.split()))
        for (_, text), (_, words) in zip(templates, sets, strict=True)
    ]


def _wrapped_blocks(text: Column, windows: list[tuple[list[str], int, int]]) -> Column:
    """Template words of the words in a row that cross a line break and hold enough of the template."""
    reach = max((width for _, _, width in windows), default=1)

    def around(tokens: Column) -> Column:
        breaks = F.array_compact(F.transform(tokens, lambda token, i: F.when(token == "\n", i)))

        def blocks(i: Column) -> Column:
            # A line of a paragraph has a word at least, so reach words lie within twice as many tokens.
            before = F.slice(tokens, F.greatest(i - 2 * reach, F.lit(0)) + 1, F.least(i, F.lit(2 * reach)))
            after = F.slice(tokens, i + 2, F.lit(2 * reach))
            before, after = (F.slice(F.array_remove(x, "\n"), 1, reach) for x in (F.reverse(before), after))
            run, edge = F.concat(F.reverse(before), after), F.size(before)

            def held(words: list[str], least: int, width: int) -> Column:
                known = F.array(*[F.lit(w) for w in words])
                starts = F.sequence(F.greatest(edge - width + 1, F.lit(0)), F.greatest(edge - 1, F.lit(0)))
                inside = F.transform(starts, lambda at: F.array_intersect(F.slice(run, at + 1, width), known))
                enough = F.array_distinct(F.filter(inside, lambda found: F.size(found) >= least))
                return F.when(F.size(F.array_intersect(run, known)) >= least, enough)

            return F.flatten(F.array_compact(F.array(*[held(*window) for window in windows])))

        return F.flatten(F.transform(breaks, blocks))

    paragraphs = F.split(text, r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n")
    tokens = F.transform(paragraphs, lambda p: F.array_remove(F.split(F.replace(p, F.lit("\n"), F.lit(" \n ")), SPACES), ""))
    return F.flatten(F.transform(F.filter(tokens, lambda t: F.array_contains(t, "\n")), around))


def scanned(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """Per row: doc_id, n_words, the phrases' places and labels, and each block's template words."""
    known = F.array(*[F.lit(w) for w in sorted({w for _, words in template_sets(templates) for w in words})])
    # Letters beyond A-Z that lower() also changes are in no phrase and no template.
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(whole_text()).alias("text"))
    any_phrase = "|".join(p.replace(" ", SEPARATORS) for p in PHRASES)
    words = lowered.select(
        "doc_id",
        F.col("text").rlike(any_phrase).alias("may_hold"),
        _words(F.col("text")).alias("words"),
        F.filter(
            F.transform(F.split("text", "\n"), lambda line: F.array_intersect(F.split(line, SEPARATORS), known)),
            lambda found: F.size(found) > 0,
        ).alias("lines"),
        "text",
    )
    # Few texts hold the words of a template at all; only in those are lines joined.
    windows = _windows(templates, containment)
    present = F.array_distinct(F.flatten("lines"))
    enough = [F.size(F.array_intersect(present, F.array(*[F.lit(w) for w in own]))) >= least for own, least, _ in windows]
    may_wrap = reduce(lambda a, b: a | b, enough, F.lit(False)) & F.contains(F.col("text"), F.lit("\n"))
    wrapped = F.when(may_wrap, _wrapped_blocks(F.col("text"), windows)).otherwise(F.array().cast("array<array<string>>"))
    empty = F.array().cast("array<int>")
    named = [(f"places_{k}", phrase, label) for k, (phrase, label) in enumerate(PHRASES.items())]
    placed = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.concat("lines", wrapped).alias("blocks"),
        *[
            F.when(F.col("may_hold"), F.coalesce(_places(F.col("words"), phrase), empty)).otherwise(empty).alias(name)
            for name, phrase, _ in named
        ],
    )
    every = F.concat(*[F.col(name) for name, _, _ in named])
    labels = F.array_compact(F.array(*[F.when(F.size(name) > 0, F.lit(label)) for name, _, label in named]))
    return placed.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        "blocks",
    )


def word_order(blocks: DataFrame) -> dict[str, int]:
    """Template words by how many blocks hold them, rarest first. Bounded by the templates."""
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    ordered = sorted((row["count"], row["word"]) for row in counts)
    return {word: rank for rank, (_, word) in enumerate(ordered)}


def prefix_index(
    spark: SparkSession,
    order: dict[str, int],
    templates: list[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame | None:
    """word, place, and the template it starts. Templates with a word that no block holds keep it as rarest."""
    rows = []
    for number, (label, words) in enumerate(template_sets(templates)):
        ranked = sorted(words, key=lambda w: (order.get(w, -1), w))
        least = least_overlap(len(ranked), containment)
        for place, word in enumerate(ranked[: len(ranked) - least + 1]):
            rows.append(
                F.struct(
                    F.lit(word).alias("word"),
                    F.lit(place).alias("place"),
                    F.lit(number).alias("template"),
                    F.lit(label).alias("label"),
                    F.lit(least).alias("least"),
                    F.array(*[F.lit(w) for w in ranked]).alias("template_words"),
                )
            )
    return spark.range(1).select(F.explode(F.array(*rows)).alias("entry")).select("entry.*") if rows else None


def matched_blocks(
    blocks: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """blocks(row_id, block, words) with every template they contain: label, template, contained."""
    order = word_order(blocks)
    index = prefix_index(blocks.sparkSession, order, templates, containment)
    if not order or index is None:
        return blocks.select(
            "row_id", "block", F.lit("").alias("label"), F.lit(0).alias("template"), F.lit(0.0).alias("contained")
        ).limit(0)
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ordered = blocks.withColumn("words", F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("rank"), w.alias("word")))))
    ordered = ordered.select("row_id", "block", F.col("words.word").alias("words"))
    least = min(least_overlap(len(words), containment) for _, words in template_sets(templates))
    tokens = ordered.filter(F.size("words") >= least).select("row_id", "block", "words", F.posexplode("words").alias("at", "word"))
    behind = 1 + F.least(F.size("template_words") - 1 - F.col("place"), F.size("words") - 1 - F.col("at"))
    candidates = (
        tokens.join(F.broadcast(index), "word")
        .filter(F.size("words") >= F.col("least"))
        .filter(behind >= F.col("least"))
    )
    overlap = F.size(F.array_intersect("words", "template_words"))
    return (
        candidates.withColumn("overlap", overlap)
        .filter("overlap >= least")
        .select(
            "row_id", "block", "label", "template", (F.col("overlap") / F.size("template_words")).alias("contained")
        )
        .distinct()
    )


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """One row per row of docs(doc_id, text).

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. Null counts as
    empty: no words, no places, empty label strings, score 0. score is 1 where a phrase
    stands, else the largest contained share of a matching template, else 0. Repeated rows
    give repeated results; an empty table gives an empty one. Other columns are left out.
    """
    scan = written(scanned(docs, templates, containment), "license-scan")
    blocks = scan.select("row_id", F.posexplode("blocks").alias("block", "words"))
    found = (
        matched_blocks(blocks, templates, containment)
        .groupBy("row_id")
        .agg(F.collect_set("label").alias("found"), F.max("contained").alias("contained"))
    )
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return scan.join(found, "row_id", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_places(phrase: str) -> str:
    tests = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_filter(range(len(words)), lambda i: {tests})"


def _sql_contained(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_intersect(b, [{listed}])) / {len(words)}.0"


def oracle_sql() -> str:
    separators = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = list(PHRASES.items())
    found = [
        f"CASE WHEN len(list_filter(blocks, lambda b: len(list_intersect(b, [{', '.join(repr(w) for w in words)}])) >= {least_overlap(len(words))})) > 0 THEN '{label}' END"
        for label, words in template_sets()
    ]
    shares = [
        f"coalesce(list_max(list_filter(list_transform(blocks, lambda b: {_sql_contained(words)}), lambda s: s >= {least_overlap(len(words))} / {len(words)}.0 - 1e-9)), 0.0)"
        for _, words in template_sets()
    ]
    return f"""
WITH tokens AS (
    SELECT doc_id, regexp_extract_all({lowered}, '{separators}') AS words,
           list_transform(string_split({lowered}, chr(10)), lambda l: list_distinct(regexp_extract_all(l, '{separators}'))) AS blocks
    FROM documents
), placed AS (
    SELECT *, {", ".join(f"{_sql_places(p)} AS places_{k}" for k, (p, _) in enumerate(places))} FROM tokens
), labelled AS (
    SELECT doc_id, len(words) AS n_words,
           flatten([{", ".join(f"places_{k}" for k in range(len(places)))}]) AS every,
           list_filter([{", ".join(f"CASE WHEN len(places_{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(places))}], lambda x: x IS NOT NULL) AS base,
           list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS found,
           greatest({", ".join(shares)}) AS share
    FROM placed
)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0 ELSE share END::DOUBLE AS score
FROM labelled
"""
