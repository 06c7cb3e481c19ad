"""Spelling variants against plain searches through the whole vocabulary."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeweave.llm import fmindex, spelling


def plain_near(words):
    """Ordered pairs of words one edit apart, by what is left without one code point."""
    known, without, out = set(words), defaultdict(set), set()
    for w in words:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :], i].add(w)
    for (rest, _), ws in without.items():
        out |= {(a, b) for a in ws for b in ws if a != b}
        if rest in known:
            out |= {p for w in ws for p in ((w, rest), (rest, w))}
    return out


def plain_variants(rows, least_length=5, least_count=3):
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + "\0":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    words = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    near = defaultdict(set)
    for a, b in plain_near(words):
        near[a].add(b)
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * k:
            form[w] = best
    out = set()
    for w, k in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, k, len(near[w]), words[form[w]] if w in form else None))
    return out


def found_by(index, words):
    out = []
    for keep in ("head", "tail"):
        for query, word in index.near(words, keep):
            out += [(words[q], index.words[w]) for q, w in zip(query, word, strict=True)]
    return out


@pytest.mark.parametrize(("letters", "n", "least", "most"), [("ab", 200, 2, 7), ("abcé", 2000, 2, 9), ("aÿ", 60, 5, 40), ("a", 30, 2, 60)])
def test_index_finds_each_pair_once(letters, n, least, most):
    rng = random.Random(n)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(n)})
    found = found_by(fmindex.BidirectionalIndex(words), words)
    assert len(found) == len(set(found)) and set(found) == plain_near(words)


def test_queries_outside_the_index_and_flushing(monkeypatch):
    monkeypatch.setattr(fmindex, "MOST_STATES", 50)
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(2, 8))) for _ in range(500)})
    index, asked = fmindex.BidirectionalIndex(words[::2]), [*words[1::2], "zz", "azb", "ézbca"]
    expected = {(a, b) for a, b in plain_near([*words, "zz", "azb", "ézbca"]) if a in set(asked) and b in set(words[::2])}
    assert set(found_by(index, asked)) == expected
    assert found_by(fmindex.BidirectionalIndex([]), ["word"]) == []


def test_suffix_array():
    rng = np.random.default_rng(0)
    for symbols in (2, 4, 60):
        text = np.append(rng.integers(1, symbols, size=700), 0)
        text[100:400] = 1
        plain = sorted(range(len(text)), key=lambda k: text[k:].tolist())
        assert fmindex.suffix_array(text, symbols).tolist() == plain


def test_blocks_with():
    keys = sorted("".join(random.Random(k).choices("ab", k=6)) for k in range(200))
    cuts = [0, 30, 31, 90, 150]
    marks = [keys[c] for c in cuts]
    for head in ["a", "ab", "bbb", "abab", "\0", "zz"]:
        holding = {max(j for j, c in enumerate(cuts) if c <= k) for k, key in enumerate(keys) if key.startswith(head)}
        assert holding <= set(spelling.blocks_with(head, marks))


def made_rows():
    rng = random.Random(9)
    stems = ["".join(rng.choices("abdéort", k=rng.randint(4, 9))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(stems) + rng.choice(["", "s", "e", "É", "S"]) for _ in range(120))) for k in range(40)]
    long = "Xy" * 3000
    rows += [(None, "Color colour COLOR colorx " * 3), (None, None), (7, ""), (8, "¿?12"), (8, f"{long} {long}x {long} {long}x {long}x {long[:-1]} {long}y {long}x")]
    rows.append((9, "stonewal " * 3 + "Stonewall " * 7 + "stonewalls " * 15))  # a chain of forms
    return rows + rows[:5]


@pytest.mark.parametrize(("symbols", "slices"), [(1 << 19, 4), (300, 1)])
def test_variants_equal_the_plain_version(spark, monkeypatch, symbols, slices):
    monkeypatch.setattr(spelling, "BLOCK_SYMBOLS", symbols)
    monkeypatch.setattr(spelling, "SLICE_BLOCKS", slices)
    rows = made_rows()
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, word string, n int, block int")
    found = spelling.variants(docs.repartition(5))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = [tuple(r) for r in found.collect()]
    assert len(out) == len(set(out)) and set(out) == plain_variants(rows)
    assert any(root not in (form, word) and form for word, form, root, *_ in out)


def test_counting_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_SYMBOLS", 100)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.word, r.n) for r in spelling.vocabulary(docs).collect()} == {(w, n) for w, _, _, n, _, _ in plain_variants(rows)}


def test_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("w37", None), ("x", "w5"), ("lone", None)]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {f"w{k}": "w37" for k in range(37)} | {"x": "w37"}


def test_no_words(spark, no_documents):
    assert spelling.variants(no_documents).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).collect() == []
