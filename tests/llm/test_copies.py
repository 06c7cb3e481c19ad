"""Exact dedup, Jaccard join and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeweave.llm import exact_dedup, jaccard
from tapeweave.llm.components import components


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_dedup_matches_brute_force(spark, corpus, weak):
    """Also with a digest of one hex digit, where many texts share a digest."""
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 1)) if weak else exact_dedup.sha256
    docs = spark.createDataFrame(corpus[["doc_id", "text"]]).repartition(5)
    groups = defaultdict(list)
    for doc_id, text in zip(corpus.doc_id, corpus.text, strict=True):
        groups[normal(text)].append((-len(text), doc_id))
    keep = {doc_id: min(group)[1] for group in groups.values() for _, doc_id in group}
    rows = exact_dedup.deduplicated(docs, salts=3, digest=digest).collect()
    assert len(rows) == len(corpus)
    texts = dict(zip(corpus.doc_id, corpus.text, strict=True))
    for r in rows:
        assert (r.keep_id, r.kept) == (keep[r.doc_id], keep[r.doc_id] == r.doc_id)
        assert r.group_size == len(groups[normal(texts[r.doc_id])])
        assert r.text_sha256 == hashlib.sha256(normal(texts[r.doc_id]).encode()).hexdigest()


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + k, 301 + k) for k in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def made_documents():
    """Families of near copies, of short and long texts, and texts that share a common line."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(3000)]
    common = " ".join(rng.choices(words, k=12))
    docs = []
    for family in range(60):
        size = rng.choice([1, 2, 3, 5, 8, 10, 14, 16, 20, 40, 120])
        base = rng.choices(words, k=size)
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + size // 40)):
                kind, k = rng.randrange(3), rng.randrange(len(copy))
                if kind == 0:
                    copy[k] = rng.choice(words)
                elif kind == 1:
                    copy.append(rng.choice(words))
                elif len(copy) > 1:
                    del copy[k]
            text = " ".join(copy)
            if family % 4 == 0:
                text += "\n" + common
            docs.append((len(docs) * 7 + 3, text.upper() if rng.random() < 0.1 else text))
    return docs + [(90_001, "Ä b"), (90_002, "ä b"), (90_003, ""), (90_004, None)]


def brute_components(docs):
    sets = {}
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[doc_id] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    found = {d: d for d in sets}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                found[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_jaccard_matches_brute_force(spark):
    docs = made_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(frame).collect()}
    assert got == brute_components(docs)


def test_jaccard_on_the_corpus(spark, corpus):
    docs = list(zip(corpus.doc_id.tolist(), corpus.text.tolist(), strict=True))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(frame).collect()}
    assert got == brute_components(docs)


def test_boundary_and_overlap():
    for a in range(1, 60):
        for b in range(a, 60):
            least = min(o for o in range(0, a + b + 1) if 100 * o >= 85 * (a + b - o))
            assert jaccard.need(a, b) == least
            assert jaccard.fits(a, b) == (least <= a)
    assert 2 <= jaccard.choose_boundary({5: 10, 12: 100, 40: 50}) <= jaccard.MOST_SMALL + 1
    assert jaccard.choose_boundary({}) == 1


def test_the_stage_links_what_op9_does_not(spark):
    """200 words, four of them changed far apart: 176/216 of 5-word shingles, but 181/213 of 4-word ones, less than 0.85."""
    words = [f"w{k}" for k in range(200)]
    copy = [f"x{k}" if k in (40, 80, 120, 160) else w for k, w in enumerate(words)]
    other = [f"x{k}" if k % 30 == 20 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.joined(docs).collect()} == {1: 1, 2: 2, 3: 3}
    assert sorted(r.doc_id for r in jaccard.keep_one_each(spark, docs, "").collect()) == [1, 3]
