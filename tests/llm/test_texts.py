"""Decontamination, page texts and license scans against brute force."""

import html
import random
import re
import textwrap

import numpy as np

from tapeweave.llm import decontam, htmltext, licenses
from tapeweave.llm.textcodes import Words, code_points


def levenshtein_parts(pattern, text, anchored):
    """Row by row: least distance of pattern to a part of text that ends at each place."""
    row = [0 if not anchored else j for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return row[1:]


def test_bit_vector_distances():
    rng = random.Random(1)
    for _ in range(200):
        pattern = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        for anchored in (False, True):
            assert decontam.distances(pattern, text, anchored) == levenshtein_parts(pattern, text, anchored)


def test_embedding_keeps_equal_and_splits_different():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 62, size=40).astype(np.uint64)
    b = np.concatenate([rng.integers(1, 1 << 62, size=9).astype(np.uint64), a, a[:3]])
    same = decontam.embed(b, np.array([9]), np.array([49]), 1, 50)[0]
    assert (decontam.embed(a, np.array([0]), np.array([40]), 1, 50)[0] == same).all()
    assert decontam.same_step_share(32, 0.0) == 1.0
    assert 0.2 < decontam.same_step_share(32, 0.2) < decontam.same_step_share(32, 0.05) < 1


def test_planted_items_are_found(spark, corpus):
    """Recall over edited items, against the exact edit distance; no clean document is named."""
    rng = random.Random(3)
    words = sorted({w for t in corpus.text.head(60) for w in t.lower().split() if w.isalnum()})
    items = [(k, " ".join(rng.choices(words, k=rng.choice([5, 9, 16, 25, 40, 70])))) for k in range(60)]
    docs, planted = [], {}
    for k in range(240):
        filler = rng.choices(words, k=rng.randrange(0, 150))
        if k % 2:
            item, text = items[rng.randrange(60)]
            part = text.split()
            for _ in range(rng.randrange(0, int(0.2 * len(part)) + 1)):
                at, kind = rng.randrange(len(part)), rng.randrange(3)
                if kind == 0:
                    part[at] = rng.choice(words)
                elif kind == 1:
                    part.insert(at, rng.choice(words))
                elif len(part) > 1:
                    del part[at]
            where = rng.randrange(0, len(filler) + 1)
            filler[where:where] = part
            planted[k] = item
        docs.append((k, " ".join(filler)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    texts, item_words = dict(docs), {k: t.split() for k, t in items}
    for r in found:  # every hit is within the distance that it states
        part = texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words]
        assert levenshtein_parts(item_words[r.item_id], part, True)[-1] == r.distance <= 0.2 * r.item_words
    hits = {(r.doc_id, r.item_id) for r in found}
    assert {d for d, _ in hits} <= set(planted)
    caught = [(d, i) in hits for d, i in planted.items()]
    assert sum(caught) / len(caught) >= 0.9
    exact = [(d, i) in hits for d, i in planted.items() if " ".join(item_words[i]) in texts[d]]
    assert len(exact) > 20 and all(exact)


def test_recall_with_edits_on_the_rarest_words():
    """The hard case: as many edits as allowed, all on words that the index starts windows from."""
    rng = random.Random(1)
    for vocabulary in (60, 4000):
        words = [f"w{k}" for k in range(vocabulary)]
        for n in (6, 10, 15, 25, 40, 64, 96, 160, 400):
            items = [(k, " ".join(rng.choices(words, k=n))) for k in range(20)]
            index, texts = decontam.ItemIndex(items), []
            places = {k: [at for item, at, *_ in index._seeds() if item == k] for k, _ in items}
            for k, text in items * 3:
                part = text.split()
                for at in rng.sample(places[k], int(0.2 * n)):
                    part[at] = f"new{rng.randrange(10**9)}"
                texts.append((k, " ".join(rng.choices(words, k=30) + part + rng.choices(words, k=30))))
            found = index.hits([text for _, text in texts])
            caught = [any(h[0] == k for h in hits) for (k, _), hits in zip(texts, found, strict=True)]
            assert sum(caught) >= 0.93 * len(caught), (vocabulary, n, sum(caught))


def test_one_word_items_and_repeated_words():
    index = decontam.ItemIndex([(1, "unique"), (2, "word " * 20), (3, "a b")])
    found = index.hits(["a unique a b", "word " * 5000, "word " * 15, "word " * 17, ""])
    assert [sorted(h[0] for h in hits) for hits in found] == [[1, 3], [2], [], [2], []]
    assert found[1][0][3:] == (0, 20)


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 60)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(5)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.distance) for r in found) == [(k, k, 1, 12, 0) for k in range(5)]


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randrange(5) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 25))]
        places = htmltext.shared_lines(a, b)
        assert len(places) == longest_common(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(a[k] in rest for k in places)


def test_template_lines_go_by_differencing(spark):
    """Pages without landmarks: what the page with the nearest URL has too is deleted."""

    def page(body):
        return f"<html><body><div>Site name</div><div>Home Products Contact</div>{body}<div>All pages made here</div></body></html>"

    pages = [
        (1, "http://h.example/a/1", page("<p>first <b>own</b> text</p><p>second &amp; last</p>"), ""),
        (2, "http://h.example/a/2?x=1", page("<p>other text</p>"), ""),
        (3, "http://h.example/z", page("<p>third text</p>"), ""),
        (4, "http://alone.example/", page("<p>fourth text</p>"), ""),
        (5, "http://h.example/a/3", "<article><p>kept</p></article><p>Site name</p>", ""),
        (6, "http://h.example/a/4", "<article><p>kept</p></article><p>Site name</p>", ""),
    ]
    out = htmltext.extracted(spark.createDataFrame(pages, "page_id long, url string, html string, path string").repartition(3))
    found = {r.page_id: r.text for r in out.collect()}
    assert found[1] == "first own text second & last" and found[2] == "other text"
    assert found[4] == "Site name Home Products Contact fourth text All pages made here"
    assert found[5] == found[6] == "kept"


def test_differencing_decides_outside_landmarks(spark):
    """A teaser in <article> does not stand for the page: other lines go only if a neighbour has them."""

    def page(own, teaser):
        return f"<body><div>Site name</div><article><p>{teaser}</p></article><div>{own}</div><div>More of it</div><div>End of site</div></body>"

    pages = [(1, "http://t.example/a", page("Body of the first", "One teaser")), (2, "http://t.example/b", page("Body of the second", "Two teaser"))]
    out = htmltext.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = {r.page_id: r.text for r in out.collect()}
    assert found == {1: "One teaser Body of the first", 2: "Two teaser Body of the second"}


def test_names_do_not_remove_what_holds_the_article():
    for page in (
        '<main class="content has-sidebar"><p>body</p></main>',
        '<article class="post no-comments"><p>body</p></article>',
        '<div id="page" class="site with-sidebar"><main><p>body</p></main></div>',
        '<div class="widget"><article><p>body</p></article></div>',
        '<form id="all"><div class="menu">m</div><main><p>body</p></main></form>',
        '<main class="menu"><p>body</p><div id="comments"><article>reply</article></div></main>',
        '<div class="no-sidebar"><p>body</p></div><div class="primary-nav">menu</div>',
    ):
        assert htmltext.main_text(page, None) == "body", page


def test_copies_keep_their_text(spark):
    """Copies and near copies at neighbouring URLs lose the template that other pages share, not the article."""

    def page(*own):
        return f"<div>Site name</div>{''.join(f'<p>{x}</p>' for x in own)}<div>End of site</div>"

    body = [f"line {k} of a long article" for k in range(12)]
    near = body[:4] + ["an edited line"] + body[5:]
    pages = [
        (1, "http://h.example/a/1", page(*body)),
        (2, "http://h.example/a/2", page(*body)),
        (3, "http://h.example/a/3", page(*near)),
        (4, "http://h.example/a/4", page(*near[:-1], "an edited end")),
        (5, "http://h.example/b", page("something else", "of its own")),
        (6, "http://copies.example/1", page(*body)),
        (7, "http://copies.example/2", page(*body)),
        (8, "http://near.example/1", page(*body)),
        (9, "http://near.example/2", page(*near)),
    ]
    out = htmltext.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    found = {r.page_id: r.text for r in out.collect()}
    assert found[1] == found[2] == " ".join(body)
    assert found[3] == " ".join(near) and found[4] == " ".join(near[:-1]) + " an edited end"
    assert found[5] == "something else of its own"
    assert found[6] == found[7] == found[8] == f"Site name {' '.join(body)} End of site"
    assert found[9] == f"Site name {' '.join(near)} End of site"


def test_named_parts_are_left_out():
    page = """<header>Top</header><nav>Menu</nav><div class="cookie-notice">Cookies</div><main><h1>Title</h1>
    <p>One<br>two <i>three</i>four</p><aside>Side</aside><form>Form</form><div id=comments><p>Reader says</p></div>
    <ul><li>a<li>b</ul><script>if (a<b) x("</p>")</script><style>p{}</style><!-- <p>no</p> --></main><footer>End</footer>"""
    assert htmltext.main_text(page, None) == "Title One two threefour a b"


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    found = {r.page_id: r for r in htmltext.op4_html_extraction(spark, sf).collect()}
    assert len(found) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "")).split())
        assert (found[p.page_id].text, found[p.page_id].n_chars) == (expected, len(expected))


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    found, share = set(), 0.0
    for line in (text or "").split("\n"):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))
        for label, template in licenses.TEMPLATES:
            wanted = set(template.split())
            contained = len(own & wanted) / len(wanted)
            if contained >= licenses.CONTAINMENT:
                found.add(label)
                share = max(share, contained)
    score = 1.0 if places else share
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | found)), round(score, 9)


def test_license_scan_matches_brute_force(spark, corpus):
    rng = random.Random(6)
    docs = list(zip(corpus.doc_id.tolist(), corpus.text.tolist(), strict=True))
    for k in range(120):
        label, template = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = template.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["und", "Work", "é", "7"])
        if rng.random() < 0.3:
            rng.shuffle(words)
        text = rng.choice([" ", ", ", "/"]).join(words)
        docs.append((10_000 + k, rng.choice(["", "MIT\nLicense cc by ", "the\n"]) + text.title() + rng.choice(["", "\nCC-BY"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in licenses.license_scan(frame).collect()}
    for doc_id, text in docs:
        r = rows[doc_id]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        assert got == brute_licenses(text), text[:200]
    assert sum(r.labels != "" for r in rows.values()) > 60


def test_wrapped_notices_are_found(spark):
    """Every template is met when it is wrapped, as plain lines and as a comment; a blank line ends a notice."""
    docs, wanted = [], {}
    for k, (label, template) in enumerate(licenses.TEMPLATES):
        for j, (width, sign, ending) in enumerate([(30, "", "\n"), (45, " * ", "\n"), (70, "# ", "\r\n"), (30, "", "\n\n")]):
            lines = [sign + line for line in textwrap.wrap("Copyright by someone. " + template.title() + " or so", width)]
            docs.append((10 * k + j, ending.join(["/*", *lines, "*/"])))
            if j < 3:
                wanted[10 * k + j] = label
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.license_scan(frame).collect()}
    for doc_id, label in wanted.items():
        assert label in rows[doc_id].labels.split(",") and rows[doc_id].score >= 0.85, docs
    long = [k for k, (_, template) in enumerate(licenses.TEMPLATES) if len(template.split()) > 15]
    assert all(rows[10 * k + 3].labels == "" for k in long if "gnu" not in licenses.TEMPLATES[k][1])


def test_hashed_words_are_words():
    texts = ["Ab  cd\tab", "", "x", "ab cd", "é ab"]
    words = Words(*code_points(texts), "unspaced")
    split = [w for t in texts for w in t.split()]
    assert len(words.hashes) == len(split) and np.diff(words.first).tolist() == [len(t.split()) for t in texts]
    by_word = {}
    for w, h in zip(split, words.hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    pairs, text = words.runs(2)
    assert text.tolist() == [0, 0, 3, 4] and pairs[2] != pairs[0] != pairs[1]
