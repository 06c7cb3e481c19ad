"""The secret scan against plain versions of its rules."""

import hashlib
import random
import re
from collections import Counter
from math import log2

from tapeweave.llm import secrets

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def entropy(window):
    return -sum(n / len(window) * log2(n / len(window)) for n in Counter(window).values())


def plain_spans(text):
    """Every rule anew for each window, case-insensitive flags instead of spelled-out letters."""
    w, out = secrets.WINDOW, []
    named = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", *m.span()) for m in re.finditer(named, text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = list(out)
    for name, characters, bits in secrets.CLASSES:
        for m in re.finditer(f"[{characters}]+", text):
            run = m[0]
            high = [
                k
                for k in range(len(run) - w + 1)
                if entropy(run[k : k + w]) >= bits and re.search("[0-9]", run[k : k + w]) and re.search("[A-Za-z]", run[k : k + w])
            ]
            if not high or any(re.search(a, run) for a in secrets.ALLOWED):
                continue
            first, last = high[0], high[-1] + w
            start = m.start() + (first if first >= w else 0)
            end = m.start() + (last if len(run) - last >= w else len(run))
            if not any(s <= start and end <= e for _, s, e in base):
                out.append((name, start, end))
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


def made_texts(n=300):
    rng = random.Random(5)
    parts = [
        lambda: "token = '" + "".join(rng.choices(BASE64, k=rng.randint(5, 40))) + "' ",
        lambda: "API_KEY:" + "".join(rng.choices("0123456789abcdef", k=rng.randint(4, 12))),
        lambda: "Passwd\"= token=" + "".join(rng.choices(BASE64, k=9)) + " ",
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOP0123456789", k=rng.randint(8, 20))) + " ",
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 80))) + " ",
        lambda: "".join(rng.choices(BASE64, k=rng.randint(10, 90))) + "\n",
        lambda: "the river carried é boats past ",
        lambda: "/usr/share/doc/lib2/readme ",
        lambda: "sha256-" + "".join(rng.choices(BASE64, k=43)) + "= ",
        lambda: "ſecret=abcdefghij Key: x ",
        lambda: "a1" * rng.randint(5, 30) + "".join(rng.choices(BASE64, k=30)) + "b2" * rng.randint(5, 30) + " ",
    ]
    return ["".join(rng.choice(parts)() for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_spans_equal_the_plain_version():
    texts = [*made_texts(), "", "x" * 50_000, "f3" * 2_000 + "".join(random.Random(1).choices(BASE64, k=500))]
    found = secrets.Scanner().spans(texts)
    assert found == [plain_spans(t) for t in texts]
    assert {kind for spans in found for kind, _, _ in spans} == set(secrets.KINDS)


def test_high_windows_keep_exact_counts_over_long_strings():
    rng = random.Random(2)
    text = "".join(rng.choices(BASE64, k=200_000)) + "z" * 100
    first, last = secrets.high_windows(text, 3.87)
    assert first < 100 and entropy(text[last - 20 : last]) >= 3.87
    assert all(entropy(text[k : k + 20]) < 3.87 for k in range(last - 19, len(text) - 19))
    assert secrets.high_windows("z1" * 500, 3.87) is None and secrets.high_windows("short", 1.0) is None


def test_words_numbers_and_allowed_strings_are_no_secrets():
    clean = [
        "Donaudampfschifffahrtsgesellschaftskapitaen and antidisestablishmentarianism",
        "4111 1111 1111 1111 12345678901234567890123456789",
        "123e4567-e89b-12d3-a456-426614174000",
        "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
        "key=abcdefghijklmnopqrstuvwxyz0123456789",
        "getElementsByTagNameAndClassName",
    ]
    assert secrets.Scanner().spans(clean) == [[]] * len(clean)
    assert secrets.Scanner(allowed=()).spans(clean[3:4])[0]


def test_rows_and_redaction(spark, odd_documents):
    key = "q7Zk2Lw9XbT4vR8mN1cY6pD3sF5hJ0aE"
    rows = [(1, f"see {key} here"), (1, "password: hunter2hunter2"), (None, None), (2, ""), (3, "é" * 30 + " " + "0f" * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS start")
    found = {(r.doc_id, len(r.spans)) for r in secrets.secrets(docs).collect()}
    assert found == {(1, 1), (None, 0), (2, 0), (3, 1)}
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(
        ["see [base64_entropy] here", "[assign]", "", "", "é" * 30 + " [hex]"]
    )
    assert secrets.secrets(odd_documents).count() == 13
    assert secrets.secrets(docs.limit(0)).collect() == []


def test_query_counts_and_digest(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op13_secret_scan(spark, sf).collect():
        spans = plain_spans(docs[r.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))
