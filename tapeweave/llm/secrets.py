"""Secret scan: named patterns, and strings whose characters are too evenly spread for words.

Candidate strings of a character class are its maximal runs of WINDOW characters or more. A
window slides over the candidate with the counts of its characters: one character comes in,
one goes out, and the Shannon entropy follows from the two counts that changed. A window is
high if its entropy reaches the class's bits and it holds both a digit and a letter (numbers
and words do not). What the allow-list knows (identifiers, digests that say so, paths,
placeholders) adds no span. Documents are read in place: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.llm.textcodes import chunks, code_points


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The named patterns and the least lengths of what they match. Valid in Python
# and in the SQL engine; either case is spelled out, as flags differ in what they fold.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = f"({'|'.join(map(_either_case, NAMES))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX_LENGTH = 32
BASE_KINDS = ("assign", "access", "hex")

# Fixed values of the method. No entropy of a window equals these bits: 20 times them is no whole number.
WINDOW = 20
#: Class, its characters, and the entropy of a window from which it counts as drawn by lot.
CLASSES = (
    ("hex_entropy", "0-9A-Fa-f", 2.97),
    ("base64_entropy", "A-Za-z0-9+/=_-", 3.87),
)
KINDS = BASE_KINDS + tuple(name for name, _, _ in CLASSES)
#: Candidates that hold one of these are no secrets.
ALLOWED = (
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^(sha1|sha256|sha384|sha512|md5)[-=_]",
    "^/*([^/]{1,12}/+){2,}[^/]{0,12}$",
    "0123456789|abcdefgh|ABCDEFGH|[Ee]xample|EXAMPLE|[Xx]{6}",
)

_ASSIGN, _ACCESS = re.compile(ASSIGN), re.compile(ACCESS)
#: c * log2(c) for every count that a window can hold.
_WEIGHT = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def high_windows(text: str, bits: float) -> tuple[int, int] | None:
    """(start of the first high window, end of the last), or None.

    Incremental counts: H = log2(W) - sum(c log2 c) / W over the window's characters.
    """
    if len(text) < WINDOW:
        return None
    most = WINDOW * (log2(WINDOW) - bits)
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    first = last = -1
    for k, c in enumerate(text):
        if k >= WINDOW:
            old = text[k - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            total += _WEIGHT[n - 1] - _WEIGHT[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _WEIGHT[n + 1] - _WEIGHT[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if k >= WINDOW - 1 and total <= most and digits and letters:
            if first < 0:
                first = k - WINDOW + 1
            last = k + 1
    return (first, last) if first >= 0 else None


def long_runs(codes: np.ndarray, bounds: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of `inside` code points within one text, `least` or longer."""
    mark = inside[np.minimum(codes, len(inside) - 1)]
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    ends = mark.copy()
    ends[:-1] &= ~mark[1:]
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(codes))]
    begins[cuts] = mark[cuts]
    ends[cuts - 1] = mark[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = stops - starts >= least
    return starts[long], stops[long]


def _members(characters: str) -> np.ndarray:
    kind = re.compile(f"[{characters}]")
    return np.array([bool(kind.match(chr(c))) for c in range(128)] + [False])


_HEX = _members("0-9a-f")
_CLASS_MEMBERS = [(name, _members(characters), bits) for name, characters, bits in CLASSES]
_ORDER = {kind: k for k, kind in enumerate(KINDS)}


class _Covered:
    """Whether a stretch lies in one of a text's spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((start, end) for _, start, end in spans)
        self.starts = [start for start, _ in ordered]
        #: The furthest end of the spans up to each.
        self.reach = list(accumulate((end for _, end in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.reach[k - 1] >= end


class Scanner:
    """Spans of the secrets of many texts at once."""

    def __init__(self, allowed: tuple[str, ...] = ALLOWED):
        self.allowed = [re.compile(a) for a in allowed]

    def entropy_span(self, candidate: str, bits: float) -> tuple[int, int] | None:
        """Where the candidate is a secret: its high windows, and what is left at its ends if shorter than a window."""
        found = high_windows(candidate, bits)
        if not found or any(a.search(candidate) for a in self.allowed):
            return None
        first, last = found
        return (first if first >= WINDOW else 0, last if len(candidate) - last >= WINDOW else len(candidate))

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in code points of each text, by start, then kind. Not null."""
        out: list[list[tuple[str, int, int]]] = []
        for text in texts:
            out.append([("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE])
            out[-1] += [("access", *m.span()) for m in _ACCESS.finditer(text)]
        codes, bounds = code_points(texts)
        if not len(codes):
            return out
        for start, end in zip(*long_runs(codes, bounds, _HEX, HEX_LENGTH), strict=True):
            k = int(np.searchsorted(bounds, start, side="right")) - 1
            out[k].append(("hex", int(start - bounds[k]), int(end - bounds[k])))
        base = [_Covered(spans) for spans in out]
        for name, members, bits in _CLASS_MEMBERS:
            for start, end in zip(*long_runs(codes, bounds, members, WINDOW), strict=True):
                k = int(np.searchsorted(bounds, start, side="right")) - 1
                at = int(start - bounds[k])
                found = self.entropy_span(texts[k][at : int(end - bounds[k])], bits)
                if found and not base[k].holds(at + found[0], at + found[1]):
                    out[k].append((name, at + found[0], at + found[1]))
        for spans in out:
            spans.sort(key=lambda x: (x[1], _ORDER[x[0]], x[2]))
        return out


SPANS = "array<struct<kind: string, start: long, end: long>>"


def spans_of(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """The secrets in a text column as (kind, start, end), code points, end exclusive; null holds none.

    By start, then kind in the order of KINDS. Spans of the entropy kinds that lie in a span
    of a named pattern are left out.
    """

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        scanner, out = Scanner(allowed), []
        for _, part in chunks(texts.tolist()):
            out += [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in scanner.spans(part)]
        return pd.Series(out, dtype=object)

    return found(text)


def secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and its spans (see spans_of).

    Null and empty texts have none; rows with null or repeated doc_id are scanned each. An
    empty table gives an empty result. Other columns are left out.
    """
    return docs.select("doc_id", spans_of(F.col("text").cast("string"), allowed).alias("spans"))


def redacted(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with every secret in text replaced by its kind in brackets; overlapping spans become one.

    All columns and rows stay; null stays null.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        scanner, out = Scanner(allowed), []
        for _, part in chunks(texts.tolist()):
            for text, spans in zip(part, scanner.spans(part), strict=True):
                kept, at = [], 0
                for kind, start, end in spans:
                    if start >= at:
                        kept += [text[at:start], f"[{kind}]"]
                    at = max(at, end)
                out.append("".join(kept) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean(F.col("text").cast("string"))))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same spans in SQL: lazy segments that end in a match give the places, windows are listed one by one."""
    segments = [("assign", f"(?s:.*?)({ASSIGN})"), ("access", f"(?s:.*?)({ACCESS})"), ("hex", f"(?s:.*?)([0-9a-f]{{{HEX_LENGTH},}})")]
    segments += [(name, f"(?s:.*?)([{characters}]{{{WINDOW},}})") for name, characters, _ in CLASSES]
    parts = "\n  UNION ALL ".join(
        f"SELECT row, '{kind}' AS kind, t, regexp_extract_all(t, {_quoted(p)}) AS segments, "
        f"regexp_extract_all(t, {_quoted(p)}, 1) AS found, "
        + (f"regexp_extract_all(t, {_quoted(p)}, 3)" if kind == "assign" else f"regexp_extract_all(t, {_quoted(p)}, 1)")
        + " AS value FROM docs"
        for kind, p in segments
    )
    bits = " ".join(f"WHEN '{name}' THEN {b}" for name, _, b in CLASSES)
    allowed = " OR ".join(f"regexp_matches(m, {_quoted(a)})" for a in ALLOWED)
    order = " ".join(f"WHEN '{kind}' THEN {k}" for k, kind in enumerate(KINDS))
    base = ", ".join(f"'{kind}'" for kind in BASE_KINDS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
split AS ({parts}),
numbered AS (SELECT row, kind, segments, found, value, unnest(range(1, len(segments) + 1)) AS k FROM split),
matches AS (
  SELECT row, kind, found[k] AS m, value[k] AS v,
    CAST(list_sum(list_transform(segments[1:k], lambda s: length(s))) AS BIGINT) AS stop
  FROM numbered),
base AS (
  SELECT row, kind, stop - length(m) AS start, stop FROM matches
  WHERE kind IN ({base}) AND (kind <> 'assign' OR length(v) >= {ASSIGN_VALUE})),
windows AS (
  SELECT row, kind, m, stop, unnest(range(0, length(m) - {WINDOW - 1})) AS w FROM matches WHERE kind NOT IN ({base})),
high AS (
  SELECT row, kind, m, stop, min(w) AS first, max(w) + {WINDOW} AS last FROM windows
  WHERE list_aggregate(string_split(substr(m, w + 1, {WINDOW}), ''), 'entropy') >= CASE kind {bits} END
    AND regexp_matches(substr(m, w + 1, {WINDOW}), '[0-9]') AND regexp_matches(substr(m, w + 1, {WINDOW}), '[A-Za-z]')
  GROUP BY row, kind, m, stop),
entropy AS (
  SELECT row, kind, stop - length(m) + CASE WHEN first >= {WINDOW} THEN first ELSE 0 END AS start,
    stop - length(m) + CASE WHEN length(m) - last >= {WINDOW} THEN last ELSE length(m) END AS stop
  FROM high WHERE NOT ({allowed})),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM entropy e WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.row = e.row AND b.start <= e.start AND e.stop <= b.stop)),
listed AS (
  SELECT row, kind, kind || ':' || start || ':' || stop AS said, start, CASE kind {order} END AS place, stop FROM spans),
joined AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(said, ',' ORDER BY start, place, stop) FILTER (kind IN ({base})), '') AS base,
    string_agg(said, ',' ORDER BY start, place, stop) AS spans
  FROM listed GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row)"""
