"""Main text of web pages by differencing against the page with the nearest URL.

Pages of a host are put in the order of their paths; a page is paired with the one before it
(the first of a host with the one after it), so neighbours share the longest path prefixes.
Their lines are aligned by longest common subsequence, and lines that both have are template
and are deleted, with two exceptions: inside a page's own <article> or <main> a shared line is
a copied article, not a template, and stays; and a line stays that only copies share. Pages of
a host with the same lines count once in the order, and what near copies share is deleted only
where two pages of the host with different other lines share it too. Lines in elements that
name their role (nav, header, footer, aside, form, ...) are deleted as well, as two pages
seldom share them word for word, but no element that holds the landmark goes by its name.

The order is a global sort, numbered by partition offsets: a host with a third of all pages
is spread like any other rows. Only hashes of lines are shuffled; texts are read where they lie.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.session import written

# HTML elements by their part in a page.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog"}
MAIN = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these ends an open one of its kind.
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

# Class, id and role words of parts that are no article.
NAMED = set(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side-bar footer site-header masthead cookie cookies consent notice alert popup modal newsletter subscribe "
    "share social related comment comments comment-list disqus replies widget complementary contentinfo search".split()
)
#: Words that may stand beside a named one in a class ("primary-nav"); with others ("has-sidebar") it names no part.
BESIDE = set(
    "area bar block bottom box button buttons container form global header icon icons link links list main posts primary "
    "secondary section signup site top wrap wrapper".split()
)
#: Parts that hold articles of others: inside a landmark they go although they hold some.
OTHERS = {"comment", "comments", "comment-list", "disqus", "replies", "related"}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)

NEUTRAL, ARTICLE, REMOVED = 0, 1, 2
#: Two pages of which one has less than this share of its own, by lines and by characters, are near copies.
OWN_SHARE = 0.2


@dataclass(slots=True)
class _Open:
    name: str
    part: int


@lru_cache(maxsize=4096)
def named_parts(attributes: str, among: frozenset[str] = frozenset(NAMED)) -> bool:
    """Whether a whole class, id or role is a word of among, or words of it joined with words of BESIDE."""
    for value in _ATTRIBUTE.findall(attributes):
        for token in value.strip("\"'").lower().split():
            words = {w for w in re.split(r"[-_0-9]+", token) if w}
            if token in among or (words & among and words <= among | BESIDE):
                return True
    return False


def landmark_holders(tokens: list[re.Match]) -> dict[int, str]:
    """Numbers of the opening tokens of landmarks and their ancestors: "main" if a <main> is among them, else "article"."""
    holders: dict[int, str] = {}
    stack: list[tuple[str, int, bool]] = []
    for k, token in enumerate(tokens):
        name = token[3]
        if name is None or (name := name.lower()) in INLINE:
            continue
        if token[2]:
            at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == name), None)
            if at is not None:
                del stack[at:]
            continue
        if name in VOID or token[4].endswith("/"):
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] == name:
            stack.pop()
        skipped = name in SKIPPED or bool(stack and stack[-1][2])
        stack.append((name, k, skipped))
        if name in MAIN and not skipped:
            for _, j, _ in reversed(stack):
                if holders.get(j) in {name, "main"}:
                    break  # so have all ancestors
                holders[j] = name
    return holders


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(part, text) of each block of a page in order; white space runs are one space."""
    lines: list[tuple[int, str]] = []
    stack: list[_Open] = []
    text: list[str] = []
    part = NEUTRAL

    def flush() -> None:
        joined = "".join(text)
        text.clear()
        line = " ".join(html.unescape(joined).split()) if joined else ""
        if line:
            lines.append((part, line))

    page = page or ""
    end = 0
    tokens = list(_TOKEN.finditer(page))
    holders = landmark_holders(tokens)
    for k, token in enumerate(tokens):
        if token.start() > end and part != REMOVED:
            text.append(page[end : token.start()])
        end = token.end()
        name = token[3]
        if name is None:
            continue  # comments, scripts, styles, declarations
        name = name.lower()
        if name in INLINE:
            continue
        flush()
        if token[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if at is not None:
                del stack[at:]
                part = stack[-1].part if stack else NEUTRAL
            continue
        if name in VOID or token[4].endswith("/"):
            continue
        if name in SELF_CLOSING and stack and stack[-1].name == name:
            stack.pop()
            part = stack[-1].part if stack else NEUTRAL
        if part != REMOVED:
            gone = (name in BOILERPLATE and not (name == "header" and part == ARTICLE)) or (
                name not in {"html", "body"} and bool(token[4]) and named_parts(token[4])
            )
            if gone and k in holders:  # only replies and other articles inside a landmark
                others = name == "aside" or named_parts(token[4], frozenset(OTHERS))
                gone = part == ARTICLE and holders[k] == "article" and others
            if gone or name in SKIPPED:
                part = REMOVED
            elif name in MAIN:
                part = ARTICLE
        stack.append(_Open(name, part))
    if end < len(page) and part != REMOVED:
        text.append(page[end:])
    flush()
    return lines


def shared_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b (bit vectors over b)."""
    places: dict = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # A zero bit k says that b[k] lengthens the subsequence of what was read so far.
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i -= 1
            j -= 1
            out.append(i)
    return out[::-1]


def line_key(line: str) -> int:
    """48 bits of the line's hash and, in the lowest 16, its length."""
    return (xxhash.xxh3_64_intdigest(line) >> 16 << 16 | min(len(line), 0xFFFF)) - (1 << 63)


def page_key() -> Column:
    """Names a page by all it holds; rows with one key give one result."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("page_id", "url", "html")]
    return F.sha2(F.concat_ws("|", F.hex(F.xxhash64("page_id", "url")), *parts).cast("binary"), 256)


def page_lines(pages: DataFrame) -> DataFrame:
    """page_key, host, path, lines (keys of the lines that differencing may delete) and what landmarks hold.

    article is the hash of the landmarks' lines, n_article and article_chars their sizes; version
    names all that stays of a page before differencing.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["html"]:
                found = lines_of(page)
                lines = [line_key(t) for part, t in found if part == NEUTRAL]
                held = [t for part, t in found if part == ARTICLE]
                article = xxhash.xxh3_64_intdigest("\n".join(held)) - (1 << 63)
                version = xxhash.xxh3_128_hexdigest(f"{article} {lines}")
                rows.append((lines, article, len(held), sum(map(len, held)), version))
            columns = ["lines", "article", "n_article", "article_chars", "version"]
            made = pd.DataFrame(rows, columns=columns, index=batch.index)
            yield pd.concat([batch[["page_key", "host", "path"]], made], axis=1)

    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    narrow = pages.select(page_key().alias("page_key"), host.alias("host"), path.alias("path"), "html")
    found = narrow.mapInPandas(
        hashed,
        "page_key string, host string, path string, lines array<long>, article long, n_article long, article_chars long, version string",
    )
    return written(found.dropDuplicates(["page_key"]), "page-lines")


def path_order(found: DataFrame) -> DataFrame:
    """Of page_lines, one row per host and version, at its first path, with its place.

    place numbers the versions in the order (host, path, version) over all partitions.
    """
    once = found.groupBy("host", "version").agg(
        F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("lines", "article", "n_article", "article_chars")]
    )
    keys = ["host", "path", "version"]
    placed = written(
        once.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("at", F.monotonically_increasing_id()),
        "page-order",
    )
    # The upper bits of `at` are the sorted partition; one row a partition is broadcast.
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
        .drop("part", "at", "before", "path")
    )


def own_share(page: tuple, other: tuple, shared: list[int]) -> float:
    """Share of a page that the other has not, by lines or by characters, whichever is more.

    A page is (keys of its lines, hash, lines and characters of its article).
    """
    lines, article, n_article, article_chars = page
    chars = sum(x & 0xFFFF for x in lines)
    left, left_chars = len(lines) - len(shared), chars - sum(x & 0xFFFF for x in shared)
    if article != other[1]:
        left, left_chars = left + n_article, left_chars + article_chars
    return max(left / max(1, len(lines) + n_article), left_chars / max(1, chars + article_chars))


def deleted_lines(pages: DataFrame) -> DataFrame:
    """page_key and the keys of its lines that are template, in order.

    They are those that the page with the nearest URL has too. If the two are near copies (one
    of them has less than OWN_SHARE of its own), only those of them that two other neighbours
    of the host, not near copies, share.
    """

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                page = (list(row.lines), row.article, row.n_article, row.article_chars)
                found = row.before if row.before is not None else row.after
                other = (list(found["lines"]), found["article"], found["n_article"], found["article_chars"])
                shared = [page[0][k] for k in shared_lines(page[0], other[0])]
                least = min(own_share(page, other, shared), own_share(other, page, shared))
                rows.append((shared, least >= OWN_SHARE))
            yield pd.concat(
                [batch[["host", "version"]], pd.DataFrame(rows, columns=["shared", "differ"], index=batch.index)], axis=1
            )

    found = page_lines(pages)
    ordered = path_order(found)
    sides = F.struct("lines", "article", "n_article", "article_chars")
    before = ordered.select((F.col("place") + 1).alias("place"), F.col("host").alias("before_host"), sides.alias("before"))
    after = ordered.select((F.col("place") - 1).alias("place"), F.col("host").alias("after_host"), sides.alias("after"))
    paired = (
        ordered.filter(F.size("lines") > 0)
        .join(before, "place", "left")
        .join(after, "place", "left")
        .withColumn("before", F.when(F.col("before_host") == F.col("host"), F.col("before")))
        .withColumn("after", F.when(F.col("after_host") == F.col("host"), F.col("after")))
        .filter(F.col("before").isNotNull() | F.col("after").isNotNull())
        .drop("place", "before_host", "after_host")
    )
    schema = "host string, version string, shared array<long>, differ boolean"
    shared = written(paired.mapInPandas(aligned, schema).filter(F.size("shared") > 0), "shared-lines")
    template = shared.filter("differ").select("host", F.explode("shared").alias("line")).distinct()
    copied = shared.filter("NOT differ").select("host", "version", F.posexplode("shared").alias("at", "line"))
    proven = (
        copied.join(template, ["host", "line"], "left_semi")
        .groupBy("host", "version")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).getField("line").alias("deleted"))
    )
    deleted = shared.filter("differ").select("host", "version", F.col("shared").alias("deleted")).unionByName(proven)
    return found.select("page_key", "host", "version").join(deleted, ["host", "version"]).select("page_key", "deleted")


def main_text(page: str | None, deleted: list[int] | None) -> str:
    """All lines of no named part, less the deleted; lines of <article> and <main> are never deleted."""
    left = list(deleted)[::-1] if deleted is not None else []
    out = []
    for part, t in lines_of(page):
        if part == NEUTRAL and left and line_key(t) == left[-1]:
            left.pop()
        else:
            out.append(t)
    return " ".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text. Pages without a host are one host of
    their own; a page alone on its host, or among its copies alone, loses only lines of named
    parts. Repeated rows and copies are one page: they are not paired with each other, and each
    gets the result. An empty table
    gives an empty result. Other columns are left out.
    """

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, deleted: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, d) for h, d in zip(htmls, deleted, strict=True)], dtype=object)

    keyed = pages.select("page_id", "url", "html", page_key().alias("page_key"))
    joined = keyed.join(deleted_lines(pages), "page_key", "left")
    texts = joined.select("page_id", "url", text_of("html", "deleted").alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
