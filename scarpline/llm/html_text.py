"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

Pages are cut into blocks of text, one line each; pages of a host are ordered by URL path, and each is paired with the
page before it (the first one with the page behind it). The lines of a pair are aligned by a longest common subsequence.
A line that the pair shares is the host's template and is deleted, with these exceptions, which plain differencing gets wrong:

* text within an ``article`` or ``main`` element is the page's own even if the neighbour repeats it, as copies of one
  article do; it stays unless it is in a part that never is main text (below);
* a pair of which one has no line that the other lacks are copies, and say nothing about the template;
* menus, headers outside the article, footers, sidebars, forms, adverts, notices and comments differ from page to page on
  some hosts; elements of these kinds, known by tag, role, a whole class or a whole id, are deleted whether shared or not,
  unless they hold an article or main element (asides, navigation, comments and parts of an article go even then); headings within an article are never told by class or id. If a page's
  articles have at least as much text as the lines outside them that differencing keeps, those lines are deleted too.

Character references are decoded, white space within a block becomes one space, blocks are joined by a line feed.

Null and empty pages have empty texts. A null url, or one without a host, is a host of its own. Pages with equal URLs are
ordered by id and content; repeated rows each give a row. Texts and hosts may have any size: pages are dealt by ranges of
(host, path), so a large host is spread over many tasks, and a page at a range's end is also sent to the next range,
where it serves as the neighbour. Columns that clash with added ones are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Elements of HTML by what they mean here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "xmp", "noembed", "noframes"}
APART = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head"}
OWN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Classes that name parts apart from the main text.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "widget", "widgets", "toolbar", "pagination", "pager", "search", "skip"} | {
    "ad-banner", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "adsbygoogle", "comment-body", "comment-form", "comment-list", "comment-respond", "comments-area", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice",
    "main-menu", "main-nav", "main-navigation", "nav-links", "nav-menu", "newsletter-form", "newsletter-signup", "post-navigation", "related-articles", "related-posts", "search-form", "share-buttons", "site-footer", "site-header", "site-nav",
    "site-navigation", "skip-link", "social-icons", "social-links", "social-share",
}
#: Ids that do so, and those of them that do it within an article too, where ids are mostly made from headings.
IDS_WITHIN = {"comments", "disqus_thread", "respond"}
IDS = IDS_WITHIN | {"ads", "breadcrumbs", "cookie-banner", "cookie-consent", "cookie-notice", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "sidebar", "site-footer", "site-header"}
#: Classes of an article element that is a reader's comment.
COMMENT = {"comment", "comment-body"}
#: Names of readers' comments, which never hold the article; so do these elements.
COMMENTS = {n for n in NAMES if "comment" in n} | {"disqus", "reply", "replies", "respond"} | IDS_WITHIN
FIRM = {"aside", "nav"}
#: Elements that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _apart(tag: str, attributes: str, inside_own: bool) -> int:
    """0 for an element that may hold main text, 1 for one that never does unless it holds an article or main element, 2 for one that never does."""
    firm = 2 if tag in FIRM or inside_own else 1  # what lies within an article is no frame around another one
    if tag in APART or tag == "header" and not inside_own:
        return firm
    if not attributes or tag in ("html", "body"):
        return 0
    for m in _ATTRIBUTE.finditer(attributes):  # names within values are part of the values
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return firm
        if tag in HEADINGS and inside_own:
            continue
        if key == "class" and (found := (COMMENT if tag in OWN else NAMES).intersection(value.split())):
            return firm if found.isdisjoint(COMMENTS) else 2
        if key == "id" and tag not in OWN and value.strip() in (IDS_WITHIN if inside_own else IDS):
            return 2 if value.strip() in COMMENTS else firm
    return 0


def lines(html: str) -> tuple[list[str], list[int]]:
    """A page's text blocks, and for each: 0 apart from the main text, 1 undecided, 2 in an article or main element."""
    found: list[str] = []
    within: list[tuple[int, bool]] = []  # of each block: the innermost open element apart from the main text (-1: none), and whether in an article or main
    parts: list[str] = []
    stack: list[tuple[str, tuple[int, bool]]] = []  # open elements that matter, and the same of the text in them
    around: dict[int, int] = {}  # the element apart around each such element
    kept = {-1}  # elements that would be apart but hold an article or main, so that those around them do too
    firm: set[int] = set()  # elements apart whatever they hold
    none = (-1, False)
    now, at, end = none, 0, len(html)

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(text)
                within.append(now)
            parts.clear()

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts off
            parts.append(rest[: cut.start()] if cut else rest)
            break
        parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and not any(t == tag for t, _ in stack):
                continue
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    now = stack[-1][1] if stack else none
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        apart = _apart(tag, m[3], now[1])
        if tag not in INLINE or apart:
            close()
        if tag in VOID or m[3].endswith("/") and tag not in INLINE:
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
            now = stack[-1][1] if stack else none
        if tag not in INLINE or apart:
            outer = now[0]
            if apart:
                around[at] = outer
                if apart == 2:
                    firm.add(at)
            frames = []
            while outer not in kept:
                frames.append(outer)
                outer = around[outer]
            if tag in OWN and not apart and firm.isdisjoint(frames):
                kept.update(frames)
            now = at if apart else now[0], now[1] or tag in OWN and not apart
            stack.append((tag, now))
    close()
    return found, [0 if apart not in kept else 2 if own else 1 for apart, own in within]


def _ends(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b, by bit-parallel steps over a."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((full & ~v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits)))


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, in memory that grows with their lengths alone."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            out.append(k - 1)
            k, m = k - 1, m - 1
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        half = (i + k) // 2
        best = _ends(a[i:half], b[j:m]) + _ends(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(np.argmax(best))
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def difference(page: tuple[list[str], list[int]], neighbour: list[str] | None) -> tuple[str, int, int]:
    """The page's main text, given its lines and those of its neighbour; how many lines went as shared, and how many others."""
    text, kinds = page
    template: set[int] = set()
    if neighbour:
        number: dict[str, int] = {}
        a, b = ([number.setdefault(x, len(number)) for x in y] for y in (text, neighbour))
        common = shared(a, b)
        if len(common) < min(len(a), len(b)):
            template = {i for i in common if kinds[i] != 2}
    own = sum(len(x) for x, k in zip(text, kinds, strict=True) if k == 2)
    rest = {i for i, k in enumerate(kinds) if k == 1 and i not in template}
    if own and own >= sum(len(text[i]) for i in rest):
        rest = set()
    kept = [x for i, (x, k) in enumerate(zip(text, kinds, strict=True)) if k == 2 or i in rest]
    return "\n".join(kept), len(template), len(text) - len(kept) - len(template)


@F.pandas_udf(StructType([StructField("text", ArrayType(StringType())), StructField("kind", ArrayType(IntegerType()))]))
def _lines(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        yield pd.DataFrame([lines(h or "") for h in batch], columns=["text", "kind"])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", range_pages: int = 500) -> DataFrame:
    """page_id, url, text (the main text), n_shared (lines deleted as the neighbour has them) and n_apart (those deleted by what
    element they are in alone). range_pages: about how many pages of neighbouring URLs one range holds, as long
    as there are no more than four ranges for each shuffle partition of the session.

    Bounds of the ranges come from a sample; the result does not depend on them. They, and the first and last page of
    each range, are all that the driver sees.
    """
    spark = pages.sparkSession
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    # One string orders pages by host, path, id and content; the id has a fixed width and null comes last.
    name = F.concat_ws("\x01", host, path, F.coalesce(F.lpad(F.col(page_id).cast("decimal(20,0)").cast("string"), 21, "0"), F.lit("~")), F.lpad(F.hex(F.xxhash64(html, url)), 16, "0"))
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"), name.alias("name"))
    total = named.count()
    parts = max(1, min(-(-total // range_pages), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds: list[str] = []
    if parts > 1:
        some = sorted(r["name"] for r in named.select("name").sample(min(1.0, 40 * parts / total), seed=1).collect())
        bounds = sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []
    shared_bounds = spark.sparkContext.broadcast(bounds)  # one key for each range

    @F.pandas_udf(IntegerType())
    def range_of(names: pd.Series) -> pd.Series:
        return names.map(lambda n: bisect.bisect_right(shared_bounds.value, n)).astype("int32")

    ranged = named.withColumn("range", range_of("name"))
    # The last page of each range is sent to the next range that has pages, the first one to the range before.
    edges = sorted((r["range"], r["first"], r["last"]) for r in ranged.groupBy("range").agg(F.min("name").alias("first"), F.max("name").alias("last")).collect())
    sent = [(e[2], f[0]) for e, f in zip(edges, edges[1:], strict=False)] + [(f[1], e[0]) for e, f in zip(edges, edges[1:], strict=False)]
    also = spark.createDataFrame(sent, "name string, also int").groupBy("name").agg(F.collect_set("also").alias("also"))
    rows = ranged.join(F.broadcast(also), "name", "left")
    lined = rows.withColumn("l", _lines("html")).select("page_id", "url", "host", "name", F.col("l.text").alias("text"), F.col("l.kind").alias("kind"), "range", "also")
    none = F.array().cast("array<int>")
    dealt = lined.withColumn("to", F.explode(F.concat(F.array("range"), F.coalesce("also", none)))).withColumn("own", F.col("to") == F.col("range")).drop("also", "range")
    ordered = dealt.repartition(max(parts, 1), "to").sortWithinPartitions("to", "name", F.desc("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = now = None

        def done(row, behind):
            mate = next((x for x in (before, behind) if x is not None and (x.to, x.host) == (row.to, row.host)), None)
            return row.page_id, row.url, *difference((list(row.text), list(row.kind)), None if mate is None else list(mate.text))

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if now is not None:
                    if now.own:
                        out.append(done(now, row))
                    before = now
                now = row
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_shared", "n_apart"])
        if now is not None and now.own:
            yield pd.DataFrame([done(now, None)], columns=["page_id", "url", "text", "n_shared", "n_apart"])

    kept = ordered.select(F.col("page_id").cast("string"), "url", "host", "text", "kind", "to", "own")
    kind = dict(pages.dtypes)[page_id]
    return kept.mapInPandas(run, "page_id string, url string, text string, n_shared long, n_apart long").withColumn("page_id", F.col("page_id").cast(kind))
