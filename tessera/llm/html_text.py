"""Main text of web pages by removal of site templates.

Each element's subtree is hashed (tag, class, id, text and children).  Spark
counts, per host, on how many different pages a hash occurs; subtrees that recur
across many pages of their host are template and go, inside articles too, but for
their headings, cells and short lines.  Pages of one text are one page there, so
copies of a page do not make its content template.  Elements that say what they
are (nav, footer, script, class="ad", ...) go on any page.  Class words count as
whole names only ("ad", "site-footer", but not "no-sidebar"), and never take the
only article of a page along.  What is left of the article, or of the body where
a page has none, is the text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import releasing, small_batches, written

#: A subtree is template if it is on at least this many different pages of its host ...
MIN_PAGES = 5
#: ... and on at least this share of them, which falls as 3 / sqrt(pages) ...
MIN_SHARE = 0.3
#: ... down to this one; it bounds a host's table to (elements of a page) / 0.03 hashes.
LEAST_SHARE = 0.03
#: Running text inside an article is template only if it has so many words.
TEMPLATE_WORDS = 5

_QUOTED = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({_QUOTED})(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_ENDS_P = _BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_DROPPED = {
    "head", "script", "style", "noscript", "template", "nav", "menu", "header", "footer", "aside", "button", "input", "select", "textarea", "iframe", "svg", "object",
    "canvas", "dialog", "title", "noembed", "noframes", "map", "audio", "video",
}
_HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "alert", "sidebar", "menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "footer", "header", "masthead", "comment", "comments", "reply",
    "replies", "disqus", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "popup", "modal", "widget", "toolbar", "login", "signup",
}
#: Words that may stand beside a hint in a hyphenated name ("site-footer", "ad-slot").
_NEUTRAL = {
    "site", "page", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "sticky", "box", "bar", "list", "item", "link", "links", "block", "slot", "unit", "area",
    "section", "region", "wrapper", "wrap", "container", "inner", "outer", "panel", "form", "buttons",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "toolbar", "form"}
_NEVER = {"h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "b", "i", "em", "strong", "a", "span", "code", "br", "hr", "img"}
_RUNNING = {"p", "li", "blockquote", "pre", "dd"}
_ARTICLE = ("article", "main")
_SPACE = re.compile(r"\s+")


class Node:
    """An element; ``dropped`` by its tag, ``said`` by its class, id, role or as a form; ``holds`` an article."""

    __slots__ = ("tag", "key", "dropped", "said", "inside", "holds", "words", "parts", "hash")

    def __init__(self, tag: str, key: str, dropped: bool, said: bool, inside: bool):
        self.tag, self.key, self.dropped, self.said, self.inside = tag, key, dropped, said, inside
        self.parts: list[Node | str] = []
        self.holds, self.words, self.hash = tag in _ARTICLE, 0, 0


def says(name: str) -> bool:
    """Does a class or id say that its element is no content?  Every part of a hyphenated name has to agree."""
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    return any(p in _HINTS for p in parts) and all(p in _HINTS or p in _NEUTRAL for p in parts)


def _attributes(raw: str) -> tuple[str, bool]:
    """(class and id, does it say that it is no content)."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return "", False
    named = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    key = f"{named.get('class', '')}#{named.get('id', '')}"
    said = any(map(says, [*named.get("class", "").split(), *named.get("id", "").split()]))
    return key, said or named.get("role", "").lower() in _ROLES or "hidden" in named or named.get("aria-hidden") == "true"


def parse(page: str) -> Node:
    """The tree of a page, unclosed and stray tags mended; hashes are set from the leaves up.

    Where an open tag is on the stack is kept by tag, so deep nesting takes no search.
    """
    root = Node("", "", False, False, False)
    stack, open_, blocks = [root], defaultdict(list), [0]

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            n = stack.pop()
            if stack:
                open_[n.tag].pop()
                if n.tag in _BLOCK:
                    blocks.pop()
            text = []
            for p in n.parts:
                if isinstance(p, str):
                    if p.strip():
                        text.append(p)
                        n.words += len(p.split())
                else:
                    text.append(str(p.hash))
                    n.words += p.words
                    n.holds |= p.holds
            n.hash = int.from_bytes(hashlib.blake2b(f"{n.tag}\x01{n.key}\x01{_SPACE.sub(' ', chr(2).join(text))}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)

    def last(tag: str) -> int:
        return open_[tag][-1] if open_[tag] else 0

    def push(node: Node) -> None:
        open_[node.tag].append(len(stack))
        if node.tag in _BLOCK:
            blocks.append(len(stack))
        stack.append(node)

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].parts.append(html.unescape(page[a:b]))

    at = 0
    while m := _TOKEN.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_[tag]:
                close(open_[tag][-1])
            elif tag == "p":
                stack[-1].parts.append(Node("p", "", False, False, False))
            continue
        if tag in _ENDS_P and last("p") and last("p") >= blocks[-1]:
            close(last("p"))
        if tag in _ENDS:
            ends = max(map(last, _ENDS[tag]))
            if ends > max(map(last, _WITHIN[tag])):
                close(ends)
        key, said = _attributes(m[3] or "")
        top = stack[-1]
        said = (said or tag == "form") and tag not in ("html", "body")
        node = Node(tag, key, tag in _DROPPED, said, top.inside or top.tag in _ARTICLE)
        top.parts.append(node)
        if tag in _VOID or (m[3] or "").endswith("/") and tag not in _BLOCK:
            continue
        push(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            node.parts.append(page[at : end.start()])
            at = end.end()
            close(len(stack) - 1)
    text(at, len(page))
    close(0)
    return root


def nodes(root: Node) -> Iterator[Node]:
    left = [root]
    while left:
        n = left.pop()
        for p in n.parts:
            if not isinstance(p, str):
                yield p
                left.append(p)


def removable(n: Node) -> bool:
    """May this subtree be template?  Headings, cells and short lines inside an article are content however often they recur."""
    if n.tag in ("html", "body", "head") or n.holds:
        return False
    return not n.inside or not (n.tag in _NEVER or n.tag in _RUNNING and n.words < TEMPLATE_WORDS)


def subtree_hashes(page: str) -> tuple[set[int], int]:
    """Hashes of the subtrees that may be template, and one of the page's text, dropped elements apart."""
    root = parse(page)
    text = hashlib.blake2b(_text(root, set(), False, _spares(root)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return {n.hash for n in nodes(root) if n.parts and removable(n)}, int.from_bytes(text, "big", signed=True)


def _spares(root: Node) -> bool:
    """Is the page's only article in elements that go by their class?  Then these stay."""
    left, found = [root], False
    while left:
        n = left.pop()
        if n.holds and not n.dropped:
            if n.said:
                found = True
                continue
            if n.tag in _ARTICLE:
                return False
            left += [p for p in n.parts if not isinstance(p, str)]
    return found


def _text(top: Node, template: set[int], article_only: bool, spare: bool) -> str:
    """``spare``: elements that hold an article don't go by their class."""
    blocks, current = [], []

    def flush() -> None:
        block = _SPACE.sub(" ", "".join(current)).strip()
        if block:
            blocks.append(block)
        current.clear()

    left: list[tuple[Node | str | None, bool]] = [(top, False)]
    while left:
        n, counted = left.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            if counted or not article_only:
                current.append(n)
        elif not n.dropped and not (n.said and not (spare and n.holds)) and not (n.hash in template and removable(n)):
            block = n.tag in _BLOCK
            if block:
                flush()
            elif n.tag == "br":
                current.append(" ")
            counted = counted or n.tag in _ARTICLE
            if block:
                left.append((None, counted))
            left += [(p, counted) for p in reversed(n.parts)]
    flush()
    return "\n".join(blocks)


def main_text(page: str | None, template: set[int]) -> str:
    """The page's text without template and dropped elements; with template where nothing else is left; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    spare = _spares(root)
    for known in (template, set()):
        for only in (True, False) if root.holds else (False,):
            found = _text(root, known, only, spare)
            if found:
                return found
    return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host`` and ``template``, the array of hashes of its recurring subtrees.

    A subtree counts once for each different text of its host's pages.  Copies are
    left out on the map side first, and the rest is dealt by host, subtree and
    text, so neither a hot host nor its copies make a large task.
    """

    small_batches(pages.sparkSession)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                rows = set()
                for url, page in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns)):
                    host = host_of(url)
                    if host:
                        found, text = subtree_hashes(page or "")
                        rows |= {(host, h, text) for h in (*found, 0)}  # 0 counts the page
                hosts, hashes, texts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.int64())], ["host", "hash", "text"])

    counts = pages.select("url", "html").mapInArrow(releasing(seen), "host string, hash bigint, text bigint").distinct().groupBy("host", "hash").count().filter(F.col("count") >= min_pages)
    counts = written(counts)
    share = F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(min_share), 3 / F.sqrt("pages")))
    of_host = counts.filter("hash = 0").select("host", F.col("count").alias("pages"))
    return counts.filter("hash != 0").join(of_host, "host").filter(F.col("count") >= share * F.col("pages")).groupBy("host").agg(F.collect_set("hash").alias("template"))


def extract_text(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every row of ``pages``.

    Defined results: a null page has an empty text; a null or unreadable url has
    no host, so only elements that say what they are go; repeated rows are pages
    of their own; other columns are ignored; an empty table gives an empty one.
    """
    templates = written(host_templates(pages) if templates is None else templates)

    @F.arrow_udf("string")
    def host(urls: pa.Array) -> pa.Array:
        return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def extract(htmls: pa.Array, template: pa.Array) -> pa.Array:
        known: dict[tuple[int, ...], set[int]] = {}
        out = []
        for h, t in zip(htmls, template):
            t = tuple(t.as_py() or ())
            out.append(main_text(h.as_py(), known.setdefault(t, set(t))))
        return pa.array(out, pa.string())

    # The table of templates is broadcast only below Spark's own size limit; beyond it the adaptive join splits a hot host.
    x = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    x = x.join(templates.withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h"), "left")
    return x.select("page_id", "url", extract(F.col("html"), F.col("template")).alias("text"))
