"""Web pages from a table (url, html): texts, links, selections and a crawl over them."""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: The character references that are decoded.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def inner_text(page: Column) -> Column:
    """The text of a page as lines, one for each block, in the JVM; comments, head, scripts and styles go."""
    out = F.regexp_replace(page, "(?is)<!--.*?-->", "")
    for tag in ("head", "script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, rf"(?i)</?({_BLOCK})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for k, v in ENTITIES:
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(F.regexp_replace(out, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def code_as_fences(page: Column) -> Column:
    """Code macros of a wiki page as fenced blocks, other markup left; runs of three and more line breaks become two."""
    macro = r'(?is)<ac:structured-macro[^>]*ac:name="code"[^>]*>.*?<ac:plain-text-body><!\[CDATA\[(.*?)\]\]></ac:plain-text-body>.*?</ac:structured-macro>'
    return F.regexp_replace(F.regexp_replace(page, macro, "\n```\n$1\n```\n"), r"\n{3,}", "\n\n")


def page_documents(pages: DataFrame, as_html: bool = False) -> DataFrame:
    """(url, title, chunkSource, pageContent) of each page; pages without content have none."""
    content = F.col("html") if as_html else inner_text(F.col("html"))
    title = F.concat(F.regexp_replace("url", r"^[a-z]+://", ""), F.lit(".html"))
    return pages.select("url", title.alias("title"), F.concat(F.lit("link://"), "url").alias("chunkSource"), content.alias("pageContent")).filter("pageContent != ''")


def resolved(href: Column, base: Column) -> Column:
    """Links as absolute addresses; null for what is none."""

    def absolute(h: str | None, b: str | None) -> str | None:
        if not h or not b:
            return None
        try:
            found = urlsplit(urljoin(b, H.unescape(h.strip())))
            return found._replace(path=found.path or "/").geturl() if found.netloc else found.geturl()
        except ValueError:
            return None

    @F.arrow_udf("string")
    def join(links: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([absolute(h, b) for h, b in zip(links.to_pylist(), bases.to_pylist())], pa.string())

    return join(href, base)


def links_of(pages: DataFrame, base: str | None = None) -> DataFrame:
    """(place, link) of the anchors of each page, absolute, in page order; relative to ``base`` or the page itself.

    The page's other columns, such as its url, come along; several pages may have one url.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    kept = [c for c in pages.columns if c != "html"]
    x = pages.select(*kept, F.posexplode(anchors).alias("place", "_h"))
    x = x.select(*kept, "place", F.regexp_replace("_h", r"""^["']|["']$""", "").alias("_h")).filter("_h != ''")
    return x.select(*kept, "place", resolved(F.col("_h"), F.lit(base) if base else F.col("url")).alias("link")).filter("link IS NOT NULL")


def crawl(pages: DataFrame, start: str, depth: int = 1, most: int = 20) -> DataFrame:
    """(place, url) of the addresses found breadth first from ``start``, itself the first, at most ``most``.

    A link counts if it lies under the start's folder.  Each level joins the
    frontier, at most ``most`` addresses, to the pages; only those addresses
    come to the driver.
    """
    spark = pages.sparkSession
    at = urlsplit(start)
    under = f"{at.scheme}://{at.netloc}" + at.path.rpartition("/")[0]
    found, frontier = [start], [start]
    for _ in range(depth):
        if not frontier or len(found) >= most:
            break
        level = spark.createDataFrame(list(enumerate(frontier)), "_i int, url string")
        one = pages.join(F.broadcast(level), "url").groupBy("url", "_i").agg(F.min("html").alias("html"))
        links = links_of(one.select("url", "html"), start).join(F.broadcast(level), "url").filter(F.col("link").startswith(under) & ~F.col("link").isin(*found))
        new = links.groupBy("link").agg(F.min(F.struct("_i", "place")).alias("_p")).orderBy("_p", "link").limit(most - len(found))
        frontier = [r.link for r in new.select("link").collect()]
        found += frontier
    return spark.createDataFrame(list(enumerate(found)), "place int, url string")


def scraped(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Documents of the addresses of a crawl that have a page."""
    return page_documents(pages.join(F.broadcast(found.select("url").distinct()), "url", "left_semi"))


class _Select(HTMLParser):
    """Texts of the elements that match one compound selector: tag, #id, .class, [attribute=value]; with ``as_html`` what the page has between their tags, as written."""

    def __init__(self, selector: str, page: str, as_html: bool = False):
        super().__init__(convert_charrefs=True)
        self.page, self.as_html, self.start = page, as_html, 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        m = re.match(r"^([A-Za-z][\w-]*)?", selector)
        self.tag, rest = (m[1] or "").lower(), selector[m.end() :]
        self.need = [(k[0], k[1:]) if k[0] in "#." else ("[", k[1:-1]) for k in re.findall(r"[#.][\w-]+|\[[^\]]*\]", rest)]
        self.open, self.out, self.depth = [], [], 0

    def _hit(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and tag != self.tag:
            return False
        for kind, v in self.need:
            if kind == "#" and attrs.get("id") != v or kind == "." and v not in attrs.get("class", "").split():
                return False
            if kind == "[":
                k, eq, want = v.partition("=")
                if k not in attrs or eq and attrs[k] != want.strip("\"'"):
                    return False
        return True

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, at: int) -> None:
        self.out.append(self.page[self.start : at] if self.as_html else "".join(self.open[1]).strip())
        self.open = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open:
            self.depth += tag == self.open[0]
        elif self._hit(tag, {k: v or "" for k, v in attrs}):
            self.open, self.depth, self.start = [tag, []], 1, self._at() + len(self.get_starttag_text())

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag == self.open[0]:
            self.depth -= 1
            if not self.depth:
                self._end(self._at())

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[1].append(data)

    def close(self) -> None:
        super().close()
        if self.open:
            self._end(len(self.page))


def selected(page: Column, selector: str, as_html: bool = False) -> Column:
    """The texts of a page's elements that match a compound selector, in page order, elements inside one another once; null for no page.

    Texts have their references decoded and are trimmed.  With ``as_html`` the
    elements' contents are returned as written, with tags and references.
    """

    @F.arrow_udf("array<string>")
    def pick(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            out = []
            for p in pages.to_pylist():
                if p is None:
                    out.append(None)
                    continue
                s = _Select(selector, p, as_html)
                s.feed(p)
                s.close()
                out.append(s.out)
            yield pa.array(out, pa.list_(pa.string()))

    return pick(page)


#: How a result page marks its results and their parts.
RESULT_MARK = '<div class="result results_links'
RESULT_TITLE = r'(?s)<a[^>]*class="result__a"[^>]*>(.*?)</a>'
RESULT_LINK = r'<a[^>]*class="result__a"[^>]*href="([^"]*)">'
RESULT_SNIPPET = r'(?s)<a[^>]*class="result__snippet"[^>]*>(.*?)</a>'


def search_results(page: Column) -> Column:
    """(title, link, snippet) of a result page: parts behind a marker, complete ones only."""
    parts = F.slice(F.split(page, RESULT_MARK), 2, 1 << 20)
    get = lambda p, pattern: F.trim(F.regexp_replace(F.regexp_extract(p, pattern, 1), "</?b>", ""))
    rows = F.transform(parts, lambda p: F.struct(get(p, RESULT_TITLE).alias("title"), get(p, RESULT_LINK).alias("link"), get(p, RESULT_SNIPPET).alias("snippet")))
    return F.filter(rows, lambda r: (r["title"] != "") & (r["link"] != "") & (r["snippet"] != ""))
