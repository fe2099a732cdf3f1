"""Repositories, wikis and transcripts as documents; what fetches their rows is given as a function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from .pages import ENTITIES, inner_text

# --- paged sources

#: (rows of a page counted from 1, number of pages).
Fetch = Callable[[int], tuple[list[tuple], int]]


class _Page(InputPartition):
    pass


def read_pages(spark: SparkSession, name: str, schema: str, fetch: Fetch) -> DataFrame:
    """The rows of all pages of a source, one task a page.

    The driver asks for the first page to learn how many there are.  A lost
    task asks for its page again, so ``fetch`` has to answer the same.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Page(i) for i in range(1, max(fetch(1)[1], 1) + 1)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(partition.value)[0]

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()


# --- ignored paths


def _glob(pattern: str) -> str:
    """A pattern of an ignore file, without ``!`` and the last ``/``, as an expression for a whole path."""
    anchored = "/" in pattern
    parts = pattern.removeprefix("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += ".+" if last else "(?:.*/)?"
            continue
        for piece in re.findall(r"\\.|\[!?\]?[^\]]*\]|\*+|\?|[^\\*?\[]+|.", p, re.S):
            if piece[0] == "*":
                out += "[^/]*"
            elif piece == "?":
                out += "[^/]"
            elif piece[0] == "[" and len(piece) > 2:
                out += ("[^/" if piece[1] == "!" else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", piece[1:-1].removeprefix("!")) + "]"
            else:
                out += re.escape(piece[1:] if piece[0] == "\\" and len(piece) == 2 else piece)
        out += "" if last else "/"
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Is a file ignored by the lines of an ignore file?  The last line that fits decides.

    A file in an ignored folder is ignored, whatever later lines say of it.
    """
    lines = []
    for p in patterns:
        p = re.sub(r"(?<!\\)\s+$", "", p)
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        if p:
            lines.append((back, "^" + _glob(p) + ("/" if folder else "/?") + "$"))

    def one(x: Column) -> Column:
        out = F.lit(False)
        for back, expression in lines:
            out = F.when(x.rlike("(?s)" + expression), F.lit(not back)).otherwise(out)
        return out

    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    return F.exists(ends, one)


# --- repositories


def _said(kind: str, title: Column, author: Column, about: Column, content: Column, url: Column, source: Column) -> list[Column]:
    return [url.alias("url"), title.alias("title"), author.alias("docAuthor"), about.alias("description"), source.alias("docSource"), F.lit(kind).alias("kind"), content.alias("pageContent"), X.word_count(content).alias("wordCount")]


def repository_files(files: DataFrame, author: str, host: str = "github", ignore: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Documents of a repository's files (path, content) that aren't ignored; empty ones have none.

    Without ``recursive`` only files of the top folder count.
    """
    x = files.filter((F.coalesce("content", F.lit("")) != "") & ~ignored(F.col("path"), ignore or []))
    x = x if recursive else x.filter(~F.contains("path", F.lit("/")))
    return x.select(*_said("file", F.col("path"), F.lit(author), F.lit("No description found."), F.col("content"), F.concat(F.lit(f"{host}://"), "path"), F.col("path")))


#: Fields of an issue in the order in which they are told.
ISSUE_FIELDS = ["author", "assignees", "closed_by", "web_url", "state", "created_at", "updated_at", "closed_at", "due_date", "type", "merge_request_count", "upvotes", "downvotes", "labels", "has_tasks", "task_status", "confidential", "severity", "milestone", "time_estimate", "total_time_spent"]


def issue_text(iid: Column, title: Column, description: Column, fields: dict[str, Column], lists: dict[str, Column], discussions: Column) -> Column:
    """An issue as markdown: title, description, told fields and discussions (an array of arrays of notes).

    ``fields`` are texts and ``lists`` arrays of texts, by name; those that are
    null, empty, "0" or "false" are left out.  Of a name the first underscore
    is a space.  Notes of one discussion are joined by commas.
    """
    told = []
    for name in ISSUE_FIELDS:
        label = f"- {name.replace('_', ' ', 1)}:"
        if name in fields:
            told.append(F.when(~fields[name].isin("", "0", "false"), F.concat(F.lit(label + " "), fields[name])))
        if name in lists:
            told.append(F.when(F.size(lists[name]) > 0, F.concat(F.lit(label + "\n"), F.array_join(F.transform(lists[name], lambda v: F.concat(F.lit("  - "), v)), "\n"))))
    activity = F.concat(F.lit("\n\n## Activity\n\n"), F.array_join(F.transform(discussions, lambda d: F.array_join(d, ",")), "\n\n"), F.lit("\n"))
    return F.concat(
        F.lit("# "), title, F.lit(" ("), iid.cast("string"), F.lit(")\n\n"), F.coalesce(description, F.lit("null")), F.lit("\n\n## Metadata\n\n"),
        F.array_join(F.array(*told) if told else F.array().cast("array<string>"), "\n"), F.when(F.size(discussions) > 0, activity).otherwise(""),
    )


def note_text(user: Column, at: Column, body: Column) -> Column:
    return F.concat(user, F.lit(" at "), at, F.lit(":\n"), body)


def wiki_pages(pages: DataFrame, repo: str, author: str) -> DataFrame:
    """Documents of a repository's wiki (slug, title, format, content)."""
    about = F.concat(F.lit("GitLab Wiki Page"), F.when(F.col("format") == "markdown", " (Markdown)").otherwise(""))
    source = F.concat(F.lit(f"wiki-{repo}-"), "slug")
    x = pages.filter(F.coalesce("content", F.lit("")) != "")
    return x.select(*_said("wiki", F.col("title"), F.lit(author), about, F.col("content"), F.concat(F.lit("gitlab://"), source), source))


def issues(rows: DataFrame, repo: str) -> DataFrame:
    """Documents of issues (iid, title, author, description, text), ``text`` from :func:`issue_text`."""
    source = F.concat(F.lit(f"issue-{repo}-"), F.col("iid").cast("string"))
    title = F.concat(F.lit("Issue "), F.col("iid").cast("string"), F.lit(": "), "title")
    return rows.select(*_said("issue", title, F.col("author"), F.col("description"), F.col("text"), F.concat(F.lit("gitlab://"), source), source))


# --- wikis


def wiki_page_id(host: Column, space: Column, page: Column, created: Column) -> Column:
    """An id that stays the same until the page changes."""
    return F.concat_ws(".", host, space.cast("string"), page.cast("string"), created.cast("string"))


def wiki_body(body: Column, title: Column) -> Column:
    """The page as text, its title if it has no body; runs of three and more line breaks become two, heads of tables are in capitals."""
    held = F.when(F.trim(F.coalesce(body, F.lit(""))) != "", body).otherwise(title)
    pieces = F.split(held, r"(?i)(?=<th\b)|(?<=</th>)")

    def loud(p: Column) -> Column:
        out = F.upper(F.regexp_replace(p, r"(?s)^<[^>]*>|</[tT][hH]>$", ""))
        for reference, _ in ENTITIES:
            out = F.replace(out, F.lit(reference.upper()), F.lit(reference))
        return F.when(p.rlike(r"(?is)^<th\b"), F.concat(F.regexp_extract(p, r"(?s)^(<[^>]*>)", 1), out, F.lit("</th>"))).otherwise(p)

    return F.regexp_replace(inner_text(F.array_join(F.transform(pieces, loud), "")), r"\n{3,}", "\n\n")


# --- transcripts

_SEGMENTS = "$.actions[0].updateEngagementPanelAction.content.transcriptRenderer.content.transcriptSearchPanelRenderer.body.transcriptSegmentListRenderer.initialSegments"


def transcript(answer: Column) -> Column:
    """The text of a transcript's JSON: runs joined, segments with text by a space, white space collapsed; null without segments."""
    shape = "array<struct<transcriptSegmentRenderer:struct<snippet:struct<runs:array<struct<text:string>>>>>>"
    segments = F.from_json(F.get_json_object(answer, _SEGMENTS), shape)
    said = F.transform(segments, lambda s: F.coalesce(F.array_join(s["transcriptSegmentRenderer"]["snippet"]["runs"]["text"], ""), F.lit("")))
    return F.regexp_replace(F.trim(F.array_join(F.filter(said, lambda t: t != ""), " ")), r"\s+", " ")
