"""Recursive character chunking with overlap and metadata headers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def chunk_size(preferred: Column, limit: int = 1000) -> Column:
    """The preferred size, but at most the embedder's limit; the limit where there is none."""
    return F.least(F.coalesce(preferred, F.lit(limit)), F.lit(limit))


def _joined(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    length = 0
    for p in parts:
        if window and length + len(p) > size:
            if text := "".join(window).strip():
                out.append(text)
            while window and (length > overlap or length + len(p) > size):
                length -= len(window.pop(0))
        window.append(p)
        length += len(p)
    if text := "".join(window).strip():
        out.append(text)
    return out


def split_text(text: str, size: int = 1000, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that serves; a separator starts the piece behind it."""
    if overlap > size:
        raise ValueError("the overlap is larger than the chunk")
    k = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, rest = separators[k], separators[k + 1 :]
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else list(text)) if p]
    out: list[str] = []
    short: list[str] = []
    for p in pieces:
        if len(p) < size:
            short.append(p)
            continue
        out += _joined(short, size, overlap)
        short = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + _joined(short, size, overlap)


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 20, header: Column | None = None, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a row for each chunk: ``chunk_ix`` and ``chunk``; the header goes in front after splitting."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t or "", size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    x = docs.select(*[c for c in docs.columns if c != text], (F.lit("") if header is None else header).alias("_h"), F.posexplode(split(F.col(text))).alias("chunk_ix", "_c"))
    return x.withColumn("chunk", F.concat("_h", "_c")).drop("_h", "_c")


def header_text(title: Column, published: Column, source: Column, prefix: str = "") -> Column:
    """Prefix and a block of the metadata that is there; the source only of link:// and youtube:// documents."""
    linked = F.when(source.rlike("^(link|youtube)://"), F.regexp_replace(source, "^(link|youtube)://", ""))
    named = [("sourceDocument", title), ("published", published), ("source", linked)]
    lines = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in named])
    lines = F.filter(lines, lambda v: v.isNotNull())
    block = F.concat(F.lit("<document_metadata>\n"), F.array_join(lines, "\n"), F.lit("\n</document_metadata>\n\n"))
    return F.concat(F.lit(prefix), F.when(F.size(lines) > 0, block).otherwise(""))
