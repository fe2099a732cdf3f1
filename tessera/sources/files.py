"""Files and texts as documents: routing, sniffing, sheets, mail, raw text and the stored folders.

A document has id, url, title, docAuthor, description, docSource, chunkSource,
published, wordCount, pageContent and token_count_estimate.
"""

from __future__ import annotations

import email
import email.policy
import mailbox
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.store import name_uuid

#: Extensions by the converter that reads them.
CONVERTERS = {
    "text": [".txt", ".md", ".org", ".adoc", ".rst", ".csv", ".json", ".html"],
    "pdf": [".pdf"],
    "office": [".docx", ".pptx", ".odt", ".odp"],
    "sheet": [".xlsx"],
    "mail": [".mbox"],
    "book": [".epub"],
    "sound": [".mp3", ".wav", ".mp4", ".mpeg", ".m4a"],
    "image": [".png", ".jpg", ".jpeg", ".webp"],
}
SNIFFED_BYTES = 1024


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def looks_like_text(content: Column) -> Column:
    """Has the first KB under a tenth of control characters?  A zero byte counts twice."""
    head = F.decode(F.substring(content, 1, SNIFFED_BYTES), "ISO-8859-1")
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F]", "")) + F.length(head) - F.length(F.regexp_replace(head, r"\x00", ""))
    return F.length(head) * 0.1 > odd


def converter(name: Column, content: Column) -> Column:
    """The converter of a file; other files that look like text are text, the rest null, which rejects them."""
    out = None
    for kind, known in CONVERTERS.items():
        hit = extension(name).isin(*known)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(looks_like_text(content), "text")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, modified, content, kind) of the files of a folder, at any depth; empty files have no row."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return x.select(name.alias("name"), "path", F.col("modificationTime").alias("modified"), "content", converter(name, F.col("content")).alias("kind"))


def document(title: Column, content: Column, url: Column, source: Column, published: Column, author: str = "Unknown", description: str = "Unknown", chunk_source: Column | None = None) -> list[Column]:
    """The columns of a document; its id is that of its url."""
    return [
        name_uuid(url).alias("id"), url.alias("url"), title.alias("title"), F.lit(author).alias("docAuthor"), F.lit(description).alias("description"), source.alias("docSource"),
        (F.lit("") if chunk_source is None else chunk_source).alias("chunkSource"), published.alias("published"), X.word_count(content).alias("wordCount"), content.alias("pageContent"),
        F.ceil(F.length(content) / 4).alias("token_count_estimate"),
    ]


def text_documents(files: DataFrame) -> DataFrame:
    """Documents of the text files (html as it is); empty ones have none."""
    x = files.filter("kind = 'text'").withColumn("_t", F.decode("content", "UTF-8")).filter(F.length("_t") > 0)
    return x.select(*document(F.col("name"), F.col("_t"), F.concat(F.lit("file://"), "path"), F.lit("a text file uploaded by the user."), F.col("modified").cast("string")))


def sheet_text(rows: DataFrame, scope: list[str], order: str, cells: str) -> DataFrame:
    """``scope`` and ``content``: a sheet's rows as lines, cells by commas; a text with a comma is quoted, a null is empty.

    ``cells``: array of struct(value, is_text).
    """
    cell = F.transform(cells, lambda c: F.when(c["value"].isNull(), "").when(c["is_text"] & F.contains(c["value"], F.lit(",")), F.concat(F.lit('"'), c["value"], F.lit('"'))).otherwise(c["value"]))
    lines = rows.select(*scope, F.col(order).alias("_o"), F.array_join(cell, ",").alias("_l"))
    whole = lines.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_r"))
    return whole.select(*scope, F.array_join(F.transform("_r", lambda r: r["_l"]), "\n").alias("content"))


def sheet_documents(sheets: DataFrame, published: Column) -> DataFrame:
    """A document for each sheet (file, sheet, content) that has any content."""
    url = F.concat(F.lit("file://"), "file", F.lit("/"), X.slug(F.col("sheet")), F.lit(".csv"))
    return sheets.filter("content != ''").select("file", "sheet", *document(F.concat("file", F.lit(" - Sheet:"), "sheet"), F.col("content"), url, F.lit("an xlsx file uploaded by the user."), published))


def _mails(content: bytes) -> Iterator[tuple[str | None, str | None, str]]:
    with tempfile.TemporaryDirectory() as folder:  # gone before the next file; nobody else reads it
        path = Path(folder) / "box"
        path.write_bytes(content)
        for m in mailbox.mbox(path, factory=lambda f: email.message_from_binary_file(f, policy=email.policy.default)):
            body = m.get_body(preferencelist=("plain",))
            text = body.get_content() if body is not None else ""
            if text.strip():
                yield m["subject"], m["from"], text


def mail_rows(files: DataFrame) -> DataFrame:
    """(name, item, subject, sender, text) of each mail with a text in mbox files (name, content); items count from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(name, i, s, f, t) for i, (s, f, t) in enumerate(_mails(content.as_py() or b""), 1)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", "item", "subject", "sender", "text"])

    return files.select("name", "content").mapInArrow(run, "name string, item bigint, subject string, sender string, text string")


def mail_title(subject: Column, item: Column, name: Column) -> Column:
    """The subject less its first full stop as a slug, else the mail's number and the file."""
    plain = F.regexp_replace(subject, r"^([^.]*)\.", "$1")
    return F.when(F.coalesce(subject, F.lit("")) != "", F.concat(X.slug_cased(plain), F.lit(".mbox"))).otherwise(F.concat(F.lit("msg_"), item.cast("string"), F.lit("-"), name))


def bare_name(title: Column) -> Column:
    """A title without its last extension, as a slug."""
    return X.slug(F.when(F.contains(title, F.lit(".")), F.replace(F.regexp_replace(title, r"\.[^.]*$", ""), F.lit("."), F.lit("-"))).otherwise(title))


def raw_documents(rows: DataFrame, now: Column) -> DataFrame:
    """Documents of raw texts with what metadata they came with (title, url, author, description, source, chunk_source, published in ms as text); empty texts have none."""
    name = F.concat(bare_name(F.col("title")), F.lit(".txt"))
    url = F.when(F.col("url").rlike(r"^(?i)https?://[^/]"), F.concat(F.lit("web://"), F.lower("url"), F.lit(".website"))).otherwise(F.concat(F.lit("file://"), name))
    at = F.coalesce(F.timestamp_millis(F.col("published").try_cast("bigint")), now)
    return rows.filter(F.coalesce("text", F.lit("")) != "").select(
        url.alias("url"), name.alias("title"), F.coalesce("author", F.lit("no author specified")).alias("docAuthor"), F.coalesce("description", F.lit("no description found")).alias("description"),
        F.coalesce("source", F.lit("no source set")).alias("docSource"), F.coalesce("chunk_source", name).alias("chunkSource"), F.date_format(at, "M/d/yyyy, h:mm:ss a").alias("published"),
        X.word_count(F.col("text")).alias("wordCount"), F.col("text").alias("pageContent"),
    )


def vault_documents(files: DataFrame) -> DataFrame:
    """(path, vault, title, tokens, status) of a vault's files (path, content); the vault has a name only if all files share one root."""
    root = F.split("path", "/")[0]
    roots = files.agg(F.count_distinct(root).alias("_n"), F.min(root).alias("_r"))
    x = files.join(F.broadcast(roots))
    ok = F.coalesce("content", F.lit("")) != ""
    return x.select("path", F.when(F.col("_n") == 1, F.col("_r")).alias("vault"), F.regexp_extract("path", r"([^/]+)$", 1).alias("title"), F.when(ok, F.length("content") / 4).alias("tokens"), F.when(ok, "success").otherwise("failed").alias("status"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """Append documents (folder, name, ...) to the stored ones, by folder."""
    docs.write.mode("append").partitionBy("folder").parquet(folder)


def stored(docs: DataFrame) -> DataFrame:
    """Stored documents without their texts; ordered by ``own`` descending, the folder of own documents comes first."""
    return docs.drop("pageContent").withColumn("own", F.col("folder") == "custom-documents")


def found_by_name(docs: DataFrame, name: str) -> DataFrame:
    """The document of a name, in the first folder that has it."""
    return docs.filter(F.col("name") == name).orderBy("folder").limit(1)


def moved(files: DataFrame, wanted: DataFrame, embedded: DataFrame) -> DataFrame:
    """(name, folder, moved): files with a wanted folder go there unless they are embedded."""
    x = files.join(wanted.select("name", F.col("folder").alias("_to")), "name", "left").join(embedded.select("name").distinct().withColumn("_e", F.lit(True)), "name", "left")
    go = F.col("_to").isNotNull() & F.col("_e").isNull()
    return x.select("name", F.when(go, F.col("_to")).otherwise(F.col("folder")).alias("folder"), F.when(F.col("_to").isNotNull(), go).alias("moved"))


def purged(docs: DataFrame, folder: str, protected: str = "custom-documents") -> DataFrame:
    """Documents without those of a folder; the protected one stays."""
    return docs if folder == protected else docs.filter(F.col("folder") != folder)
