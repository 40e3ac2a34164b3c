"""Document files, JSON lines and matrices as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.session import ship, written

SUFFIXES = (".txt", ".md", ".rst", ".csv", ".pdf", ".docx", ".html", ".htm")
#: Bytes that hold the header of any matrix file.
HEADER = 1 << 17
_SKIP = {"script", "style", "noscript"}
_WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in _SKIP

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skipped:
            self.skipped -= 1

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    """Text nodes joined by newlines, without script, style and noscript; comments and doctype are no text."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells joined by `` | ``, all joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORDS}body")
    read = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORDS}t"))
    out = [read(p) for p in body.findall(f"{_WORDS}p")]
    for row in body.iter(f"{_WORDS}tr"):
        out.append(" | ".join("\n".join(read(p) for p in cell.findall(f"{_WORDS}p")) for cell in row.findall(f"{_WORDS}tc")))
    return "\n\n".join(out)


def pdf_text(data: bytes) -> str:
    """Page texts joined by blank lines; a page that fails is left out (S3). Needs pypdf; without it the file counts as unreadable."""
    from pypdf import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  one bad page must not cost the document
            continue
    return "\n\n".join(pages)


def parse(suffix: str, data: bytes) -> tuple[str, bool]:
    """(text, whether the file could not be read)."""
    try:
        if suffix == ".pdf":
            return pdf_text(data), False
        if suffix == ".docx":
            return docx_text(data), False
        text = data.decode("utf-8", "ignore")
        return (html_text(text) if suffix in (".html", ".htm") else text), False
    except Exception:  # noqa: BLE001  a corrupt file is an empty document with a mark
        return "", True


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, suffix, text, corrupt)`` of every known file below ``root``; doc_id is the relative path.

    The suffix filter sits before the content column is used, and files are parsed where they are read.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    files = files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*SUFFIXES))
    doc_id = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base) + "/", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(s, bytes(c)) for s, c in zip(b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "suffix": b["suffix"], "text": [x[0] for x in found], "corrupt": [x[1] for x in found]})

    return files.select(doc_id.alias("doc_id"), "suffix", "content").mapInPandas(run, "doc_id string, suffix string, text string, corrupt boolean")


def chunk_documents(docs: DataFrame, size: int, overlap: int, min_chars: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, source, position, text)``: blank documents give nothing, short chunks go before positions count."""
    rows = docs.filter(F.length(T.strip(F.col(text))) > 0)
    kept = F.filter(T.chunks(F.col(text), size, overlap), lambda c: F.length(c) >= min_chars)
    rows = rows.select(F.col(id).alias("doc_id"), F.posexplode_outer(kept).alias("position", "text")).filter("position is not null")
    return rows.select("doc_id", F.col("doc_id").alias("source"), "position", "text")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Explicit ``chunk_id`` 0..n-1 in order of document and position.

    Chunks of a document are numbered in its task; documents get their starts from a running sum over one short row a
    document, spread by range.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange("doc_id").withColumn("_r", F.spark_partition_id()))
    totals = ranged.groupBy("_r").agg(F.sum("n").alias("t"))
    offset = totals.select("_r", F.coalesce(F.sum("t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_r").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.join(F.broadcast(offset), "_r").select("doc_id", (F.col("o") + inside).alias("_s"))
    return chunks.join(starts, "doc_id").select((F.col("_s") + F.col("position")).alias("chunk_id"), "doc_id", "source", "position", "text")


def read_jsonl(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """One row per non-blank line; logical columns by a map to physical ones, missing ones null."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(*[F.get_json_object("value", f"$['{src}']").alias(name) for name, src in columns.items()])


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """``(question, relevant_doc_ids)``; a question without a relevant document is an error."""
    rows = spark.read.schema("question string, relevant_doc_ids array<string>").json(path)
    bad = F.col("question").isNull() | (F.coalesce(F.size("relevant_doc_ids"), F.lit(0)) <= 0)
    return rows.withColumn("question", F.when(bad, F.raise_error(F.lit("an eval item needs a question and relevant_doc_ids")).cast("string")).otherwise(F.col("question")))


def read_source(spark: SparkSession, kind: str, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of a named kind of source: ``jsonl``, ``parquet`` or ``json``."""
    if kind == "jsonl":
        return read_jsonl(spark, path, columns)
    if kind in ("parquet", "json"):
        rows = getattr(spark.read, kind)(path)
        return rows.select(*[F.col(src).alias(name) for name, src in columns.items()])
    raise ValueError(f"unknown source {kind!r}")


def read_metadata(spark: SparkSession, path: str, id_field: str = "id") -> DataFrame:
    """``(id, payload)`` of JSON lines; the payload is the object without its id."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    fields = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: k != id_field)
    return lines.select(F.get_json_object("value", f"$['{id_field}']").cast("long").alias("id"), F.to_json(fields).alias("payload"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(id, v)`` of .npy matrices; the row number is the id (S10). Files of a folder follow each other by name.

    Row counts come from the headers alone; then each file is viewed where it is read, in place, and sent on in slices of
    rows. A file is read by one task, and Spark reads files of less than 2 GB so, which bounds what a task holds.
    """
    import numpy as np
    from numpy.lib import format as npy

    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def header(data: bytes) -> tuple[tuple, bool, np.dtype, int]:
        head = io.BytesIO(data)
        read = npy.read_array_header_1_0 if npy.read_magic(head) == (1, 0) else npy.read_array_header_2_0
        shape, by_column, kind = read(head)
        if kind.hasobject:
            raise ValueError("a matrix of objects is no matrix of numbers")
        return shape, by_column, kind, head.tell()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "n": [header(bytes(c))[0][0] for c in b["head"]]})

    heads = raw.select("path", F.substring("content", 1, HEADER).alias("head"))
    sizes = sorted((r["path"], r["n"]) for r in heads.mapInPandas(count, "path string, n long").collect())  # a row a file
    starts, at = {}, 0
    for name, n in sizes:
        starts[name] = at
        at += n

    def parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                shape, by_column, kind, at = header(content[:HEADER])
                x = np.frombuffer(content, kind, offset=at).reshape(shape, order="F" if by_column else "C")
                for lo in range(0, len(x), 10_000):
                    part = x[lo : lo + 10_000]
                    yield pd.DataFrame({"id": starts[name] + lo + np.arange(len(part)), "v": list(part.astype(np.float32))})

    return raw.mapInPandas(parse_all, "id long, v array<float>")
