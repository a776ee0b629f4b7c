"""Files as sources and sinks: plain text, subtitles, books, word-processor documents and pages.

Files come from Spark's ``binaryFile`` source, so that a folder of many is read in parallel. Texts are decoded and
archives opened by Arrow batch functions, one file at a time; everything after that is plain columns.
"""

from __future__ import annotations

import base64
import codecs
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstream.functions.providers import role_words
from leafstream.functions.text import extension, file_hash
from leafstream.sources import books, word
from leafstream.sources.plain import translatable

#: Formats by ending, and what each is written as.
OUTPUTS = {".txt": ".txt", ".md": ".txt", ".srt": ".srt", ".epub": ".epub", ".docx": ".docx", ".pdf": ".docx"}
#: The largest file that is taken as an upload.
UPLOAD_LIMIT = 200 * 1024 * 1024


def decode(data: bytes) -> str:
    """A text file's text: UTF-8 with or without its mark, UTF-16 with its mark, Windows-1252, else Latin-1."""
    marked = data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE))
    for encoding in ("utf-8-sig", *(["utf-16"] if marked else []), "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, ext, file_hash, content) of the files under a path; `doc_id` is the file's path.

    Files of other formats are kept, with a null `ext`, so that a caller can name them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = extension(name)
    return found.select(
        F.col("path").alias("doc_id"),
        name.alias("filename"),
        F.when(ext.isin(*OUTPUTS), ext).alias("ext"),
        file_hash(F.col("content")).alias("file_hash"),
        "content",
    )


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """A text typed in, as a file ``text.txt``; a blank one is refused."""
    if not text.strip():
        raise ValueError("the text is empty")
    return uploaded(spark, "text.txt", base64.b64encode(text.encode()).decode())


def uploaded(spark: SparkSession, filename: str, encoded: str) -> DataFrame:
    """A file sent in base64, under its bare name."""
    data = base64.b64decode(encoded)
    if len(data) > UPLOAD_LIMIT:
        raise ValueError("the file is too large")
    name = filename.replace("\\", "/").rsplit("/", 1)[-1]
    ext = extension(F.col("filename"))
    rows = spark.createDataFrame([(name, data)], "filename string, content binary")
    return rows.select(
        F.col("filename").alias("doc_id"), "filename", F.when(ext.isin(*OUTPUTS), ext).alias("ext"), file_hash(F.col("content")).alias("file_hash"), "content"
    )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if c is None else decode(c) for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ext"), pa.array(texts, pa.string())], names=["doc_id", "ext", "text"])


def texts(files: DataFrame) -> DataFrame:
    """(doc_id, ext, text) of plain texts and subtitles."""
    own = files.where(F.col("ext").isin(".txt", ".md", ".srt")).select("doc_id", "ext", "content")
    return own.mapInArrow(_decoded, "doc_id string, ext string, text string")


def _rows(batches: Iterator[pa.RecordBatch], schema: str, read: Callable[[dict], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """What `read` makes of each file, its doc_id before it and a null problem behind; for a file that can't be read a
    row of nulls that says why, so that no file keeps the others from being read."""
    types = {"string": pa.string(), "int": pa.int32()}
    fields = [c.split() for c in schema.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for file in batch.to_pylist():
            try:
                rows += [(file["doc_id"], *row, None) for row in read(file)]
            except Exception as e:  # noqa: BLE001
                rows.append((file["doc_id"], *[None] * (len(fields) - 2), f"{type(e).__name__}: {e}"[:300]))
        columns = list(zip(*rows)) or [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


_BLOCKS = "doc_id string, member string, place string, seg_id int, text string, problem string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(file: dict) -> list[tuple]:
        found = books.blocks(file["content"]) if file["ext"] == ".epub" else word.paragraphs(file["content"])
        return [(member, place, no, text) for no, (member, place, text) in enumerate(found)]

    return _rows(batches, _BLOCKS, read)


def blocks(files: DataFrame) -> DataFrame:
    """(doc_id, member, place, seg_id, text, problem): the text blocks of books and word-processor documents, in order.
    A file that can't be read has one row, with its `problem`."""
    own = files.where(F.col("ext").isin(".epub", ".docx")).select("doc_id", "ext", "content")
    return own.mapInArrow(_blocks, _BLOCKS)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ext, content, results in zip(*(batch.column(c).to_pylist() for c in ("ext", "content", "results"))):
            known = {r["seg_id"]: r["translation"] for r in results or ()}
            try:
                out.append(books.rebuild(content, known) if ext == ".epub" else word.rebuild(content, known))
            except Exception:  # noqa: BLE001
                out.append(None)  # the blocks say what is wrong with it
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])


def rebuild(files: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, content): books and word-processor documents with the results (doc_id, seg_id, translation) in place;
    a null content for those that can't be read.

    A document's results are collected to the row that holds its file, which bounds them.
    """
    own = files.where(F.col("ext").isin(".epub", ".docx")).select("doc_id", "ext", "content")
    grouped = results.groupBy("doc_id").agg(F.collect_list(F.struct("seg_id", "translation")).alias("results"))
    return own.join(grouped, "doc_id", "left").mapInArrow(_rebuilt, "doc_id string, content binary")


def pages_to_word(pages: DataFrame) -> DataFrame:
    """(doc_id, content): word-processor documents from (doc_id, pages), an array of arrays of paragraphs."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word.from_pages(p) for p in batch.column("pages").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return pages.select("doc_id", "pages").mapInArrow(write, "doc_id string, content binary")


def _page_texts(content: bytes) -> list[str]:
    """The pages' texts of a PDF file, by whichever library that reads them is installed; one without any text, as
    of pictures of pages, is refused."""
    try:
        from pypdf import PdfReader
    except ImportError:
        PdfReader = None
    if PdfReader:
        reader = PdfReader(io.BytesIO(content))
        if reader.is_encrypted and not reader.decrypt(""):
            raise RuntimeError("the PDF file is protected by a password")
        found = [page.extract_text() or "" for page in reader.pages]
    else:
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("PDF files need pypdf or pdfplumber; or give their pages as a table (doc_id, page_no, text)") from e
        with pdfplumber.open(io.BytesIO(content)) as document:
            found = [page.extract_text() or "" for page in document.pages]
    if not any(map(translatable, found)):
        raise ValueError("no text in the PDF file: its pages are probably pictures")
    return found


_PAGES = "doc_id string, page_no int, text string, problem string"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rows(batches, _PAGES, lambda file: list(enumerate(_page_texts(file["content"]))))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, problem) of PDF files, where a library that reads them is installed on the executors. A
    file that can't be read has one row, with its `problem`."""
    return files.where(F.col("ext") == ".pdf").select("doc_id", "content").mapInArrow(_pages, _PAGES)


_PROVIDER = (
    "name string, base_url string, url string, api_key string, key string, model string, concurrency int, enabled boolean, "
    "extra_headers map<string,string>, use_for string, roles string"
)


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    """A providers file: a list, or an object that holds one; other names of fields are taken, disabled ones left out.

    `use_for` may be a list of roles or a text such as ``translate, review``, and comes out as an array.
    """
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.concat(F.lit('{"providers":'), F.col("value"), F.lit("}")), wrapped_schema())
    either = F.when(F.startswith(F.ltrim("value"), F.lit("[")), listed).otherwise(F.from_json("value", wrapped_schema()))
    rows = raw.select(F.explode(either["providers"]).alias("p")).select("p.*")
    # a list that is read as a string stands there as JSON
    told = F.coalesce("use_for", "roles")
    roles = F.when(F.startswith(F.ltrim(told), F.lit("[")), F.from_json(told, "array<string>")).otherwise(role_words(told))
    return rows.where(F.coalesce("enabled", F.lit(True))).select(
        "name",
        F.coalesce("base_url", "url").alias("base_url"),
        F.coalesce("api_key", "key").alias("api_key"),
        "model",
        "concurrency",
        "enabled",
        "extra_headers",
        roles.alias("use_for"),
    )


def wrapped_schema() -> str:
    fields = ", ".join(":".join(f.split(" ", 1)) for f in _PROVIDER.split(", "))
    return f"providers array<struct<{fields}>>"
