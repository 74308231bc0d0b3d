"""Text from binary files, by file type. Failures become the text itself and are also named in a column of their own."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.files import IMAGES, PLAIN, extension
from scriptorium.functions.text import utf8_or_latin1
from scriptorium.sources import pdf

#: What stands in for text that cannot be extracted.
NO_OCR = "pytesseract/Pillow not installed or Tesseract not available; cannot OCR images yet."
PDF_ERROR, DOCX_ERROR, OCR_ERROR = "[PDF extract error] ", "[DOCX extract error] ", "[OCR error] "


def docx_text(content: bytes) -> tuple[str, str | None]:
    """The paragraphs of the body, one a line; tables and headers are left out."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    except Exception as e:
        return f"{DOCX_ERROR}{e}", str(e)
    mark = {f"{ns}tab": "\t", f"{ns}br": "\n", f"{ns}cr": "\n"}
    paragraphs = [] if body is None else body.findall(f"{ns}p")
    return "\n".join("".join((x.text or "") if x.tag == f"{ns}t" else mark.get(x.tag, "") for x in p.iter()) for p in paragraphs), None


def _written(text: str) -> bytes:
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def docx_of(text: Column) -> Column:
    """Texts as DOCX files, a paragraph a line."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(_written, na_action="ignore")

    return F.pandas_udf(run, "binary")(text)


def pdf_text(content: bytes) -> tuple[str, str | None]:
    """The pages of a PDF, a form feed behind each."""
    return pdf_read(content)[:2]


def pdf_read(content: bytes) -> tuple[str, str | None, int | None]:
    """The same, and the number of pages."""
    try:
        pages = pdf.page_texts(content)
    except Exception as e:  # perhaps it can be counted, if not read
        return f"{PDF_ERROR}{e}", str(e), pdf.page_count(content)
    return "".join(f"{page}\n\f" for page in pages), None, len(pages)


def _few(batches: Iterator[pa.RecordBatch], size: int = 1 << 20, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, of about a size: what is made of one is on its way before the next is read."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += n


def pdf_files(texts: DataFrame, lines_per_page: int = 50) -> DataFrame:
    """The rows with their column text written as a PDF file, content, a line a line; null where there is no text."""
    kept = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            made = [None if t is None else pdf.written(t, lines_per_page) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(made, pa.binary())], names=[*(f.name for f in kept), "content"])

    return texts.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "content binary")


def pdf_page_rows(files: DataFrame) -> DataFrame:
    """A row (all but content, page_no, page_text) for each page of the files; one with nulls for what is no PDF that can be read."""
    kept = [f for f in files.schema.fields if f.name != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            pages: list[tuple[int, int | None, str | None]] = []
            for k, content in enumerate(batch.column("content")):
                try:
                    pages += [(k, n, text) for n, text in enumerate(pdf.page_texts(content.as_py()), 1)]
                except Exception:
                    pages.append((k, None, None))
            at = pa.array([k for k, _, _ in pages], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at) for f in kept), pa.array([n for _, n, _ in pages], pa.int32()), pa.array([t for _, _, t in pages], pa.string())], names=[*(f.name for f in kept), "page_no", "page_text"])

    return files.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "page_no int, page_text string")


def image_text(content: bytes) -> tuple[str, str | None]:
    try:
        import pytesseract
        from PIL import Image
    except ImportError:
        return NO_OCR, NO_OCR
    try:
        return pytesseract.image_to_string(Image.open(io.BytesIO(content))), None
    except Exception as e:
        return f"{OCR_ERROR}{e}", str(e)


#: Readers by extension; a caller may add to them.
READERS: dict[str, Callable[[bytes], tuple[str, str | None]]] = {"pdf": pdf_text, "docx": docx_text} | dict.fromkeys(IMAGES, image_text)


def extract(files: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """(filename, content) rows with text, extract_error and total_pages added.

    Plain text is decoded by Spark; only the other types go through Python, in batches.
    """
    readers = READERS if readers is None else readers
    kept = files.columns
    typed = files.withColumn("_ext", extension(F.col("filename")))
    plain = typed.where(F.col("_ext").isin(*PLAIN)).select(*kept, utf8_or_latin1(F.col("content")).alias("text"), F.lit(None).cast("string").alias("extract_error"), F.lit(None).cast("int").alias("total_pages"))

    def read(kind: str, content: bytes) -> tuple[str, str | None, int | None]:
        if kind == "pdf" and readers.get("pdf") is pdf_text:
            return pdf_read(content)
        text, error = readers[kind](content) if kind in readers else ("", None)
        return text, error, pdf.page_count(content) if kind == "pdf" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [read(e, b"" if c is None else c) for e, c in zip(batch.column("_ext").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            texts = [t.encode("utf-8", "replace").decode() for t, _, _ in found]  # a file may name half a sign
            columns = [pa.array(texts, pa.string()), pa.array([e for _, e, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "text", "extract_error", "total_pages"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    other = typed.where(~F.col("_ext").isin(*PLAIN)).mapInArrow(run, f"{kinds}, text string, extract_error string, total_pages int")
    return plain.unionByName(other)
