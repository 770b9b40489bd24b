"""Choosing and joining extracted text, row by row.

What a parser or recogniser yields for one document arrives inside that
document's row, as candidate texts or as lists of pages, blocks or annotations.
Joining them is an expression over the row, so nothing is regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselight.functions.prompts import lookup
from clauselight.functions.text import strip
from clauselight.schemas import PROCESSED_FOLDER, UPLOAD_FOLDER

# Extensions, thresholds, method names and notes.
FILE_TYPES = {
    "pdf": "pdf",
    "doc": "doc",
    "docx": "docx",
    "jpg": "image",
    "jpeg": "image",
    "png": "image",
    "tiff": "image",
    "txt": "text",
}
MIN_PDF_CHARS = 100
MIN_VISION_CHARS = 10
NOTES = {
    "ocr": "Document processed using OCR",
    "google_vision": "Document processed using Google Cloud Vision",
    "documentai": "Document processed using Google Cloud Document AI",
}
METHODS = {"pdf": "pdfplumber", "doc": "python-docx", "docx": "python-docx"}

BLOCK_BREAK = "\n\n"
PAGES = "array<struct<page_no:int,text:string,n_images:int,n_tables:int>>"
BLOCKS = "array<struct<kind:string,pos:int,text:string,cells:array<string>>>"
ANNOTATIONS = "array<struct<text:string,confidence:double>>"
_ALL = 2**30


def file_type(filename: Column) -> Column:
    """Type by the part after the last dot; an unknown one is text."""
    extension = F.lower(F.substring_index(filename, ".", -1))
    return lookup(extension, {**FILE_TYPES, "": "text"}, "")


def upload_path(document_id: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit(UPLOAD_FOLDER), document_id, filename)


def processed_path(document_id: Column) -> Column:
    return F.concat_ws("/", F.lit(PROCESSED_FOLDER), document_id, F.lit("simplified.json"))


def decode_text(content: Column) -> Column:
    """UTF-8 bytes as text, invalid bytes dropped.

    Invalid bytes are first marked with the replacement character. One already
    in the text is kept apart by an escape, itself escaped.
    """
    escape, mark = "\u0001", "�"
    raw = content.cast("string")
    guarded = F.replace(
        F.replace(raw, F.lit(escape), F.lit(escape + "0")), F.lit(mark), F.lit(escape + "1")
    )
    dropped = F.replace(F.make_valid_utf8(guarded), F.lit(mark), F.lit(""))
    restored = F.replace(
        F.replace(dropped, F.lit(escape + "1"), F.lit(mark)), F.lit(escape + "0"), F.lit(escape)
    )
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def pdf_text(*candidates: Column) -> Column:
    """The first candidate with enough text; NULL when none has."""
    return F.coalesce(
        *[F.when(F.length(strip(text)) > MIN_PDF_CHARS, text) for text in candidates]
    )


def image_text(vision: Column, recognised: Column) -> Column:
    """The vision text when it is long enough, else the recognised text as it is."""
    return F.when(F.length(strip(vision)) > MIN_VISION_CHARS, vision).otherwise(recognised)


def pages_text(pages: Column) -> Column:
    """Page texts in page order; pages without text leave no gap."""
    ordered = F.array_sort(
        F.transform(pages, lambda p: F.struct(p["page_no"].alias("n"), p["text"].alias("t")))
    )
    texts = F.transform(F.filter(ordered, lambda p: p["t"] != ""), lambda p: p["t"])
    return F.array_join(texts, BLOCK_BREAK)


def blocks_text(blocks: Column) -> Column:
    """Paragraphs as they are, then table rows as their non-blank cells."""

    def ordered(kind: str) -> Column:
        return F.array_sort(
            F.transform(
                F.filter(blocks, lambda b: b["kind"] == kind),
                lambda b: F.struct(b["pos"].alias("n"), b["text"].alias("t"), b["cells"].alias("c")),
            )
        )

    def row_text(cells: Column) -> Column:
        trimmed = F.transform(cells, lambda cell: strip(cell))
        return F.array_join(F.filter(trimmed, lambda cell: cell != ""), " | ")

    paragraphs = F.filter(
        F.transform(ordered("paragraph"), lambda b: b["t"]), lambda t: strip(t) != ""
    )
    rows = F.filter(F.transform(ordered("row"), lambda b: row_text(b["c"])), lambda t: t != "")
    return F.array_join(F.concat(paragraphs, rows), BLOCK_BREAK)


def text_by_type(kind: Column, *, pdf: Column, word: Column, image: Column, plain: Column) -> Column:
    """Dispatch on the document type; any other type has no text."""
    return (
        F.when(kind == "pdf", pdf)
        .when(kind.isin("doc", "docx"), word)
        .when(kind == "image", image)
        .when(kind == "text", plain)
    )


def annotation_confidence(annotations: Column) -> Column:
    """Mean confidence without the first annotation, which is the full text."""
    scores = F.filter(
        F.transform(F.slice(annotations, 2, _ALL), lambda a: a["confidence"]),
        lambda c: c.isNotNull(),
    )
    return mean_of(scores)


def mean_of(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scores) > 0, total / F.size(scores))


def image_method(confidence: Column) -> Column:
    return F.when(confidence.isNotNull(), "google_vision").otherwise("ocr")


def page_facts(pages: Column) -> Column:
    """page_count, has_images and has_tables of a document's own page list."""
    return F.struct(
        F.size(pages).cast("bigint").alias("page_count"),
        F.exists(pages, lambda p: p["n_images"] > 0).alias("has_images"),
        F.exists(pages, lambda p: p["n_tables"] > 0).alias("has_tables"),
    )


def rollup_pages(pages: DataFrame) -> DataFrame:
    """The same facts from a table with one row per page."""
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.bool_or(F.col("n_images") > 0).alias("has_images"),
        F.bool_or(F.col("n_tables") > 0).alias("has_tables"),
    )


def method_of(kind: Column, image_confidence: Column) -> Column:
    """Extraction method by type; plain text needs none."""
    chain = F.when(kind == "image", image_method(image_confidence))
    for name, method in METHODS.items():
        chain = chain.when(kind == name, method)
    return chain


def processing_notes(method: Column) -> Column:
    """What to tell the reader about the method, as a list."""
    note = F.coalesce(*[F.when(method == name, text) for name, text in NOTES.items()])
    return F.array_compact(F.array(note))


def document_facts(kind: Column, content_size: Column, pages: Column, image_confidence: Column) -> Column:
    """The facts recorded at upload; the language is never detected here."""
    facts = page_facts(pages)
    method = method_of(kind, image_confidence)
    return F.struct(
        kind.alias("file_type"),
        content_size.alias("size_bytes"),
        method.alias("extraction_method"),
        F.lit(None).cast("string").alias("language_detected"),
        F.when(kind == "pdf", facts["page_count"])
        .when(kind == "image", F.lit(1).cast("bigint"))
        .alias("page_count"),
        F.when(kind == "image", True)
        .when(kind == "text", False)
        .otherwise(facts["has_images"])
        .alias("has_images"),
        F.when(kind.isin("image", "text"), False).otherwise(facts["has_tables"]).alias("has_tables"),
        F.when(kind == "image", image_confidence).alias("ocr_confidence"),
        processing_notes(method).alias("processing_notes"),
    )
