"""Typing, decoding and joining extracted text."""

from pyspark.sql import functions as F

from clauselight.catalog import query, rounded
from clauselight.functions import extraction as ex
from clauselight.sources.adapters import METADATA_SQL, document_metadata, documents, table

# File names of every kind, one per document.
_NAME = (
    "CASE doc_id % 9 WHEN 0 THEN 'scan.b.TIFF' WHEN 1 THEN 'scan.tif' WHEN 2 THEN 'pdf'"
    " WHEN 3 THEN 'noext' || source WHEN 4 THEN source || '.JPEG' WHEN 5 THEN source || '.docx'"
    " WHEN 6 THEN source || '.Doc' WHEN 7 THEN source || '.txt' ELSE source || '.pdf' END"
)


@query(
    "fn8_file_types",
    f"""SELECT doc_id, filename, CASE lower(regexp_extract(filename, '[^.]*$'))
  WHEN 'pdf' THEN 'pdf' WHEN 'doc' THEN 'doc' WHEN 'docx' THEN 'docx'
  WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'png' THEN 'image' WHEN 'tiff' THEN 'image'
  ELSE 'text' END AS file_type
FROM (SELECT doc_id, {_NAME} AS filename FROM documents) f""",
)
def fn8(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_NAME} AS filename")
    return rows.withColumn("file_type", ex.file_type(F.col("filename")))


@query(
    "fn9_storage_paths",
    f"""SELECT document_id, 'uploads/' || document_id || '/' || filename AS storage_path,
  'processed/' || document_id || '/simplified.json' AS processed_path FROM ({METADATA_SQL}) m""",
)
def fn9(spark, sf_dir):
    return document_metadata(spark, sf_dir).select(
        "document_id",
        ex.upload_path(F.col("document_id"), F.col("filename")).alias("storage_path"),
        ex.processed_path(F.col("document_id")).alias("processed_path"),
    )


@query(
    "fn11_decoded_text",
    "SELECT doc_id, text || '!' || text AS decoded, CAST(strlen(text) AS BIGINT) * 2 + 3 AS size_bytes FROM documents",
)
def fn11(spark, sf_dir):
    # An invalid byte before, and a cut-off character within, the bytes of each text.
    content = F.concat(
        F.lit(b"\xff"),
        F.encode("text", "UTF-8"),
        F.lit(b"!\xc3"),
        F.encode("text", "UTF-8"),
    )
    rows = documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return rows.select(
        "doc_id",
        ex.decode_text(F.col("content")).alias("decoded"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
    )


# Candidate texts: whole, first line only, or nothing.
_FIRST = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN split_part(text, chr(10), 1) END"
_SECOND = "CASE WHEN doc_id % 2 = 0 THEN '  ' || split_part(text, chr(10), 1) || '  ' ELSE text END"


@query(
    "fn12_extraction_cascade",
    f"""SELECT doc_id,
  CASE WHEN length(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) > 100 THEN a
    WHEN length(regexp_replace(b, '^\\s+|\\s+$', '', 'g')) > 100 THEN b END AS pdf_text,
  CASE WHEN length(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) > 10 THEN a ELSE b END AS image_text
FROM (SELECT doc_id, {_FIRST} AS a, {_SECOND} AS b FROM documents) c""",
)
def fn12(spark, sf_dir):
    rows = documents(spark, sf_dir).selectExpr(
        "doc_id", f"{_FIRST} AS a", f"{_SECOND} AS b"
    )
    nothing = F.lit(None).cast("string")
    return rows.select(
        "doc_id",
        ex.pdf_text(nothing, F.col("a"), F.col("b")).alias("pdf_text"),
        ex.image_text(F.col("a"), F.col("b")).alias("image_text"),
    )


def _pages(lines):
    """Lines as pages listed last to first, some without text."""
    return F.transform(
        lines,
        lambda line, i: F.struct(
            (F.lit(1_000_000) - i).cast("int").alias("page_no"),
            F.when(~F.contains(line, F.lit("?")), line).alias("text"),
            F.regexp_count(line, F.lit(",")).alias("n_images"),
            F.regexp_count(line, F.lit(r"\|")).alias("n_tables"),
        ),
    )


def _document_pages(spark, sf_dir):
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select("doc_id", _pages(lines).alias("pages"))


_LINES = "str_split(text, chr(10))"


@query(
    "fn13_joined_pages",
    f"""SELECT doc_id, array_to_string(list_reverse(list_filter({_LINES},
  lambda x: x <> '' AND NOT contains(x, '?'))), chr(10) || chr(10)) AS text FROM documents""",
)
def fn13(spark, sf_dir):
    rows = _document_pages(spark, sf_dir)
    return rows.select("doc_id", ex.pages_text(F.col("pages")).alias("text"))


@query(
    "fn14_joined_blocks",
    rf"""SELECT doc_id, array_to_string(list_concat(
    list_filter({_LINES}, lambda x: NOT contains(x, ',') AND trim(x) <> ''),
    list_filter(list_transform(list_filter({_LINES}, lambda x: contains(x, ',')),
      lambda x: array_to_string(list_filter(list_transform(str_split(x, ','), lambda c: trim(c)), lambda c: c <> ''), ' | ')),
      lambda r: r <> '')), chr(10) || chr(10)) AS text
FROM documents""",
)
def fn14(spark, sf_dir):
    # Lines with commas stand for table rows, the others for paragraphs.
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(F.contains(line, F.lit(",")), "row").otherwise("paragraph").alias("kind"),
            i.alias("pos"),
            line.alias("text"),
            F.split(line, ",").alias("cells"),
        ),
    )
    rows = documents(spark, sf_dir).select("doc_id", blocks.alias("blocks"))
    return rows.select("doc_id", ex.blocks_text(F.col("blocks")).alias("text"))


@query(
    "agg13_page_facts",
    f"""SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS page_count, contains(text, ',') AS has_images,
  contains(text, '|') AS has_tables FROM documents""",
)
def agg13(spark, sf_dir):
    rows = _document_pages(spark, sf_dir)
    return rows.select("doc_id", ex.page_facts(F.col("pages")).alias("f")).select("doc_id", "f.*")


_HOST = "regexp_extract(url, '//([^/:?#]+)', 1)"


@query(
    "agg13_page_rollup",
    f"""SELECT {_HOST} AS document_id, count(*) AS page_count, bool_or(contains(html, '<b>')) AS has_images,
  bool_or(contains(html, '<br')) AS has_tables FROM pages GROUP BY 1""",
)
def agg13_rollup(spark, sf_dir):
    # Web pages by host; bold runs and line breaks stand for figures and tables.
    pages = table(spark, sf_dir, "pages").selectExpr(
        f"{_HOST} AS document_id",
        "regexp_count(html, '<b>') AS n_images",
        "regexp_count(html, '<br') AS n_tables",
    )
    return ex.rollup_pages(pages)


@query(
    "agg14_mean_confidence",
    """SELECT vec_id, round(list_avg(list_transform(embedding[2:], lambda x: CAST(x AS DOUBLE))), 6) AS ocr_confidence,
  CASE WHEN len(embedding) > 1 THEN 'google_vision' ELSE 'ocr' END AS extraction_method FROM embeddings""",
)
def agg14(spark, sf_dir):
    # Vector components stand for the confidences of the annotations.
    annotations = F.transform(
        "embedding",
        lambda x: F.struct(F.lit("word").alias("text"), x.cast("double").alias("confidence")),
    )
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", ex.annotation_confidence(annotations).alias("ocr_confidence")
    )
    out = rows.withColumn("extraction_method", ex.image_method(F.col("ocr_confidence")))
    return rounded(out, "ocr_confidence")


@query(
    "fn15_document_facts",
    f"""SELECT doc_id, file_type, size_bytes, extraction_method,
  CASE file_type WHEN 'pdf' THEN CAST(len({_LINES}) AS BIGINT) WHEN 'image' THEN 1 END AS page_count,
  CASE file_type WHEN 'image' THEN true WHEN 'text' THEN false ELSE contains(text, ',') END AS has_images,
  CASE WHEN file_type IN ('image', 'text') THEN false ELSE contains(text, '|') END AS has_tables,
  CASE WHEN file_type = 'image' THEN c END AS ocr_confidence,
  CASE extraction_method WHEN 'ocr' THEN 'Document processed using OCR'
    WHEN 'google_vision' THEN 'Document processed using Google Cloud Vision' ELSE '' END AS processing_notes
FROM (SELECT *, CASE WHEN file_type = 'image' THEN CASE WHEN c IS NULL THEN 'ocr' ELSE 'google_vision' END
    WHEN file_type = 'pdf' THEN 'pdfplumber' WHEN file_type IN ('doc', 'docx') THEN 'python-docx' END AS extraction_method
  FROM (SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS size_bytes,
    CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx' WHEN 3 THEN 'image' ELSE 'text' END AS file_type,
    CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END AS c FROM documents) a) b""",
)
def fn15(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.expr(
            "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx'"
            " WHEN 3 THEN 'image' ELSE 'text' END"
        ).alias("kind"),
        F.octet_length("text").cast("bigint").alias("size"),
        _pages(F.split("text", "\n")).alias("pages"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END").alias("c"),
    )
    facts = ex.document_facts(F.col("kind"), F.col("size"), F.col("pages"), F.col("c"))
    out = rows.select("doc_id", facts.alias("f")).select("doc_id", "f.*")
    return out.withColumn("processing_notes", F.array_join("processing_notes", "|")).drop(
        "language_detected"
    )
