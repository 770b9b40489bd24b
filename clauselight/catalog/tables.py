"""Table scans, and writers followed by a read of what they wrote."""

from uuid import uuid4

from pyspark.sql import functions as F

from clauselight.catalog import query, storage_check, usage_check
from clauselight.catalog.responses import _SIMPLIFIED_SQL, REPORT_SQL, simplified
from clauselight.session import new_path
from clauselight.sinks import tables as sinks
from clauselight.sources import tables as sources
from clauselight.sources.adapters import (
    METADATA_SQL,
    RESULTS_SQL,
    USAGE_SQL,
    document_metadata,
    documents,
    processing_results,
    usage_analytics,
)


@query("src1_usage_scan", USAGE_SQL)
def src1(spark, sf_dir):
    return usage_analytics(spark, sf_dir)


@query("src2_metadata_scan", METADATA_SQL)
def src2(spark, sf_dir):
    return document_metadata(spark, sf_dir)


@query("src3_results_scan", RESULTS_SQL)
def src3(spark, sf_dir):
    return processing_results(spark, sf_dir)


@query(
    "src6_preview",
    usage_check("SELECT document_id, action, timestamp FROM usage_analytics ORDER BY timestamp, document_id LIMIT 10"),
)
def src6(spark, sf_dir):
    ordered = usage_analytics(spark, sf_dir).orderBy("timestamp", "document_id")
    return sources.preview(ordered.select("document_id", "action", "timestamp"))


@query(
    "snk1_appended_events",
    usage_check("SELECT *, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date FROM usage_analytics"),
)
def snk1(spark, sf_dir):
    path = new_path(spark, "usage_analytics")
    sinks.append_events(usage_analytics(spark, sf_dir), path)
    return sources.partitioned_usage(spark, path).withColumn(
        "event_date", F.col("event_date").cast("string")
    )


@query("snk2_appended_metadata", storage_check("SELECT * FROM document_metadata"))
def snk2(spark, sf_dir):
    path = new_path(spark, "document_metadata")
    sinks.append_metadata(document_metadata(spark, sf_dir), path)
    return sources.document_metadata(spark, path)


@query("snk3_appended_results", storage_check("SELECT * FROM processing_results"))
def snk3(spark, sf_dir):
    path = new_path(spark, "processing_results")
    sinks.append_results(processing_results(spark, sf_dir), path)
    return sources.processing_results(spark, path)


@query(
    "src5_snk4_simplified_json",
    _SIMPLIFIED_SQL
    + """SELECT CAST(doc_id AS VARCHAR) AS document_id, summary, array_to_string(key_points, '|') AS key_points,
  terms, confidence_score, CAST(word_count_original AS BIGINT) AS word_count_original,
  total_words AS word_count_simplified, reading_level FROM measured""",
)
def snk4(spark, sf_dir):
    path = new_path(spark, "simplified")
    sinks.write_simplified(simplified(spark, sf_dir), path)
    from clauselight.catalog.responses import _flat_terms

    return sources.simplified_documents(spark, path).select(
        "document_id", "summary", F.array_join("key_points", "|").alias("key_points"),
        _flat_terms(), "confidence_score", "word_count_original", "word_count_simplified",
        "reading_level",
    )


@query("snk8_exported_events", USAGE_SQL)
def snk8(spark, sf_dir):
    path = new_path(spark, "export")
    events = sinks.conform(usage_analytics(spark, sf_dir), "usage_analytics")
    sinks.export_json(events, path)
    return sources.usage_analytics(spark, path, "json")


_STORED = "'uploads/' || CAST(doc_id AS STRING) || '/doc_' || CAST(doc_id AS STRING)"


@query(
    "snk10_landed_uploads",
    f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, {_STORED} AS storage_path,
  CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents""",
)
def snk10(spark, sf_dir):
    raw = _landed(spark, sf_dir, keep="true")
    return raw.select(
        "document_id", "storage_path", F.octet_length("content").cast("bigint").alias("size_bytes")
    )


def _landed(spark, sf_dir, keep):
    uploads = documents(spark, sf_dir).filter(keep).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"),
        F.lit("text/plain").alias("content_type"),
        F.expr(_STORED).alias("storage_path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    path = new_path(spark, "uploads")
    sinks.write_uploads(uploads, path)
    return sources.raw_uploads(spark, path)


def _landed_files(spark, sf_dir):
    uploads = documents(spark, sf_dir).select(
        F.expr(_STORED).alias("storage_path"), F.encode("text", "UTF-8").alias("content")
    )
    path = new_path(spark, "upload-files")
    sinks.write_uploads(uploads, path, per_document=True)
    return path


@query(
    "src4_landed_files",
    f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, {_STORED} AS storage_path, CAST(strlen(text) AS BIGINT) AS length,
  sha256(text) AS sha256 FROM documents WHERE text <> ''""",
)
def src4_files(spark, sf_dir):
    # Spark lists no empty files.
    files = sources.raw_files(spark, _landed_files(spark, sf_dir))
    return files.select("document_id", "storage_path", "length", F.sha2("content", 256).alias("sha256"))


@query(
    "src4_listed_files",
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(strlen(text) AS BIGINT) AS length
FROM documents WHERE doc_id % 10 = 7 AND text <> ''""",
)
def src4_listing(spark, sf_dir):
    files = sources.raw_files(spark, _landed_files(spark, sf_dir), names="doc_*7", content=False)
    return files.select("document_id", "length")


@query(
    "snk9_report_files",
    REPORT_SQL,
)
def snk9(spark, sf_dir):
    path = new_path(spark, "reports")
    sinks.write_reports(simplified(spark, sf_dir), path, per_document=True)
    name = F.regexp_extract("path", r"reports/([^/]+)\.md$", 1)
    files = sources.raw_files(spark, path, names="*.md")
    return files.select(
        F.url_decode(name).alias("document_id"), F.decode("content", "UTF-8").alias("markdown")
    )


def _catalog_tables(spark, sf_dir):
    root, prefix = new_path(spark, "catalog"), f"c{uuid4().hex}_"
    for rows in range(2):  # the second time nothing is created anew
        names = sinks.create_catalog_tables(spark, root, prefix)
        if rows == 0:
            sinks.insert_rows(usage_analytics(spark, sf_dir), "usage_analytics", names["usage_analytics"])
            sinks.insert_rows(processing_results(spark, sf_dir), "processing_results", names["processing_results"])
    return names


@query("snk7_catalog_events", USAGE_SQL)
def snk7(spark, sf_dir):
    return spark.table(_catalog_tables(spark, sf_dir)["usage_analytics"]).drop("event_date")


@query("snk7_catalog_results", storage_check("SELECT * FROM processing_results"))
def snk7_results(spark, sf_dir):
    return spark.table(_catalog_tables(spark, sf_dir)["processing_results"])


@query(
    "src4_documents_with_content",
    storage_check("""SELECT m.document_id, CAST(CASE WHEN d.lang = 'de' THEN NULL ELSE strlen(d.text) END AS BIGINT) AS size_bytes
FROM document_metadata m JOIN documents d ON CAST(d.doc_id AS VARCHAR) = m.document_id"""),
)
def src4(spark, sf_dir):
    # German uploads have gone missing from the store.
    raw = _landed(spark, sf_dir, keep="lang <> 'de'")
    out = sources.with_content(document_metadata(spark, sf_dir), raw)
    return out.select("document_id", F.octet_length("content").cast("bigint").alias("size_bytes"))
