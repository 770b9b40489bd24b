"""Storage reports, joins between the tables, and keyed changes."""

from pyspark.sql import functions as F

from clauselight import schemas
from clauselight.catalog import query, rounded, storage_check
from clauselight.functions import report
from clauselight.operators import keyed, storage
from clauselight.session import new_path
from clauselight.sinks.keyed_table import KeyedTable
from clauselight.sources.adapters import (
    METADATA_SQL,
    RESULTS_SQL,
    USAGE_SQL,
    document_metadata,
    processing_results,
    table,
    usage_analytics,
)

UNKNOWN = "unknown-document"


@query(
    "agg7_storage_statistics",
    storage_check("""
SELECT count(*) AS total_documents, CAST(sum(file_size) AS BIGINT) AS total_size_bytes,
  round(avg(file_size), 6) AS average_file_size_bytes, count(DISTINCT user_id) AS unique_users
FROM document_metadata"""),
)
def agg7(spark, sf_dir):
    out = storage.storage_statistics(document_metadata(spark, sf_dir))
    return rounded(out, "average_file_size_bytes")


@query(
    "agg8_processing_by_file_type",
    storage_check("""
SELECT m.file_type, count(*) AS document_count, round(avg(r.confidence_score), 6) AS avg_confidence,
  round(avg(r.word_count_original), 6) AS avg_original_words,
  round(avg(r.word_count_simplified), 6) AS avg_simplified_words
FROM processing_results r LEFT JOIN document_metadata m USING (document_id)
GROUP BY m.file_type"""),
)
def agg8(spark, sf_dir):
    out = storage.processing_by_file_type(
        processing_results(spark, sf_dir), document_metadata(spark, sf_dir)
    )
    return rounded(out, "avg_confidence", "avg_original_words", "avg_simplified_words")


@query(
    "agg9_daily_processing",
    storage_check("""
SELECT CAST(CAST(processing_timestamp AS DATE) AS VARCHAR) AS date, count(*) AS documents_processed,
  round(avg(processing_time_seconds), 6) AS avg_processing_time
FROM processing_results GROUP BY 1 ORDER BY date DESC"""),
)
def agg9(spark, sf_dir):
    out = rounded(storage.daily_processing(processing_results(spark, sf_dir)), "avg_processing_time")
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "agg10_user_uploads",
    storage_check("""
SELECT user_id, count(*) AS documents_uploaded, CAST(sum(file_size) AS BIGINT) AS total_size_bytes
FROM document_metadata WHERE user_id IS NOT NULL
GROUP BY user_id ORDER BY documents_uploaded DESC, user_id"""),
)
def agg10(spark, sf_dir):
    return storage.user_uploads(document_metadata(spark, sf_dir))


@query(
    "flt5_owned_documents",
    storage_check("SELECT document_id, user_id, file_size FROM document_metadata WHERE user_id IS NOT NULL"),
)
def flt5(spark, sf_dir):
    owned = storage.owned(document_metadata(spark, sf_dir))
    return owned.select("document_id", "user_id", "file_size")


@query(
    "fn21_confidence_percent",
    storage_check("""
SELECT document_id, CAST(floor(confidence_score * 100 + 0.5) AS BIGINT) AS confidence_percent,
  CAST(CASE WHEN word_count_original > 0 THEN
    floor((1 - word_count_simplified / word_count_original) * 100 + 0.5) END AS BIGINT) AS reduction_percent
FROM processing_results"""),
)
def fn21(spark, sf_dir):
    return processing_results(spark, sf_dir).select(
        "document_id",
        report.confidence_percent(F.col("confidence_score")).alias("confidence_percent"),
        report.reduction_percent(
            F.col("word_count_original"), F.col("word_count_simplified")
        ).alias("reduction_percent"),
    )


@query(
    "jn1_results_with_metadata",
    storage_check("""
SELECT r.document_id, r.processing_timestamp, r.simplification_level, r.confidence_score,
  r.word_count_original, r.word_count_simplified, m.extraction_method, m.language_detected, m.file_type
FROM processing_results r LEFT JOIN document_metadata m USING (document_id)"""),
)
def jn1(spark, sf_dir):
    out = storage.results_with_metadata(
        processing_results(spark, sf_dir), document_metadata(spark, sf_dir)
    )
    return out.select(
        "document_id", "processing_timestamp", "simplification_level", "confidence_score",
        "word_count_original", "word_count_simplified", "extraction_method",
        "language_detected", "file_type",
    )


def _unfilled(results):
    """Results as the writer stores them: keyed like events, time not filled."""
    return results.withColumns(
        {
            "document_id": F.concat(F.lit("doc-"), "document_id"),
            "processing_time_seconds": F.lit(None).cast("double"),
        }
    )


@query(
    "jn6_results_with_processing_time",
    f"""WITH usage_analytics AS ({USAGE_SQL}), processing_results AS ({RESULTS_SQL}),
latest AS (
  SELECT document_id, processing_time FROM (
    SELECT document_id, processing_time, row_number() OVER (
      PARTITION BY document_id ORDER BY timestamp DESC, processing_time DESC NULLS LAST) AS rn
    FROM usage_analytics WHERE action = 'document_processing') t WHERE rn = 1)
SELECT 'doc-' || r.document_id AS document_id, r.processing_timestamp,
  l.processing_time AS processing_time_seconds
FROM processing_results r LEFT JOIN latest l ON l.document_id = 'doc-' || r.document_id""",
)
def jn6(spark, sf_dir):
    results = _unfilled(processing_results(spark, sf_dir))
    out = storage.results_with_processing_time(results, usage_analytics(spark, sf_dir))
    return out.select("document_id", "processing_timestamp", "processing_time_seconds")


@query(
    "srt1_latest_documents_per_user",
    storage_check("""
SELECT * FROM (
  SELECT document_id, filename, status, user_id, upload_timestamp, row_number() OVER (
    PARTITION BY user_id ORDER BY upload_timestamp DESC, document_id) AS rank
  FROM document_metadata WHERE user_id IS NOT NULL) t WHERE rank <= 50"""),
)
def srt1(spark, sf_dir):
    out = keyed.latest_documents(document_metadata(spark, sf_dir), limit=50)
    return out.select(
        "document_id", "filename", "status", "user_id", "upload_timestamp",
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "srt1_latest_documents_of_one_user",
    storage_check("""
SELECT document_id, filename, file_type, file_size, upload_timestamp, processing_timestamp, status,
  user_id, extraction_method, ocr_confidence, language_detected, storage_path, processed_path
FROM document_metadata WHERE user_id = 'user_1'
ORDER BY upload_timestamp DESC, document_id LIMIT 50"""),
)
def srt1_one(spark, sf_dir):
    return keyed.latest_documents(document_metadata(spark, sf_dir), "user_1", 50)


def _history(spark, sf_dir):
    """Metadata with its past: every document as uploaded, then as it is now."""
    current = document_metadata(spark, sf_dir)
    uploaded = current.withColumns(
        {
            "status": F.lit("uploaded"),
            "processing_timestamp": F.lit(None).cast("timestamp"),
        }
    )
    return uploaded.unionByName(current)


@query(
    "srt3_current_metadata",
    storage_check("""
SELECT document_id, filename, file_type, file_size, upload_timestamp, processing_timestamp, status,
  user_id, extraction_method, ocr_confidence, language_detected, storage_path, processed_path
FROM document_metadata"""),
)
def srt3(spark, sf_dir):
    return keyed.latest_metadata(_history(spark, sf_dir))


# Documents waiting to be processed are taken up; one id is not in the table.
_CHANGES = f"""
SELECT document_id, 'processing' AS status, CAST(NULL AS TIMESTAMP) AS processing_timestamp,
  CAST(NULL AS STRING) AS extraction_method, 'en' AS language_detected
FROM document_metadata WHERE status = 'uploaded'
UNION ALL SELECT '{UNKNOWN}', 'processing', NULL, NULL, NULL"""


def _changes(metadata):
    waiting = metadata.filter("status = 'uploaded'").selectExpr(
        "document_id",
        "'processing' AS status",
        "CAST(NULL AS TIMESTAMP) AS processing_timestamp",
        "CAST(NULL AS STRING) AS extraction_method",
        "'en' AS language_detected",
    )
    stray = metadata.sparkSession.sql(
        f"SELECT '{UNKNOWN}' AS document_id, 'processing' AS status,"
        " CAST(NULL AS TIMESTAMP) AS processing_timestamp,"
        " CAST(NULL AS STRING) AS extraction_method, CAST(NULL AS STRING) AS language_detected"
    )
    return waiting.unionByName(stray)


_UPDATED_SQL = (
    f"""WITH document_metadata AS ({METADATA_SQL}), changes AS ({_CHANGES})
SELECT m.document_id, m.filename, m.file_size,
  CASE WHEN c.document_id IS NULL THEN m.processing_timestamp ELSE c.processing_timestamp END AS processing_timestamp,
  CASE WHEN c.document_id IS NULL THEN m.status ELSE c.status END AS status,
  CASE WHEN c.document_id IS NULL THEN m.extraction_method ELSE c.extraction_method END AS extraction_method,
  CASE WHEN c.document_id IS NULL THEN m.language_detected ELSE c.language_detected END AS language_detected,
  m.ocr_confidence
FROM document_metadata m LEFT JOIN changes c ON c.document_id = m.document_id"""
)


@query("snk5_update_metadata", _UPDATED_SQL)
def snk5(spark, sf_dir):
    metadata = document_metadata(spark, sf_dir)
    out = keyed.update_metadata(metadata, _changes(metadata))
    return out.select(
        "document_id", "filename", "file_size", "processing_timestamp", "status",
        "extraction_method", "language_detected", "ocr_confidence",
    )


def delete_set(spark, sf_dir):
    """Documents labelled toxic, and one id that is not in the table."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    return toxic.selectExpr("CAST(doc_id AS STRING) AS document_id").unionByName(
        spark.sql(f"SELECT '{UNKNOWN}' AS document_id")
    )


@query(
    "snk6_delete_documents",
    storage_check("""
SELECT document_id, filename, file_size, status FROM document_metadata
WHERE document_id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels WHERE toxic = 1)"""),
)
def snk6(spark, sf_dir):
    out = keyed.delete_documents(document_metadata(spark, sf_dir), delete_set(spark, sf_dir))
    return out.select("document_id", "filename", "file_size", "status")


@query(
    "snk5_snk6_table_in_parts",
    f"""SELECT * FROM ({_UPDATED_SQL}) u
WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
)
def snk5_parts(spark, sf_dir):
    metadata = document_metadata(spark, sf_dir)
    kept = KeyedTable(new_path(spark, "metadata-parts"), schemas.DOCUMENT_METADATA, parts=32)
    kept.create(metadata)
    kept.update(_changes(metadata))
    kept.delete(delete_set(spark, sf_dir))
    return kept.read(spark).select(
        "document_id", "filename", "file_size", "processing_timestamp", "status",
        "extraction_method", "language_detected", "ocr_confidence",
    )
