"""Views of the sample tables in the engine's own schemas.

Each view is a list of select expressions written in SQL that Spark and DuckDB
read alike, so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


EVENT_KEY = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k"

USAGE_EXPRS = [
    "'doc-' || CAST(k AS STRING) AS document_id",
    "CAST(user_id AS STRING) AS user_id",
    "CASE event_type WHEN 'signup' THEN 'document_upload' WHEN 'click' THEN 'document_processing'"
    " WHEN 'view' THEN 'document_view' WHEN 'error' THEN 'document_deletion'"
    " ELSE 'user_feedback' END AS action",
    "ts AS timestamp",
    "CASE WHEN event_type <> 'signup' THEN props"
    " WHEN k % 11 = 0 THEN '{\"file_size\":' || CAST(1000 + k * 37 AS STRING) || '}'"
    " ELSE '{\"file_type\":\"' || CASE k % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx'"
    " WHEN 3 THEN 'image' ELSE 'text' END || '\",\"file_size\":' || CAST(1000 + k * 37 AS STRING) || '}'"
    " END AS metadata",
    "CASE WHEN event_type = 'click' THEN value END AS processing_time",
    "CASE WHEN event_type = 'signup' THEN CAST(1000 + k * 37 AS BIGINT) END AS file_size",
    "CASE WHEN event_type = 'click' AND k % 10 <> 0 THEN CASE k % 3 WHEN 0 THEN 'basic'"
    " WHEN 1 THEN 'standard' ELSE 'detailed' END END AS simplification_level",
    "CASE WHEN event_type = 'click' THEN CAST(k AS DOUBLE) / 100 END AS confidence_score",
    "CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'rated ' || CAST(k AS STRING) END AS user_feedback",
]

STATUS = (
    "CASE WHEN doc_id % 10 = 9 THEN 'failed' WHEN doc_id % 10 = 8 THEN 'uploaded' ELSE 'completed' END"
)

METADATA_EXPRS = [
    "CAST(doc_id AS STRING) AS document_id",
    "'doc_' || CAST(doc_id AS STRING) || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc'"
    " WHEN 2 THEN 'DOCX' WHEN 3 THEN 'png' ELSE 'txt' END AS filename",
    "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx' WHEN 3 THEN 'image'"
    " ELSE 'text' END AS file_type",
    "n_chars AS file_size",
    "CAST('2024-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' MINUTE AS upload_timestamp",
    "CASE WHEN doc_id % 10 < 8 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '2' MINUTE"
    " END AS processing_timestamp",
    f"{STATUS} AS status",
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'user_' || CAST(doc_id % 50 AS STRING) END AS user_id",
    "CASE doc_id % 5 WHEN 0 THEN 'pdfplumber' WHEN 1 THEN 'python-docx' WHEN 2 THEN 'python-docx'"
    " WHEN 3 THEN 'ocr' END AS extraction_method",
    "CASE WHEN doc_id % 5 = 3 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END AS ocr_confidence",
    "lang AS language_detected",
    "'uploads/' || CAST(doc_id AS STRING) || '/doc_' || CAST(doc_id AS STRING) AS storage_path",
    "CAST(NULL AS STRING) AS processed_path",
]

# Only completed documents have results.
RESULTS_FILTER = f"{STATUS} = 'completed'"
RESULTS_EXPRS = [
    "CAST(doc_id AS STRING) AS document_id",
    "CAST('2024-01-02 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '2' MINUTE AS processing_timestamp",
    "CASE doc_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'standard' ELSE 'detailed' END AS simplification_level",
    "CAST(50 + doc_id % 51 AS DOUBLE) / 100 AS confidence_score",
    "CAST(floor(n_chars / 6.0) AS BIGINT) AS word_count_original",
    "CAST(floor(n_chars / 20.0) AS BIGINT) AS word_count_simplified",
    "CASE doc_id % 4 WHEN 0 THEN 'elementary' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'high_school'"
    " ELSE 'college' END AS reading_level",
    "CAST(doc_id % 60 AS DOUBLE) AS processing_time_seconds",
    "CAST(NULL AS STRING) AS extraction_method",
    "CAST(NULL AS STRING) AS language_detected",
    "doc_id % 2 = 0 AS has_warnings",
    "doc_id % 3 = 0 AS has_deadlines",
    "CAST(doc_id % 6 AS BIGINT) AS key_points_count",
    "CAST(doc_id % 4 AS BIGINT) AS important_terms_count",
]


def _select(exprs: list[str]) -> str:
    return ",\n       ".join(exprs)


# The same views as text, for the checks.
USAGE_SQL = f"SELECT {_select(USAGE_EXPRS)}\nFROM (SELECT *, {EVENT_KEY} FROM events) b"
METADATA_SQL = f"SELECT {_select(METADATA_EXPRS)}\nFROM documents"
RESULTS_SQL = f"SELECT {_select(RESULTS_EXPRS)}\nFROM documents WHERE {RESULTS_FILTER}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_from_events(table(spark, sf_dir, "events"))


def usage_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr("*", EVENT_KEY).selectExpr(*USAGE_EXPRS)


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*METADATA_EXPRS)


def processing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(RESULTS_FILTER).selectExpr(*RESULTS_EXPRS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table for work that costs far more than reading it."""
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(
        "CAST(doc_id AS STRING) AS document_id", "text", "lang", "source"
    )
