"""Table schemas and fixed vocabularies. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "BINARY": T.BinaryType(),
    "STRINGS": T.ArrayType(T.StringType()),
    "TERMS": T.MapType(T.StringType(), T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """Columns as ``name TYPE [NOT NULL]``; no session is needed to read them."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


USAGE_ANALYTICS = _struct(
    "document_id STRING NOT NULL, user_id STRING, action STRING NOT NULL,"
    " timestamp TIMESTAMP NOT NULL, metadata STRING, processing_time DOUBLE,"
    " file_size BIGINT, simplification_level STRING, confidence_score DOUBLE,"
    " user_feedback STRING"
)

# The same table as the event sink lays it out, one folder per day.
PARTITIONED_USAGE = T.StructType(
    [*USAGE_ANALYTICS.fields, T.StructField("event_date", T.DateType())]
)

# What the stream of raw events found out about a row.
VERDICT = _struct("reject_reason STRING, accepted BOOLEAN")

DOCUMENT_METADATA = _struct(
    "document_id STRING NOT NULL, filename STRING NOT NULL, file_type STRING NOT NULL,"
    " file_size BIGINT NOT NULL, upload_timestamp TIMESTAMP NOT NULL,"
    " processing_timestamp TIMESTAMP, status STRING NOT NULL, user_id STRING,"
    " extraction_method STRING, ocr_confidence DOUBLE, language_detected STRING,"
    " storage_path STRING NOT NULL, processed_path STRING"
)

PROCESSING_RESULTS = _struct(
    "document_id STRING NOT NULL, processing_timestamp TIMESTAMP NOT NULL,"
    " simplification_level STRING NOT NULL, confidence_score DOUBLE NOT NULL,"
    " word_count_original BIGINT NOT NULL, word_count_simplified BIGINT NOT NULL,"
    " reading_level STRING NOT NULL, processing_time_seconds DOUBLE,"
    " extraction_method STRING, language_detected STRING, has_warnings BOOLEAN NOT NULL,"
    " has_deadlines BOOLEAN NOT NULL, key_points_count BIGINT NOT NULL,"
    " important_terms_count BIGINT NOT NULL"
)

SIMPLIFIED_DOCUMENTS = _struct(
    "document_id STRING, original_filename STRING, summary STRING,"
    " key_points STRINGS, important_terms TERMS,"
    " deadlines_obligations STRINGS, warnings STRINGS,"
    " next_steps STRINGS, processing_timestamp TIMESTAMP,"
    " simplification_level STRING, confidence_score DOUBLE, original_text STRING,"
    " word_count_original BIGINT, word_count_simplified BIGINT, reading_level STRING"
)

RAW_UPLOADS = _struct(
    "document_id STRING NOT NULL, filename STRING NOT NULL, content_type STRING NOT NULL,"
    " storage_path STRING NOT NULL, content BINARY"
)

TABLES = {
    "usage_analytics": USAGE_ANALYTICS,
    "document_metadata": DOCUMENT_METADATA,
    "processing_results": PROCESSING_RESULTS,
}

# Fixed vocabularies.
DOCUMENT_TYPES = ("pdf", "doc", "docx", "image", "text")
STATUSES = ("uploaded", "processing", "completed", "failed")
LEVELS = ("basic", "standard", "detailed")
AUDIENCES = ("general_public", "business_owners", "individuals", "students")
SYSTEM_DOCUMENT = "system"
UPLOAD_FOLDER = "uploads"
PROCESSED_FOLDER = "processed"


def columns(schema: T.StructType) -> list[str]:
    return schema.fieldNames()
