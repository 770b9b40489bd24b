"""Event builders, coercion of raw events, and user ids."""

from pyspark.sql import functions as F

from clauselight.catalog import query
from clauselight.functions import events, records
from clauselight.sources.adapters import (
    METADATA_SQL,
    RESULTS_SQL,
    USAGE_SQL,
    document_metadata,
    processing_results,
    table,
    usage_analytics,
)

_COLUMNS = (
    "document_id, user_id, action, timestamp, metadata, processing_time, file_size,"
    " simplification_level, confidence_score, user_feedback"
)
_NULLS = {
    "user_id": "CAST(NULL AS VARCHAR)",
    "metadata": "'{}'",
    "processing_time": "CAST(NULL AS DOUBLE)",
    "file_size": "CAST(NULL AS BIGINT)",
    "simplification_level": "CAST(NULL AS VARCHAR)",
    "confidence_score": "CAST(NULL AS DOUBLE)",
    "user_feedback": "CAST(NULL AS VARCHAR)",
}


def _event(source: str, where: str = "", **values: str) -> str:
    values = {**_NULLS, **values}
    columns = ", ".join(f"{values[c.strip()]} AS {c.strip()}" for c in _COLUMNS.split(","))
    return f"SELECT {columns} FROM {source}{' WHERE ' + where if where else ''}"


_META = f"({METADATA_SQL}) m"
_USAGE = f"({USAGE_SQL}) u"


@query(
    "evt1_upload_events",
    _event(
        _META,
        document_id="document_id",
        user_id="user_id",
        action="'document_upload'",
        timestamp="upload_timestamp",
        metadata="'{\"file_size\":' || CAST(file_size AS VARCHAR) || ',\"file_type\":\"' || file_type || '\"}'",
        file_size="file_size",
    ),
)
def evt1(spark, sf_dir):
    rows = document_metadata(spark, sf_dir)
    return events.uploads(rows.withColumnRenamed("upload_timestamp", "timestamp"))


@query(
    "evt2_processing_events",
    _event(
        f"({RESULTS_SQL}) r",
        document_id="document_id",
        action="'document_processing'",
        timestamp="processing_timestamp",
        metadata="'{\"simplification_level\":\"' || simplification_level"
        " || '\",\"confidence_score\":' || CAST(confidence_score AS VARCHAR) || '}'",
        processing_time="processing_time_seconds",
        simplification_level="simplification_level",
        confidence_score="confidence_score",
    ),
)
def evt2(spark, sf_dir):
    rows = processing_results(spark, sf_dir).withColumnsRenamed(
        {"processing_timestamp": "timestamp", "processing_time_seconds": "processing_time"}
    )
    return events.processing(rows)


def _actions(spark, sf_dir, action):
    return usage_analytics(spark, sf_dir).filter(F.col("action") == action)


@query(
    "evt3_view_events",
    _event(
        _USAGE,
        "action = 'document_view'",
        document_id="document_id",
        user_id="user_id",
        action="'document_view'",
        timestamp="timestamp",
        metadata="'{\"view_duration\":' || CASE WHEN document_id LIKE '%7' THEN 'null' ELSE '1.5' END || '}'",
    ),
)
def evt3(spark, sf_dir):
    duration = F.when(~F.col("document_id").endswith("7"), F.lit(1.5))
    rows = _actions(spark, sf_dir, "document_view").withColumn("view_duration", duration)
    return events.views(rows)


@query(
    "evt4_deletion_events",
    _event(
        _USAGE,
        "action = 'document_deletion'",
        document_id="document_id",
        user_id="user_id",
        action="'document_deletion'",
        timestamp="timestamp",
    ),
)
def evt4(spark, sf_dir):
    return events.deletions(_actions(spark, sf_dir, "document_deletion"))


@query(
    "evt5_feedback_events",
    _event(
        _USAGE,
        "user_feedback IS NOT NULL",
        document_id="document_id",
        user_id="user_id",
        action="'user_feedback'",
        timestamp="timestamp",
        metadata="'{\"rating\":' || CAST(length(user_feedback) - 6 AS VARCHAR) || '}'",
        user_feedback="user_feedback",
    ),
)
def evt5(spark, sf_dir):
    rows = usage_analytics(spark, sf_dir).filter("user_feedback IS NOT NULL")
    rating = F.length("user_feedback") - 6
    return events.feedback(
        rows.withColumns({"rating": rating, "feedback": F.col("user_feedback")})
    )


# Accounts: one per customer, with the order dates standing for their visits.
_EMAIL = "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com'"
_USER = f"'user_' || replace(replace({_EMAIL}, '@', '_'), '.', '_')"
_VISITS = "orders JOIN customer ON c_custkey = o_custkey"


def _visits(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_EMAIL} AS email")
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(
        "email", events.user_id(F.col("email")).alias("user_id"), F.col("o_orderdate").alias("timestamp")
    )


def _account(action: str, metadata: str) -> str:
    return _event(
        _VISITS,
        document_id="'system'",
        user_id=_USER,
        action=f"'{action}'",
        timestamp="o_orderdate",
        metadata=metadata,
    )


_EMAIL_JSON = f"'{{\"email\":\"' || {_EMAIL} || '\"}}'"


@query("evt6_registration_events", _account("user_registration", _EMAIL_JSON))
def evt6(spark, sf_dir):
    return events.registrations(_visits(spark, sf_dir))


@query("evt7_login_events", _account("user_login", _EMAIL_JSON))
def evt7(spark, sf_dir):
    return events.logins(_visits(spark, sf_dir))


@query("evt8_logout_events", _account("user_logout", "'{}'"))
def evt8(spark, sf_dir):
    return events.logouts(_visits(spark, sf_dir))


@query(
    "evt9_question_events",
    _event(
        _USAGE,
        document_id="document_id",
        action="'document_qa'",
        timestamp="timestamp",
        metadata="'{\"question\":\"about ' || action || '?\"}'",
        confidence_score="confidence_score",
    ),
)
def evt9(spark, sf_dir):
    rows = usage_analytics(spark, sf_dir)
    question = F.concat(F.lit("about "), F.col("action"), F.lit("?"))
    return events.questions(rows.withColumn("question", question))


@query(
    "evt10_tracked_events",
    _event(
        _USAGE,
        document_id="document_id",
        user_id="user_id",
        action="action",
        timestamp="timestamp",
        metadata="metadata",
        user_feedback="user_feedback",
    ),
)
def evt10(spark, sf_dir):
    return events.track(usage_analytics(spark, sf_dir))


@query("fn10_user_ids", f"SELECT c_custkey, {_USER} AS user_id FROM customer")
def fn10(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_EMAIL} AS email")
    return rows.select("c_custkey", events.user_id(F.col("email")).alias("user_id"))


# Raw events: everything is text, and some of it is not what it should be.
_RAW = [
    "CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'doc-' || CAST(user_id AS VARCHAR(20)) END AS document_id",
    "CAST(user_id AS VARCHAR(20)) AS user_id",
    "event_type AS action",
    "CASE WHEN event_id % 29 = 0 THEN 'not a time' ELSE CAST(ts AS VARCHAR(40)) END AS timestamp",
    "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN NULL"
    " ELSE props || ' trailing' END AS metadata",
    "CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR(40)) END AS processing_time",
    "CASE WHEN event_id % 19 = 0 THEN 'big' ELSE CAST(event_id AS VARCHAR(20)) END AS file_size",
    "CASE event_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN event_type END AS simplification_level",
    "CAST(event_id % 100 AS VARCHAR(20)) AS confidence_score",
    "CASE WHEN event_id % 5 = 0 THEN props END AS user_feedback",
]
_RAW_SQL = f"SELECT {', '.join(_RAW)} FROM events"
_WRAPPED = (
    "CASE WHEN metadata IS NULL OR json_valid(metadata) THEN metadata"
    " ELSE '{\"value\":' || CAST(to_json(metadata) AS VARCHAR) || '}' END"
)


@query(
    "prj1_coerced_events",
    f"""SELECT document_id, user_id, action, TRY_CAST(timestamp AS TIMESTAMP) AS timestamp,
  {_WRAPPED} AS metadata, TRY_CAST(processing_time AS DOUBLE) AS processing_time,
  TRY_CAST(file_size AS BIGINT) AS file_size, simplification_level,
  TRY_CAST(confidence_score AS DOUBLE) AS confidence_score, user_feedback,
  CASE WHEN document_id IS NULL THEN 'missing_document_id'
    WHEN TRY_CAST(timestamp AS TIMESTAMP) IS NULL THEN 'invalid_timestamp'
    WHEN TRY_CAST(processing_time AS DOUBLE) IS NULL THEN 'invalid_processing_time'
    WHEN TRY_CAST(file_size AS BIGINT) IS NULL THEN 'invalid_file_size' END AS reject_reason
FROM ({_RAW_SQL}) r""",
)
def prj1(spark, sf_dir):
    raw = table(spark, sf_dir, "events").selectExpr(*_RAW)
    return records.coerce_events(raw)


@query(
    "prj2_event_metadata_as_json",
    f"SELECT event_id, {_WRAPPED} AS metadata FROM (SELECT event_id, {_RAW[4]} FROM events) r",
)
def prj2(spark, sf_dir):
    raw = table(spark, sf_dir, "events").selectExpr("event_id", _RAW[4])
    return raw.select("event_id", records.json_metadata(F.col("metadata")).alias("metadata"))


@query(
    "prj3_metadata_rows",
    f"""SELECT document_id, filename, file_type, file_size, upload_timestamp, processing_timestamp,
  status, nullif(coalesce(user_id, ''), '') AS user_id, extraction_method, ocr_confidence,
  nullif(language_detected, '') AS language_detected, storage_path, processed_path
FROM ({METADATA_SQL}) m""",
)
def prj3(spark, sf_dir):
    rows = document_metadata(spark, sf_dir)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("user_id", "extraction_method", "processed_path")}
    return records.metadata_rows(rows.withColumns(blank))
