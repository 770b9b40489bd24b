"""The streaming jobs, run to the end of the tables that are there."""

from pyspark.sql import functions as F

from clauselight.catalog import query, rounded, usage_check
from clauselight.catalog.events import _RAW, _RAW_SQL, _WRAPPED
from clauselight.catalog.usage import QUOTA, _typed
from clauselight.session import new_path
from clauselight.sources.adapters import table, usage_from_events
from clauselight.streaming import queries as streams


def _events(spark, sf_dir):
    """The event table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern, since a stream takes a single file only by pattern.
    return streams.read_stream(spark, f"{sf_dir}/events.parque[t]", schema)


def _raw_batches(spark, sf_dir):
    raw = _events(spark, sf_dir).selectExpr(*_RAW)
    path, state = new_path(spark, "events"), new_path(spark, "state")
    streams.finish(streams.ingest_events(raw, path, state, available_now=True))
    return path


def _arrivals(spark, sf_dir, parts=4):
    """The events in a folder as they arrive in several parts, the oldest last.

    Yields a stream over the folder after each arrival.
    """
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    part = F.width_bucket(at, F.lit(low or 0), F.lit((high or 0) + 1), F.lit(parts))
    landing = new_path(spark, "landing")
    for number in [*range(2, parts + 1), 1]:
        events.filter(part == number).write.mode("append").parquet(landing)
        yield streams.read_stream(spark, landing, events.schema)


def _usage_of(events):
    return usage_from_events(events).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@query(
    "str1_streamed_events",
    f"""SELECT document_id, user_id, action, CAST(timestamp AS TIMESTAMP) AS timestamp, {_WRAPPED} AS metadata,
  CAST(processing_time AS DOUBLE) AS processing_time, CAST(file_size AS BIGINT) AS file_size
FROM ({_RAW_SQL}) r WHERE document_id IS NOT NULL AND TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL
  AND TRY_CAST(processing_time AS DOUBLE) IS NOT NULL AND TRY_CAST(file_size AS BIGINT) IS NOT NULL""",
)
def str1(spark, sf_dir):
    rows = streams.ingested(spark, _raw_batches(spark, sf_dir))
    return rows.select(
        "document_id", "user_id", "action", "timestamp", "metadata", "processing_time", "file_size"
    )


@query(
    "str1_rejected_events",
    f"""SELECT document_id, user_id, CASE WHEN document_id IS NULL THEN 'missing_document_id'
    WHEN TRY_CAST(timestamp AS TIMESTAMP) IS NULL THEN 'invalid_timestamp'
    WHEN TRY_CAST(processing_time AS DOUBLE) IS NULL THEN 'invalid_processing_time'
    ELSE 'invalid_file_size' END AS reject_reason
FROM ({_RAW_SQL}) r WHERE document_id IS NULL OR TRY_CAST(timestamp AS TIMESTAMP) IS NULL
  OR TRY_CAST(processing_time AS DOUBLE) IS NULL OR TRY_CAST(file_size AS BIGINT) IS NULL""",
)
def str1_rejected(spark, sf_dir):
    rows = streams.rejected(spark, _raw_batches(spark, sf_dir))
    return rows.select("document_id", "user_id", "reject_reason")


_DAILY = usage_check(_typed("""
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS daily_actions,
  count(DISTINCT document_id) AS daily_documents, count(DISTINCT user_id) AS daily_users,
  round(avg(processing_time), 6) AS average_processing_time,
  round(avg(confidence_score), 6) AS average_confidence_score,
  count_if(processing_time > 30) AS slow_processing_count,
  count_if(confidence_score < 0.7) AS low_confidence_count
FROM usage_analytics GROUP BY 1"""))


def _logged_daily(spark, path):
    out = streams.daily_metrics(spark, path)
    out = rounded(out, "average_processing_time", "average_confidence_score")
    return out.withColumn("date", F.col("date").cast("string"))


@query("str2_streamed_daily_metrics", _DAILY)
def str2(spark, sf_dir):
    path, state = new_path(spark, "daily"), new_path(spark, "state")
    events = _usage_of(_events(spark, sf_dir))
    streams.finish(streams.log_daily(events, path, state, available_now=True))
    return _logged_daily(spark, path)


@query("str2_late_daily_metrics", _DAILY)
def str2_late(spark, sf_dir):
    path, state = new_path(spark, "daily"), new_path(spark, "state")
    for events in _arrivals(spark, sf_dir):
        streams.finish(streams.log_daily(_usage_of(events), path, state, available_now=True))
    return _logged_daily(spark, path)


# Each event moves its document on: the status follows from the kind of event.
_STATUS = (
    "CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'processing'"
    " WHEN 'error' THEN 'failed' ELSE 'completed' END AS status"
)


@query(
    "str3_current_status",
    f"""SELECT document_id, status, timestamp FROM (
  SELECT CAST(user_id AS VARCHAR) AS document_id, {_STATUS}, ts AS timestamp,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
      CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 4 ELSE 3 END DESC) AS rn
  FROM events) t WHERE rn = 1""",
)
def str3(spark, sf_dir):
    changes = _events(spark, sf_dir).selectExpr(
        "CAST(user_id AS STRING) AS document_id", _STATUS, "ts AS timestamp"
    )
    path, state = new_path(spark, "status"), new_path(spark, "state")
    streams.finish(streams.status_changes(changes, path, state, available_now=True))
    return streams.current_status(spark.read.parquet(path))


_STAGE = "CASE status WHEN 'uploaded' THEN 1 WHEN 'processing' THEN 2 WHEN 'completed' THEN 3 ELSE 4 END"


@query(
    "str3_status_steps",
    f"""SELECT document_id, previous, status, timestamp, coalesce(CASE coalesce(previous, 'none') WHEN 'none' THEN status = 'uploaded'
    WHEN 'uploaded' THEN status IN ('processing', 'failed') WHEN 'processing' THEN status IN ('completed', 'failed')
    ELSE status = 'processing' END, FALSE) AS allowed
FROM (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY timestamp, {_STAGE}) AS previous
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS document_id, {_STATUS}, ts AS timestamp FROM events) d) s""",
)
def str3_steps(spark, sf_dir):
    path, state = new_path(spark, "status"), new_path(spark, "state")
    for events in _arrivals(spark, sf_dir):
        changes = events.selectExpr("CAST(user_id AS STRING) AS document_id", _STATUS, "ts AS timestamp")
        streams.finish(streams.status_changes(changes, path, state, available_now=True))
    return streams.status_steps(spark.read.parquet(path))


_OVER = usage_check(f"""
SELECT user_id, date_trunc('hour', timestamp) AS window_start, count(*) AS requests
FROM usage_analytics WHERE user_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > {QUOTA}""")


@query("str4_streamed_quota_violations", _OVER)
def str4(spark, sf_dir):
    path, state = new_path(spark, "quota"), new_path(spark, "state")
    events = _usage_of(_events(spark, sf_dir))
    streams.finish(streams.log_quota(events, path, state, limit=QUOTA, available_now=True))
    out = streams.quota_violations(spark, path, limit=QUOTA)
    return out.select("user_id", "window_start", "requests")


@query("str4_late_quota_alerts", f"SELECT *, CAST(1 AS BIGINT) AS alerts FROM ({_OVER}) o")
def str4_late(spark, sf_dir):
    path, state = new_path(spark, "quota"), new_path(spark, "state")
    for events in _arrivals(spark, sf_dir):
        streams.finish(streams.log_quota(_usage_of(events), path, state, limit=QUOTA, available_now=True))
    alerts = streams.quota_alerts(spark, path).groupBy("user_id", "window_start").agg(F.count("*").alias("alerts"))
    out = streams.quota_violations(spark, path, limit=QUOTA).join(alerts, ["user_id", "window_start"], "left")
    return out.select("user_id", "window_start", "requests", "alerts")
