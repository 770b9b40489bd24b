"""Usage reports, filters and the quota audit."""

from datetime import datetime

from pyspark.sql import functions as F

from clauselight.catalog import query, rounded, usage_check
from clauselight.operators import partials, usage
from clauselight.session import new_path
from clauselight.sources.adapters import usage_analytics

START, END = datetime(2024, 1, 2), datetime(2024, 1, 20)
FIRST, LAST = datetime(2024, 1, 1), datetime(2024, 2, 1)
AS_OF = datetime(2024, 1, 30)
QUOTA = 2

_COUNTS = """count_if(action = 'document_upload') AS uploads,
  count_if(action = 'document_processing') AS processing_events,
  count_if(action = 'document_view') AS views"""


def _typed(sql: str) -> str:
    """Counts as 64-bit integers, whatever the engine returns for count_if."""
    import re

    return re.sub(r"(count_if\((?:[^()]|\([^()]*\))*\))", r"CAST(\1 AS BIGINT)", sql)


@query(
    "agg1_usage_statistics",
    usage_check(_typed(f"""
SELECT TIMESTAMP '{START}' AS period_start, TIMESTAMP '{END}' AS period_end,
  count(*) AS total_actions, count(DISTINCT document_id) AS unique_documents,
  count(DISTINCT user_id) AS unique_users, {_COUNTS},
  count_if(action = 'document_deletion') AS deletions,
  round(avg(processing_time), 6) AS average_processing_time,
  round(avg(confidence_score), 6) AS average_confidence_score,
  count(user_feedback) AS feedback_count
FROM usage_analytics
WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""")),
)
def agg1(spark, sf_dir):
    return _with_period(usage.usage_statistics(usage_analytics(spark, sf_dir), START, END))


def _with_period(out):
    ends = [F.col(f"period.{e}").alias(f"period_{e}") for e in ("start", "end")]
    return rounded(out.select(*ends, "*").drop("period"), "average_processing_time", "average_confidence_score")


EDGE_START, EDGE_END = datetime(2024, 1, 2, 7, 30), datetime(2024, 1, 19, 16, 45)


@query(
    "agg1_period_from_partials",
    usage_check(_typed(f"""
SELECT TIMESTAMP '{EDGE_START}' AS period_start, TIMESTAMP '{EDGE_END}' AS period_end, count(*) AS total_actions,
  count(DISTINCT document_id) AS unique_documents, count(DISTINCT user_id) AS unique_users, {_COUNTS},
  count_if(action = 'document_deletion') AS deletions,
  round(avg(processing_time), 6) AS average_processing_time,
  round(avg(confidence_score), 6) AS average_confidence_score,
  count(user_feedback) AS feedback_count
FROM usage_analytics
WHERE timestamp BETWEEN TIMESTAMP '{EDGE_START}' AND TIMESTAMP '{EDGE_END}'""")),
)
def agg1_partials(spark, sf_dir):
    events = usage_analytics(spark, sf_dir)
    sums, values = (new_path(spark, n) for n in ("day-sums", "day-values"))
    partials.day_sums(events).write.parquet(sums)
    partials.day_values(events).write.parquet(values)
    return _with_period(partials.period_statistics(
        spark.read.schema(partials.SUMS_SCHEMA).parquet(sums),
        spark.read.schema(partials.VALUES_SCHEMA).parquet(values),
        events, EDGE_START, EDGE_END,
    ))


_DOCUMENT = _typed(f"""
SELECT document_id, count(*) AS total_events, count(DISTINCT action) AS unique_actions,
  min(timestamp) AS first_event, max(timestamp) AS last_event, {_COUNTS},
  round(avg(processing_time), 6) AS average_processing_time,
  round(avg(confidence_score), 6) AS average_confidence_score,
  count(user_feedback) AS feedback_count
FROM usage_analytics""")


@query("agg2_document_analytics", usage_check(_DOCUMENT + " GROUP BY document_id"))
def agg2(spark, sf_dir):
    out = usage.document_analytics(usage_analytics(spark, sf_dir))
    return rounded(out, "average_processing_time", "average_confidence_score")


@query(
    "flt2_one_document_analytics",
    usage_check(_DOCUMENT + " WHERE document_id = 'doc-7' GROUP BY document_id"),
)
def flt2(spark, sf_dir):
    out = usage.document_analytics(usage_analytics(spark, sf_dir), "doc-7")
    return rounded(out, "average_processing_time", "average_confidence_score")


@query(
    "agg3_user_analytics",
    usage_check(_typed(f"""
SELECT user_id, count(*) AS total_actions, count(DISTINCT document_id) AS unique_documents,
  min(timestamp) AS first_activity, max(timestamp) AS last_activity, {_COUNTS},
  count_if(action = 'document_deletion') AS deletions,
  round(avg(processing_time), 6) AS average_processing_time,
  count(user_feedback) AS feedback_count
FROM usage_analytics WHERE user_id IS NOT NULL GROUP BY user_id""")),
)
def agg3(spark, sf_dir):
    out = usage.user_analytics(usage_analytics(spark, sf_dir))
    return rounded(out, "average_processing_time")


@query(
    "agg4_daily_performance",
    usage_check(_typed(f"""
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS daily_actions,
  count(DISTINCT document_id) AS daily_documents, count(DISTINCT user_id) AS daily_users,
  round(avg(processing_time), 6) AS average_processing_time,
  round(avg(confidence_score), 6) AS average_confidence_score,
  count_if(processing_time > 30) AS slow_processing_count,
  count_if(confidence_score < 0.7) AS low_confidence_count
FROM usage_analytics
WHERE timestamp BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'
GROUP BY CAST(timestamp AS DATE) ORDER BY date""")),
)
def agg4(spark, sf_dir):
    out = usage.performance_metrics(usage_analytics(spark, sf_dir), FIRST, LAST)
    out = rounded(out, "average_processing_time", "average_confidence_score")
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "agg5_popular_document_types",
    usage_check("""
SELECT json_extract_string(metadata, '$.file_type') AS file_type, count(*) AS count,
  round(avg(TRY_CAST(json_extract_string(metadata, '$.file_size') AS DOUBLE)), 6) AS average_file_size
FROM usage_analytics
WHERE action = 'document_upload' AND json_extract_string(metadata, '$.file_type') IS NOT NULL
GROUP BY 1 ORDER BY count DESC, file_type"""),
)
def agg5(spark, sf_dir):
    out = usage.popular_document_types(usage_analytics(spark, sf_dir))
    return rounded(out, "average_file_size")


@query(
    "agg6_simplification_effectiveness",
    usage_check("""
SELECT simplification_level, count(*) AS count,
  round(avg(confidence_score), 6) AS average_confidence,
  round(avg(processing_time), 6) AS average_processing_time,
  count(user_feedback) AS feedback_count
FROM usage_analytics
WHERE action = 'document_processing' AND simplification_level IS NOT NULL
GROUP BY simplification_level ORDER BY count DESC, simplification_level"""),
)
def agg6(spark, sf_dir):
    out = usage.simplification_effectiveness(usage_analytics(spark, sf_dir))
    return rounded(out, "average_confidence", "average_processing_time")


@query(
    "agg11_recent_requests",
    usage_check(f"""
SELECT count(*) AS total_requests, round(avg(processing_time), 6) AS average_processing_time
FROM usage_analytics WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR"""),
)
def agg11(spark, sf_dir):
    out = usage.recent_requests(usage_analytics(spark, sf_dir), AS_OF)
    return rounded(out, "average_processing_time")


@query(
    "flt1_events_in_period",
    usage_check(f"""
SELECT document_id, user_id, action, timestamp FROM usage_analytics
WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""),
)
def flt1(spark, sf_dir):
    kept = usage.in_period(usage_analytics(spark, sf_dir), START, END)
    return kept.select("document_id", "user_id", "action", "timestamp")


@query(
    "str4_quota_violations",
    usage_check(f"""
SELECT user_id, date_trunc('hour', timestamp) AS window_start,
  date_trunc('hour', timestamp) + INTERVAL '1' HOUR AS window_end, count(*) AS requests
FROM usage_analytics WHERE user_id IS NOT NULL
GROUP BY 1, 2, 3 HAVING count(*) > {QUOTA}"""),
)
def str4(spark, sf_dir):
    return usage.quota_violations(usage_analytics(spark, sf_dir), limit=QUOTA)


@query(
    "flt3_uploads_with_file_type",
    usage_check("""
SELECT document_id, user_id, timestamp, json_extract_string(metadata, '$.file_type') AS file_type
FROM usage_analytics
WHERE action = 'document_upload' AND json_extract_string(metadata, '$.file_type') IS NOT NULL"""),
)
def flt3(spark, sf_dir):
    return usage.typed_uploads(usage_analytics(spark, sf_dir)).select(
        "document_id", "user_id", "timestamp", "file_type"
    )


@query(
    "flt4_processing_with_level",
    usage_check("""
SELECT document_id, timestamp, simplification_level, confidence_score FROM usage_analytics
WHERE action = 'document_processing' AND simplification_level IS NOT NULL"""),
)
def flt4(spark, sf_dir):
    return usage.levelled_processing(usage_analytics(spark, sf_dir)).select(
        "document_id", "timestamp", "simplification_level", "confidence_score"
    )


@query(
    "flt6_last_day_events",
    usage_check(f"""
SELECT document_id, action, timestamp FROM usage_analytics
WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR"""),
)
def flt6(spark, sf_dir):
    recent = usage.recent(usage_analytics(spark, sf_dir), AS_OF)
    return recent.select("document_id", "action", "timestamp")
