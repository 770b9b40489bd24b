"""Reports over usage events.

Every report is one aggregation whose partial step runs before the shuffle, so
a document or user that owns a large share of the events costs each map task
one row per distinct value, not one row per event.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOW_SECONDS = 30
LOW_CONFIDENCE = 0.7
USAGE_DAYS = 30
PERFORMANCE_DAYS = 7


def instant(df: DataFrame, column: str, value: datetime | str) -> Column:
    """A literal in the column's own timestamp type, so the scan can use it."""
    return F.lit(value).cast(df.schema[column].dataType)


def period(
    start: datetime | str | None,
    end: datetime | str | None,
    as_of: datetime | None = None,
    default_days: int = USAGE_DAYS,
) -> tuple[datetime | str, datetime | str]:
    """Both ends of a period, missing ones filled in."""
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    return as_of - timedelta(days=default_days) if start is None else start, as_of if end is None else end


def in_period(
    events: DataFrame,
    start: datetime | str | None,
    end: datetime | str | None,
    *,
    as_of: datetime | None = None,
    default_days: int = USAGE_DAYS,
) -> DataFrame:
    """Events between two instants, both ends included.

    A missing end is ``as_of`` (default: now), a missing start is
    ``default_days`` before ``as_of``. A table partitioned by ``event_date`` is
    pruned to the days of the period as well.
    """
    start, end = period(start, end, as_of, default_days)
    low, high = instant(events, "timestamp", start), instant(events, "timestamp", end)
    kept = events.filter(F.col("timestamp").between(low, high))
    if "event_date" in events.columns:
        kept = kept.filter(F.col("event_date").between(low.cast("date"), high.cast("date")))
    return kept


def _action(name: str) -> Column:
    return F.count_if(F.col("action") == name)


def _distinct(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def _feedback_count() -> Column:
    return F.count("user_feedback")


def usage_statistics(
    events: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    as_of: datetime | None = None,
    exact: bool = True,
) -> DataFrame:
    """Totals for a period, and the period; one row, also when the period is empty."""
    start, end = period(start, end, as_of)
    ends = [instant(events, "timestamp", t).alias(n) for t, n in ((start, "start"), (end, "end"))]
    return in_period(events, start, end).agg(
        F.count("*").alias("total_actions"),
        _distinct("document_id", exact).alias("unique_documents"),
        _distinct("user_id", exact).alias("unique_users"),
        _action("document_upload").alias("uploads"),
        _action("document_processing").alias("processing_events"),
        _action("document_view").alias("views"),
        _action("document_deletion").alias("deletions"),
        F.avg("processing_time").alias("average_processing_time"),
        F.avg("confidence_score").alias("average_confidence_score"),
        _feedback_count().alias("feedback_count"),
    ).withColumn("period", F.struct(*ends))


def document_analytics(
    events: DataFrame, document_id: str | None = None, *, exact: bool = True
) -> DataFrame:
    """Per-document activity; an unknown document gives no row."""
    if document_id is not None:
        events = events.filter(F.col("document_id") == document_id)
    return events.groupBy("document_id").agg(
        F.count("*").alias("total_events"),
        _distinct("action", exact).alias("unique_actions"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
        _action("document_upload").alias("uploads"),
        _action("document_processing").alias("processing_events"),
        _action("document_view").alias("views"),
        F.avg("processing_time").alias("average_processing_time"),
        F.avg("confidence_score").alias("average_confidence_score"),
        _feedback_count().alias("feedback_count"),
    )


def user_analytics(
    events: DataFrame, user_id: str | None = None, *, exact: bool = True
) -> DataFrame:
    """Per-user activity; events without a user belong to nobody."""
    key = F.col("user_id")
    events = events.filter(key.isNotNull() if user_id is None else key == user_id)
    return events.groupBy("user_id").agg(
        F.count("*").alias("total_actions"),
        _distinct("document_id", exact).alias("unique_documents"),
        F.min("timestamp").alias("first_activity"),
        F.max("timestamp").alias("last_activity"),
        _action("document_upload").alias("uploads"),
        _action("document_processing").alias("processing_events"),
        _action("document_view").alias("views"),
        _action("document_deletion").alias("deletions"),
        F.avg("processing_time").alias("average_processing_time"),
        _feedback_count().alias("feedback_count"),
    )


def daily_metrics(events: DataFrame, *, exact: bool = True) -> DataFrame:
    """One row per day that has events."""
    return events.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("daily_actions"),
        _distinct("document_id", exact).alias("daily_documents"),
        _distinct("user_id", exact).alias("daily_users"),
        F.avg("processing_time").alias("average_processing_time"),
        F.avg("confidence_score").alias("average_confidence_score"),
        F.count_if(F.col("processing_time") > SLOW_SECONDS).alias("slow_processing_count"),
        F.count_if(F.col("confidence_score") < LOW_CONFIDENCE).alias("low_confidence_count"),
    )


def performance_metrics(
    events: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    as_of: datetime | None = None,
    exact: bool = True,
) -> DataFrame:
    """Daily metrics of a period, oldest day first."""
    kept = in_period(events, start, end, as_of=as_of, default_days=PERFORMANCE_DAYS)
    return daily_metrics(kept, exact=exact).orderBy("date")


def typed_uploads(events: DataFrame) -> DataFrame:
    """Uploads whose JSON names a file type, with that type and the file size."""
    file_type = F.get_json_object("metadata", "$.file_type")
    file_size = F.get_json_object("metadata", "$.file_size").try_cast("double")
    return events.filter(
        (F.col("action") == "document_upload") & file_type.isNotNull()
    ).withColumns({"file_type": file_type, "metadata_file_size": file_size})


def popular_document_types(events: DataFrame) -> DataFrame:
    """Uploads by file type named in the event's JSON, most frequent first."""
    return (
        typed_uploads(events)
        .groupBy("file_type")
        .agg(F.count("*").alias("count"), F.avg("metadata_file_size").alias("average_file_size"))
        .orderBy(F.desc("count"), "file_type")
    )


def levelled_processing(events: DataFrame) -> DataFrame:
    """Processing events that name a level."""
    return events.filter(
        (F.col("action") == "document_processing") & F.col("simplification_level").isNotNull()
    )


def simplification_effectiveness(events: DataFrame) -> DataFrame:
    """Processing events by level, most frequent first."""
    return (
        levelled_processing(events)
        .groupBy("simplification_level")
        .agg(
            F.count("*").alias("count"),
            F.avg("confidence_score").alias("average_confidence"),
            F.avg("processing_time").alias("average_processing_time"),
            _feedback_count().alias("feedback_count"),
        )
        .orderBy(F.desc("count"), "simplification_level")
    )


def recent(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Events since ``hours`` before ``as_of``."""
    since = instant(events, "timestamp", as_of - timedelta(hours=hours))
    kept = events.filter(F.col("timestamp") >= since)
    if "event_date" in events.columns:
        kept = kept.filter(F.col("event_date") >= since.cast("date"))
    return kept


def recent_requests(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Request count and mean processing time since ``hours`` before ``as_of``."""
    return recent(events, as_of, hours).agg(
        F.count("*").alias("total_requests"),
        F.avg("processing_time").alias("average_processing_time"),
    )


def quota_violations(
    events: DataFrame, limit: int = 100, window_seconds: int = 3600
) -> DataFrame:
    """Users with more than ``limit`` events in a fixed window."""
    window = F.window("timestamp", f"{window_seconds} seconds")
    return (
        events.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", window.alias("_w"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select(
            "user_id",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "requests",
        )
    )

