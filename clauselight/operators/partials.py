"""Daily partial results of usage events that can be added up.

A partial is made of any set of events: a batch, a file, a day. Partials of
disjoint sets merge into that of their union, so reports for any period, and over
batches in any order, come from them without reading the events again. Distinct
documents and users are kept twice: as pairs of day and value, which count exactly, and as
sketches of fixed size beside the sums, for periods too long to bring the pairs together.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselight.operators.usage import LOW_CONFIDENCE, SLOW_SECONDS, in_period, instant

# Sketches of 2 ** 12 buckets: a relative standard error of about 1.6 %.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)

_ACTIONS = {
    "uploads": "document_upload",
    "processing_events": "document_processing",
    "views": "document_view",
    "deletions": "document_deletion",
}
_COUNTS = ("actions", *_ACTIONS, "feedback_count", "slow", "low", "processing_n", "confidence_n")
_TOTALS = ("processing_sum", "confidence_sum")
_SKETCHES = ("documents", "users")

SUMS_SCHEMA = ", ".join(
    ["date date", *(f"{c} bigint" for c in _COUNTS), *(f"{c} double" for c in _TOTALS),
     *(f"{c} binary" for c in _SKETCHES)]
)
VALUES_SCHEMA = "date date, kind string, value string"


def day_sums(events: DataFrame) -> DataFrame:
    """One row per day: counts, sums and sketches."""
    return events.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("actions"),
        *[F.count_if(F.col("action") == action).alias(name) for name, action in _ACTIONS.items()],
        F.count("user_feedback").alias("feedback_count"),
        F.count_if(F.col("processing_time") > SLOW_SECONDS).alias("slow"),
        F.count_if(F.col("confidence_score") < LOW_CONFIDENCE).alias("low"),
        F.count("processing_time").alias("processing_n"),
        F.count("confidence_score").alias("confidence_n"),
        F.sum("processing_time").alias("processing_sum"),
        F.sum("confidence_score").alias("confidence_sum"),
        F.hll_sketch_agg("document_id", SKETCH_BITS).alias("documents"),
        F.hll_sketch_agg("user_id", SKETCH_BITS).alias("users"),
    )


def day_values(events: DataFrame) -> DataFrame:
    """The distinct documents and users of each day."""
    def pair(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("value"))

    pairs = F.explode(F.array(pair("document"), pair("user")))
    found = events.select(F.to_date("timestamp").alias("date"), pairs.alias("p")).select("date", "p.*")
    return found.filter("value IS NOT NULL").distinct()


def _merge() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in (*_COUNTS, *_TOTALS)],
        *[F.hll_union_agg(c).alias(c) for c in _SKETCHES],
    ]


def merged(sums: DataFrame) -> DataFrame:
    """Partials of the same day as one."""
    return sums.groupBy("date").agg(*_merge())


def _mean(name: str) -> Column:
    return F.col(f"{name}_sum") / F.nullif(F.col(f"{name}_n"), F.lit(0))


def daily(sums: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Daily performance from partials; without ``values`` distinct counts come from the sketches."""
    days = merged(sums)
    if values is None:
        documents, users = F.hll_sketch_estimate("documents"), F.hll_sketch_estimate("users")
    else:
        distinct = values.select("date", "kind", "value").distinct().groupBy(F.col("date").alias("_day")).agg(
            F.count_if(F.col("kind") == "document").alias("n_documents"),
            F.count_if(F.col("kind") == "user").alias("n_users"),
        )
        days = days.join(distinct, F.col("date").eqNullSafe(F.col("_day")), "left").drop("_day")
        documents, users = (F.coalesce(f"n_{k}s", F.lit(0)) for k in ("document", "user"))
    return days.select(
        "date",
        F.col("actions").alias("daily_actions"),
        documents.alias("daily_documents"),
        users.alias("daily_users"),
        _mean("processing").alias("average_processing_time"),
        _mean("confidence").alias("average_confidence_score"),
        F.col("slow").alias("slow_processing_count"),
        F.col("low").alias("low_confidence_count"),
    )


def period_statistics(
    sums: DataFrame,
    values: DataFrame | None,
    events: DataFrame,
    start: datetime,
    end: datetime,
) -> DataFrame:
    """Totals between two instants, both ends included, from the partials of whole days.

    Only the events of the first and the last day are read, as those days may
    count in part. One row, also for an empty period, with the period itself. Without
    ``values`` the distinct counts are estimates from the sketches.
    """
    first, last = start.date() + timedelta(days=1), end.date() - timedelta(days=1)
    inside = F.col("date").between(F.lit(first), F.lit(last))
    day = F.to_date("timestamp")
    edges = in_period(events, start, end).filter(~day.between(F.lit(first), F.lit(last)))
    if "event_date" in events.columns:
        edges = edges.filter(~F.col("event_date").between(F.lit(first), F.lit(last)))
    parts = sums.select(*day_sums(edges).columns).filter(inside).unionByName(day_sums(edges))
    total = parts.agg(*_merge())
    if values is None:
        documents, users = F.hll_sketch_estimate("documents"), F.hll_sketch_estimate("users")
    else:
        seen = values.select("date", "kind", "value").filter(inside).unionByName(day_values(edges))
        # One row per value first, so that no task holds all of them.
        distinct = seen.select("kind", "value").distinct().agg(
            F.count_if(F.col("kind") == "document").alias("n_documents"),
            F.count_if(F.col("kind") == "user").alias("n_users"),
        )
        # One row beside one row.
        total = total.withColumn("_one", F.lit(1)).join(distinct.withColumn("_one", F.lit(1)), "_one")
        documents, users = F.col("n_documents"), F.col("n_users")
    none = F.lit(0).cast("bigint")
    counts = {"total_actions": "actions", **{n: n for n in _ACTIONS}, "feedback_count": "feedback_count"}
    period = F.struct(
        instant(events, "timestamp", start).alias("start"), instant(events, "timestamp", end).alias("end")
    )
    return total.select(
        period.alias("period"),
        F.coalesce(documents, none).alias("unique_documents"),
        F.coalesce(users, none).alias("unique_users"),
        *[F.coalesce(column, none).alias(name) for name, column in counts.items()],
        _mean("processing").alias("average_processing_time"),
        _mean("confidence").alias("average_confidence_score"),
    )
