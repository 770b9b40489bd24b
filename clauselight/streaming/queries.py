"""Streaming forms of ingest, daily metrics, document status and quotas.

Every query keeps its progress in a checkpoint folder the caller names on
shared storage, so it goes on where it stopped after a failure. What a batch
contributes is logged under its number and added up when read: no row is too late,
and a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from clauselight import schemas
from clauselight.functions.records import coerce_events
from clauselight.operators import partials
from clauselight.operators.keyed import latest

# Bytes of files a batch may read, so that a backlog is taken in pieces.
BATCH_BYTES = str(64 << 30)

#: Steps a document may take, by the status it comes from; null stands for a new document.
STEPS = {
    None: ("uploaded",),
    "uploaded": ("processing", "failed"),
    "processing": ("completed", "failed"),
    "completed": ("processing",),
    "failed": ("processing",),
}


def read_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A folder, or files named by a pattern, as a stream in a fixed schema."""
    options = {"maxBytesPerTrigger": BATCH_BYTES} | options
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _log(rows: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Write what a batch adds to a log; a batch that runs again replaces its own part."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={batch_id}")


def _read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def ingest_events(
    raw: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Coerce raw events and append them, accepted by day and rejected apart.

    Each batch is read and written once, in folders by verdict and day; one that
    runs again replaces its own. ``ingested`` and ``rejected`` read them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = coerce_events(batch).withColumns(
            {"event_date": F.to_date("timestamp"), "accepted": F.col("reject_reason").isNull()}
        )
        _log(rows.hint("rebalance", "accepted", "event_date"), path, batch_id, "accepted", "event_date")

    return _start(raw.writeStream.foreachBatch(write), checkpoint, available_now)


def _landed(spark: SparkSession, path: str, accepted: bool) -> DataFrame:
    fields = [*schemas.PARTITIONED_USAGE.fields, *schemas.VERDICT.fields]
    rows = spark.read.schema(StructType(fields)).parquet(path)
    return rows.filter(F.col("accepted") == accepted).drop("accepted")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The accepted events, by day."""
    return _landed(spark, path, True).drop("reject_reason")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rejected events with their reason."""
    return _landed(spark, path, False).drop("event_date")


# --- daily metrics ---------------------------------------------------------


def log_daily(
    events: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Log the daily partials of each batch.

    There is no watermark: events of any age count, in whatever order they
    arrive, and no state is kept between batches. ``daily_metrics`` adds the log up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _log(partials.day_values(batch), f"{path}/values", batch_id)
        # Written last: a batch counts once its sums are there.
        _log(partials.day_sums(batch), f"{path}/sums", batch_id)

    return _start(events.writeStream.foreachBatch(write), checkpoint, available_now)


def daily_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sums and values of all finished batches."""
    sums = _read_log(spark, f"{path}/sums", partials.SUMS_SCHEMA)
    values = _read_log(spark, f"{path}/values", partials.VALUES_SCHEMA)
    return sums, values.join(sums.select("batch").distinct(), "batch", "left_semi")


def daily_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Daily performance over all that has been logged, distinct counts exact."""
    return partials.daily(*daily_log(spark, path))


def compact_daily(spark: SparkSession, path: str, target: str) -> None:
    """Write the log to a new folder as one batch, numbered like the latest.

    To be run while no stream writes, after its last batch was committed; the stream
    can then go on with the new folder.
    """
    sums, values = daily_log(spark, path)
    last = sums.agg(F.max("batch")).first()[0]
    if last is None:
        return
    _log(values.select("date", "kind", "value").distinct(), f"{target}/values", last)
    _log(partials.merged(sums), f"{target}/sums", last)


# --- quotas ----------------------------------------------------------------

COUNTS_SCHEMA = "user_id string, window_start timestamp, requests bigint, window_date date"
ALERTS_SCHEMA = "user_id string, window_start timestamp, window_end timestamp, requests bigint"
_WINDOW = ["window_date", "user_id", "window_start"]


def _over(counts: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    end = F.col("window_start") + F.make_dt_interval(secs=F.lit(window_seconds))
    return counts.filter(F.col("requests") > limit).select(
        "user_id", "window_start", end.alias("window_end"), "requests"
    )


def log_quota(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    limit: int = 100,
    window_seconds: int = 3600,
    available_now: bool = False,
) -> StreamingQuery:
    """Log each batch's events per user and window, and the windows that it takes over the limit.

    Late events count in their own window, however old. A window enters ``alerts``
    once, in the batch that takes it over the limit: what earlier batches counted is
    looked up in the log, in the days this batch touches only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        window = F.window("timestamp", f"{window_seconds} seconds")
        counts = (
            batch.filter(F.col("user_id").isNotNull())
            .groupBy("user_id", window.alias("_w"))
            .agg(F.count("*").alias("requests"))
            .select("user_id", F.col("_w.start").alias("window_start"), "requests")
            .withColumn("window_date", F.to_date("window_start"))
        )
        _log(counts, f"{path}/counts", batch_id, "window_date")
        log = _read_log(batch.sparkSession, f"{path}/counts", COUNTS_SCHEMA)
        new = log.filter(F.col("batch") == batch_id).drop("batch")
        earlier = (
            log.filter(F.col("batch") < batch_id)
            .join(new.select(*_WINDOW), _WINDOW, "left_semi")
            .groupBy(*_WINDOW)
            .agg(F.sum("requests").alias("before"))
        )
        before = F.coalesce("before", F.lit(0))
        crossed = (
            new.join(earlier, _WINDOW, "left")
            .filter(before <= limit)
            .withColumn("requests", F.col("requests") + before)
        )
        _log(_over(crossed, limit, window_seconds), f"{path}/alerts", batch_id)

    return _start(events.writeStream.foreachBatch(write), checkpoint, available_now)


def quota_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Each window over the limit once, with its count when it went over."""
    return _read_log(spark, f"{path}/alerts", ALERTS_SCHEMA).drop("batch")


def quota_violations(
    spark: SparkSession, path: str, limit: int = 100, window_seconds: int = 3600
) -> DataFrame:
    """Windows over the limit with all that was counted in them."""
    counts = _read_log(spark, f"{path}/counts", COUNTS_SCHEMA)
    totals = counts.groupBy("user_id", "window_start").agg(F.sum("requests").alias("requests"))
    return _over(totals, limit, window_seconds)


# --- document status -------------------------------------------------------


def status_changes(
    changes: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Append the changes of each batch to a log.

    ``changes`` holds document_id, status and timestamp. The log is only ever
    appended to; ``current_status`` and ``status_steps`` read it and
    ``compact_status`` shrinks it to the current rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _log(batch.select("document_id", "status", "timestamp").distinct(), path, batch_id)

    return _start(changes.writeStream.foreachBatch(write), checkpoint, available_now)


# Later stages win when two changes carry the same time.
_STAGES = ("uploaded", "processing", "completed", "failed")


def _stage() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in _STAGES]), F.col("status"))


def _last(changes: DataFrame) -> DataFrame:
    return latest(changes, "document_id", F.desc("timestamp"), F.desc(_stage()))


def status_steps(log: DataFrame, steps: Mapping[str | None, Sequence[str]] = STEPS) -> DataFrame:
    """Every change with the status before it, and whether that step is allowed.

    Changes are put in order by time, those of one time by stage, whenever they
    arrived: a late one is judged in its place. The status before is looked up within
    a day first, then from the day before it that has changes, so that a
    document with very many changes is not brought together. Repeated changes count once; a
    change without a document or with an unknown status is not allowed.
    """
    rows = log.select("document_id", "status", "timestamp").distinct().withColumns(
        {"_day": F.to_date("timestamp"), "_stage": _stage()}
    )
    within = Window.partitionBy("document_id", "_day").orderBy("timestamp", "_stage", "status")
    days = rows.groupBy("document_id", "_day").agg(
        F.max_by("status", F.struct("timestamp", "_stage", "status")).alias("_end")
    )
    over_days = Window.partitionBy("document_id").orderBy("_day")
    days = days.select("document_id", "_day", F.lag("_end").over(over_days).alias("_carried"))
    same = F.col("r.document_id").eqNullSafe(F.col("d.document_id")) & F.col("r._day").eqNullSafe(F.col("d._day"))
    joined = (
        rows.withColumn("_first", F.row_number().over(within) == 1)
        .withColumn("_before", F.lag("status").over(within))
        .alias("r").join(days.alias("d"), same, "left")
    )
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    allowed = F.lit(False)
    for origin, targets in steps.items():
        comes_from = F.col("previous").isNull() if origin is None else F.col("previous") == origin
        allowed = F.when(comes_from, F.col("status").isin(*targets)).otherwise(allowed)
    return joined.select(
        "r.document_id", before.alias("previous"), "status", "timestamp"
    ).withColumn("allowed", F.coalesce(allowed & F.col("document_id").isNotNull(), F.lit(False)))


def rejected_steps(log: DataFrame, steps: Mapping[str | None, Sequence[str]] = STEPS) -> DataFrame:
    """Changes that no document may make, for a look by hand."""
    return status_steps(log, steps).filter("NOT allowed").drop("allowed")


def current_status(log: DataFrame) -> DataFrame:
    """The last status of every document in the log."""
    return _last(log.select("document_id", "status", "timestamp"))


def compact_status(spark: SparkSession, path: str, target: str) -> None:
    """Write the log with one row per document to a new folder."""
    current_status(spark.read.parquet(path)).write.mode("errorifexists").parquet(
        f"{target}/batch=0"
    )


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded run and raise what went wrong in it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
