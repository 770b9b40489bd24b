"""Streams over files that arrive in several batches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clauselight import schemas
from clauselight.operators import partials, usage
from clauselight.streaming import queries as streams


def events(spark, first, days):
    start = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(hours=F.col("id").cast("int"))
    values = {
        "document_id": F.concat(F.lit("d"), F.col("id") % 7),
        "user_id": F.concat(F.lit("u"), F.col("id") % 3),
        "action": F.lit("document_processing"),
        "timestamp": start,
        "processing_time": (F.col("id") % 60).cast("double"),
        "confidence_score": F.lit(0.5),
    }
    return spark.range(first * 24, (first + days) * 24).select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.USAGE_ANALYTICS.fields
        ]
    )


@pytest.fixture
def folder(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "state", "compact")}


def stream(spark, folder, schema=schemas.USAGE_ANALYTICS, **options):
    return streams.read_stream(spark, folder["in"], schema, **options)


def dicts(rows):
    return [r.asDict() for r in rows.orderBy("date").collect()]


def test_days_of_any_age_count(spark, folder):
    """Files for 20, 21, 3 and 22 January, and more of the 3rd at the end."""
    parts = [(19, 1), (20, 1), (2, 1), (21, 1), (2, 1)]
    for first, days in parts:
        events(spark, first, days).coalesce(1).write.mode("append").parquet(folder["in"])
        streams.finish(streams.log_daily(stream(spark, folder), folder["out"], folder["state"], available_now=True))
    whole = spark.read.schema(schemas.USAGE_ANALYTICS).parquet(folder["in"])
    got = dicts(streams.daily_metrics(spark, folder["out"]))
    assert got == dicts(usage.daily_metrics(whole))
    assert [(r["date"].day, r["daily_actions"]) for r in got] == [(3, 48), (20, 24), (21, 24), (22, 24)]

    streams.compact_daily(spark, folder["out"], folder["compact"])
    assert dicts(streams.daily_metrics(spark, folder["compact"])) == got
    # The stream goes on with the compacted log.
    events(spark, 5, 1).coalesce(1).write.mode("append").parquet(folder["in"])
    streams.finish(streams.log_daily(stream(spark, folder), folder["compact"], folder["state"], available_now=True))
    whole = spark.read.schema(schemas.USAGE_ANALYTICS).parquet(folder["in"])
    assert dicts(streams.daily_metrics(spark, folder["compact"])) == dicts(usage.daily_metrics(whole))


def test_a_batch_that_runs_again_counts_once(spark, folder):
    events(spark, 0, 2).coalesce(1).write.parquet(folder["in"])
    for state in ("a", "b"):  # both begin with batch 0
        query = streams.log_daily(stream(spark, folder), folder["out"], folder["state"] + state, available_now=True)
        streams.finish(query)
    assert dicts(streams.daily_metrics(spark, folder["out"])) == dicts(usage.daily_metrics(events(spark, 0, 2)))


def test_a_backlog_is_read_in_pieces(spark, folder):
    for first in range(3):
        events(spark, first, 1).coalesce(1).write.mode("append").parquet(folder["in"])
    bounded = stream(spark, folder, maxBytesPerTrigger="1")
    streams.finish(streams.log_daily(bounded, folder["out"], folder["state"], available_now=True))
    assert streams.daily_log(spark, folder["out"])[0].select("batch").distinct().count() == 3


def test_sketches_estimate_distinct_counts(spark):
    wide = events(spark, 0, 400).withColumn("document_id", F.concat(F.lit("d"), F.expr("uuid()")))
    wide = wide.withColumn("document_id", F.concat(F.col("document_id"), F.hour("timestamp")))
    sums = partials.day_sums(wide).unionByName(partials.day_sums(wide.limit(0)))
    total = partials.period_statistics(sums, None, wide, datetime(2024, 1, 1, 5), datetime(2026, 1, 1)).first()
    n = 400 * 24 - 5
    assert total["total_actions"] == n
    assert abs(total["unique_documents"] - n) < 4 * partials.SKETCH_ERROR * n
    assert total["unique_users"] == 3


@pytest.mark.parametrize(
    "start, end",
    [
        (datetime(2024, 1, 1), datetime(2024, 1, 9)),
        (datetime(2024, 1, 2, 7, 30), datetime(2024, 1, 5, 13)),
        (datetime(2024, 1, 3, 4), datetime(2024, 1, 3, 9)),
        (datetime(2024, 1, 3, 4), datetime(2024, 1, 4, 9)),
        (datetime(2023, 1, 1), datetime(2023, 1, 4)),
    ],
)
def test_periods_from_daily_partials(spark, start, end):
    rows = events(spark, 0, 6).withColumn("action", F.when(F.hour("timestamp") < 5, "document_view").otherwise(F.col("action")))
    sums = partials.day_sums(rows.filter("document_id < 'd3'")).unionByName(partials.day_sums(rows.filter("document_id >= 'd3'")))
    values = partials.day_values(rows)
    got = partials.period_statistics(sums, values, rows, start, end).first().asDict()
    assert (got["period"]["start"], got["period"]["end"]) == (start, end)
    assert got == usage.usage_statistics(rows, start, end).first().asDict()


def test_ingest_goes_on_where_it_stopped(spark, folder):
    schema = "document_id string, action string, timestamp string, file_size string"
    for i in range(2):
        spark.createDataFrame(
            [(f"d{i}", "view", "2024-01-01 10:00:00", "1"), (f"d{i}", "view", "never", "1")], schema
        ).coalesce(1).write.mode("append").json(folder["in"])
        raw = spark.readStream.schema(schema).json(folder["in"])
        streams.finish(streams.ingest_events(raw, folder["out"], folder["state"], available_now=True))
    good = streams.ingested(spark, folder["out"])
    assert sorted(r["document_id"] for r in good.collect()) == ["d0", "d1"]
    assert str(good.first()["event_date"]) == "2024-01-01"
    bad = streams.rejected(spark, folder["out"])
    assert [r["reject_reason"] for r in bad.collect()] == ["invalid_timestamp"] * 2
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "accepted" in plan.split("PartitionFilters:")[1].split("]")[0]


CHANGES = "document_id string, status string, timestamp timestamp"


def arrive(spark, folder, moves, schema=CHANGES):
    for move in moves:
        spark.createDataFrame(move, schema).coalesce(1).write.mode("append").parquet(folder["in"])
        changes = spark.readStream.schema(schema).parquet(folder["in"])
        streams.finish(streams.status_changes(changes, folder["out"], folder["state"], available_now=True))
    return spark.read.parquet(folder["out"])


def test_status_log(spark, folder):
    log = arrive(spark, folder, [
        [("a", "uploaded", datetime(2024, 1, 1)), ("b", "uploaded", datetime(2024, 1, 1))],
        [("a", "processing", datetime(2024, 1, 2)), ("a", "completed", datetime(2024, 1, 2))],
        [("b", "failed", datetime(2023, 1, 1))],
    ])
    current = streams.current_status(log)
    assert {r["document_id"]: r["status"] for r in current.collect()} == {"a": "completed", "b": "uploaded"}
    streams.compact_status(spark, folder["out"], folder["compact"])
    assert spark.read.parquet(folder["compact"]).count() == 2


def test_steps_are_judged_in_their_place(spark, folder):
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    log = arrive(spark, folder, [
        [("a", "uploaded", at(1)), ("a", "completed", at(5)), ("b", "processing", at(1)), (None, "uploaded", at(1))],
        [("a", "uploaded", at(6, 1)), ("a", "processing", at(6, 2)), ("a", "odd", at(6, 3)), ("b", "failed", at(1))],
        [("a", "processing", at(4)), ("a", "uploaded", at(1)), ("b", "uploaded", at(1))],  # late, and one again
    ])
    steps = streams.status_steps(log).collect()
    assert sorted((r.document_id or "", r.timestamp.day, r.timestamp.hour, r.previous or "", r.status, r.allowed) for r in steps) == [
        ("", 1, 0, "", "uploaded", False),
        ("a", 1, 0, "", "uploaded", True),
        ("a", 4, 0, "uploaded", "processing", True),
        ("a", 5, 0, "processing", "completed", True),
        ("a", 6, 1, "completed", "uploaded", False),
        ("a", 6, 2, "uploaded", "processing", True),
        ("a", 6, 3, "processing", "odd", False),
        ("b", 1, 0, "", "uploaded", True),
        ("b", 1, 0, "processing", "failed", True),
        ("b", 1, 0, "uploaded", "processing", True),
    ]
    assert streams.rejected_steps(log).count() == 3


def test_quota_over_a_stream(spark, folder):
    rows = events(spark, 0, 3).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    hours = F.pmod(F.xxhash64("document_id", "user_id", "processing_time"), F.lit(3))
    for late in (2, 0, 1):  # each window fills up over three batches
        rows.filter(hours == late).coalesce(1).write.mode("append").parquet(folder["in"])
        query = streams.log_quota(stream(spark, folder), folder["out"], folder["state"], limit=7, available_now=True)
        streams.finish(query)
    got = streams.quota_violations(spark, folder["out"], limit=7)
    expected = usage.quota_violations(rows, limit=7)
    assert expected.count() == 9
    assert {tuple(r) for r in got.select(*expected.columns).collect()} == {tuple(r) for r in expected.collect()}
    alerts = streams.quota_alerts(spark, folder["out"]).collect()
    assert sorted((r.user_id, r.window_start) for r in alerts) == sorted((r.user_id, r.window_start) for r in expected.collect())
    assert all(7 < r.requests <= 8 * 3 for r in alerts)
