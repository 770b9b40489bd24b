"""Edge rows: missing ids, several changes to one key, ties in the history."""

from datetime import datetime

from clauselight.operators import keyed
from clauselight.plans.lifecycle import _request_key


def test_requests_without_an_id_have_a_key(spark):
    rows = spark.createDataFrame(
        [(None, "basic", "adult"), ("a", "basic", "adult"), ("a", None, "adult")],
        "document_id string, simplification_level string, target_audience string",
    )
    keys = [r.k for r in rows.select(_request_key().alias("k")).collect()]
    assert None not in keys and len(set(keys)) == 3


def test_several_changes_to_a_document_keep_one_row(spark):
    metadata = spark.createDataFrame(
        [("a", "uploaded", None), ("b", "uploaded", None)],
        "document_id string, status string, processing_timestamp timestamp",
    )
    at = datetime(2024, 1, 1)
    changes = spark.createDataFrame(
        [("a", "processing", None), ("a", "completed", at)],
        "document_id string, status string, processing_timestamp timestamp",
    )
    got = sorted((r.document_id, r.status) for r in keyed.update_metadata(metadata, changes).collect())
    assert got == [("a", "completed"), ("b", "uploaded")]


def test_the_later_stage_is_the_current_row(spark):
    at = datetime(2024, 1, 1)
    rows = [(str(i), s, None, at) for i in range(20) for s in ("failed", "uploaded", "processing")]
    schema = "document_id string, status string, processing_timestamp timestamp, upload_timestamp timestamp"
    got = keyed.latest_metadata(spark.createDataFrame(rows, schema)).collect()
    assert {r.status for r in got} == {"failed"} and len(got) == 20
