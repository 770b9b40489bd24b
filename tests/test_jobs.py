"""Lifecycle jobs, tables and sinks on small fixtures."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clauselight import schemas
from clauselight.operators import batch, keyed
from clauselight.plans import lifecycle
from clauselight.sinks import tables as sinks
from clauselight.sources import tables as sources

AT = datetime(2024, 3, 1)


def metadata(spark, n=4):
    return spark.range(n).select(
        F.col("id").cast("string").alias("document_id"),
        F.concat(F.lit("f"), "id", F.lit(".txt")).alias("filename"),
        F.lit("text").alias("file_type"),
        F.lit(1).cast("bigint").alias("file_size"),
        F.timestamp_seconds("id").alias("upload_timestamp"),
        F.lit(None).cast("timestamp").alias("processing_timestamp"),
        F.lit("uploaded").alias("status"),
        F.lit("u").alias("user_id"),
        F.lit(None).cast("string").alias("extraction_method"),
        F.lit(None).cast("double").alias("ocr_confidence"),
        F.lit("en").alias("language_detected"),
        F.concat(F.lit("uploads/"), "id", F.lit("/f"), "id", F.lit(".txt")).alias("storage_path"),
        F.lit(None).cast("string").alias("processed_path"),
    )


def texts(spark, n=4):
    return spark.range(n).select(
        F.col("id").cast("string").alias("document_id"),
        F.concat(F.lit("document number "), "id").alias("text"),
    )


def generator(calls=None):
    def generate(prompt):
        if "number 1" in prompt:
            raise RuntimeError("model is down")
        if "number 9" in prompt:
            return ""
        return '{"summary": "s", "key_points": ["k"], "warnings": ["w"]}'

    return generate


@pytest.fixture
def workdir(tmp_path):
    return str(tmp_path / "work")


def requests(spark, ids):
    df = spark.createDataFrame([("b", ids)], "batch_id string, document_ids array<string>")
    return batch.batch_items(df)


def test_batch_isolates_failures(spark, workdir):
    items = requests(spark, ["0", "1", "3", "3", "unknown"])
    out = lifecycle.process(items, metadata(spark), texts(spark), generator(), workdir, as_of=AT)
    summary = out.summary.first()
    assert summary["total_documents"] == 5
    assert summary["processed_documents"] == 3
    assert summary["failed_documents"] == 2
    assert summary["processing_time"] > 0
    done = out.simplified.orderBy("position").collect()
    assert [r["document_id"] for r in done] == ["0", "3", "3"]
    assert done[0]["word_count_original"] == 3 and done[0]["word_count_simplified"] == 1
    errors = {r["document_id"]: r["detail"] for r in out.errors.collect()}
    assert errors == {"1": "model is down", "unknown": batch.NOT_FOUND}
    assert out.events.count() == 3 and out.events.first()["user_id"] == "u"
    changes = {r["document_id"]: r["status"] for r in out.changes.collect()}
    assert changes == {"0": "completed", "1": "failed", "3": "completed"}
    row = out.results.filter("document_id = '0'").first()
    assert (row["has_warnings"], row["has_deadlines"], row["key_points_count"]) == (True, False, 1)


def test_options_of_a_request(spark, workdir):
    items = spark.createDataFrame(
        [("0", True, "basic"), ("0", False, "basic"), ("0", False, None), ("2", None, None)],
        "document_id string, include_original boolean, simplification_level string",
    )
    out = lifecycle.process(items, metadata(spark), texts(spark), generator(), workdir, as_of=AT, parallelism=3)
    got = sorted((r["document_id"], r["simplification_level"], r["original_text"]) for r in out.simplified.collect() if r["original_text"])
    assert got == [("0", "basic", "document number 0")]
    assert out.simplified.count() == 4
    # Equal requests share one call.
    assert out.calls.count() == 3
    assert spark.read.parquet(f"{workdir}/outcomes").count() == 3


def test_documents_without_text_fail(spark, workdir):
    items = metadata(spark).select("document_id")
    blank = texts(spark, 3).withColumn("text", F.when(F.col("document_id") != "0", F.col("text")).otherwise(""))
    out = lifecycle.process(items, metadata(spark), blank, generator(), workdir, as_of=AT)
    details = {r["document_id"]: r["detail"] for r in out.errors.collect()}
    assert details == {"0": lifecycle.NO_TEXT, "1": "model is down", "3": lifecycle.NO_TEXT}
    updated = keyed.update_metadata(metadata(spark), out.changes)
    states = {r["document_id"]: (r["status"], r["processed_path"]) for r in updated.collect()}
    assert states["2"] == ("completed", "processed/2/simplified.json")
    assert states["0"] == ("failed", None)


def test_empty_responses_and_marking(spark, workdir):
    one = texts(spark, 1).withColumn("text", F.lit("number 9"))
    out = lifecycle.process(one.select("document_id"), metadata(spark), one, generator(), workdir)
    assert out.errors.first()["detail"] == "Failed to generate simplified content"
    marked = lifecycle.mark_processing(metadata(spark), one)
    assert [r["status"] for r in marked.orderBy("document_id").collect()] == ["processing"] + ["uploaded"] * 3


def test_ingest_extract_and_purge(spark, workdir):
    uploads = spark.createDataFrame(
        [
            ("a.txt", "text/plain", bytearray(b"plain \xff text")),
            ("b.pdf", "application/pdf", bytearray(b"%PDF")),
            ("", "text/plain", bytearray(b"x")),
            ("c.html", "text/html", bytearray(b"x")),
        ],
        "filename string, content_type string, content binary",
    )
    out = lifecycle.ingest(uploads, workdir, AT)
    strict = lifecycle.ingest(uploads, workdir + "-strict", AT, max_bytes=5, content_types=["text/html"])
    assert {r["reject_reason"] for r in strict.rejected.collect()} == {"no_filename", "too_large", "unsupported_type"}
    rejected = {r["filename"]: r["reject_reason"] for r in out.rejected.collect()}
    assert rejected == {"": "no_filename", "c.html": "unsupported_type"}
    rows = {r["filename"]: r for r in out.metadata.collect()}
    assert rows["b.pdf"]["extraction_method"] == "pdfplumber"
    assert rows["a.txt"]["storage_path"] == f"uploads/{rows['a.txt']['document_id']}/a.txt"
    # Ids are assigned once: every output agrees on them.
    ids = {r["document_id"] for r in out.raw.collect()}
    assert ids == {r["document_id"] for r in out.events.collect()} == {r["document_id"] for r in out.metadata.collect()}
    extracted = lifecycle.extract_texts(out.metadata, out.raw, {"pdf": lambda c: F.concat(c.cast("string"), F.lit("!"))})
    assert {r["text"] for r in extracted.collect()} == {"plain  text", "%PDF!"}

    doomed = out.metadata.filter("filename = 'a.txt'").select("document_id").unionByName(
        spark.sql("SELECT 'nobody' AS document_id")
    )
    purged = lifecycle.purge(out.metadata, out.raw, out.raw, doomed, AT)
    assert [r["filename"] for r in purged.metadata.collect()] == ["b.pdf"]
    assert purged.raw.count() == purged.simplified.count() == 1
    assert purged.events.count() == 1


def test_questions(spark, workdir):
    questions = spark.createDataFrame(
        [("q1", "0", "why?"), ("q2", "1", "why?"), ("q3", "x", "why?"), ("q4", "0", "how?")],
        "question_id string, document_id string, question string",
    )
    out = lifecycle.ask(questions, metadata(spark), texts(spark), generator(), workdir, as_of=AT)
    answers = {r["question_id"]: r for r in out.answers.collect()}
    assert answers["q1"]["confidence_score"] == 0.7
    assert answers["q2"]["answer"].startswith("I'm sorry") and answers["q2"]["confidence_score"] == 0.3
    assert [tuple(r) for r in out.errors.select("question_id", "error").collect()] == [("q3", batch.NOT_FOUND)]
    event = out.events.filter("document_id = '1'").first()
    assert event["user_id"] is None and json.loads(event["metadata"]) == {"question": "why?"}


def test_tables_are_created_once(spark, tmp_path):
    root = str(tmp_path)
    sinks.create_tables(spark, root)
    sinks.append_metadata(metadata(spark), f"{root}/document_metadata")
    sinks.create_tables(spark, root)
    assert sources.document_metadata(spark, f"{root}/document_metadata").count() == 4
    assert sources.partitioned_usage(spark, f"{root}/usage_analytics").count() == 0
    assert sources.processing_results(spark, f"{root}/processing_results").columns == schemas.columns(
        schemas.PROCESSING_RESULTS
    )


def test_simplified_documents_and_reports(spark, tmp_path, workdir):
    items = requests(spark, ["0", "2"])
    out = lifecycle.process(items, metadata(spark), texts(spark), generator(), workdir, as_of=AT)
    lines, tree, reports = (str(tmp_path / n) for n in ("lines", "tree", "reports"))
    sinks.write_simplified(out.simplified, lines)
    sinks.write_simplified(out.simplified, tree, per_document=True)
    sinks.write_reports(out.simplified, reports)
    wanted = schemas.columns(schemas.SIMPLIFIED_DOCUMENTS)
    first = [tuple(r) for r in sources.simplified_documents(spark, lines).orderBy("document_id").collect()]
    assert first == [tuple(r) for r in out.simplified.orderBy("document_id").select(*wanted).collect()]
    folders = {p.name for p in Path(tree).iterdir() if p.is_dir()}
    assert folders == {"document=0", "document=2"}
    report = spark.read.parquet(reports).filter("document_id = '0'").first()["markdown"]
    assert report.startswith("# Simplified Legal Document: f0.txt")

    pretty = tmp_path / "processed" / "7"
    pretty.mkdir(parents=True)
    (pretty / "simplified.json").write_text(
        json.dumps({"document_id": "7", "summary": "s", "important_terms": {"a": "b"}, "key_points": ["k"]}, indent=2)
    )
    row = sources.simplified_documents(spark, str(tmp_path / "processed"), pretty=True).first()
    assert (row["document_id"], row["important_terms"], row["warnings"]) == ("7", {"a": "b"}, None)


def test_raw_files(spark, tmp_path):
    for name in ("0/f0.txt", "2/f2.txt"):
        path = tmp_path / "uploads" / name
        path.parent.mkdir(parents=True)
        path.write_bytes(name.encode())
    raw = sources.raw_files(spark, str(tmp_path / "uploads"))
    out = sources.with_content(metadata(spark), raw).orderBy("document_id").collect()
    assert [r["content"] and bytes(r["content"]) for r in out] == [b"0/f0.txt", None, b"2/f2.txt", None]
    assert {r["document_id"] for r in raw.select("document_id").collect()} == {"0", "2"}


def test_period_prunes_days(spark, tmp_path):
    from clauselight.operators import usage

    events = spark.range(0, 10).select(
        F.lit("d").alias("document_id"),
        F.lit("document_view").alias("action"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("timestamp"),
        *[F.lit(None).alias(c) for c in ("user_id", "metadata", "processing_time", "file_size", "simplification_level", "confidence_score", "user_feedback")],
    )
    path = str(tmp_path / "events")
    sinks.append_events(events, path)
    stored = sources.partitioned_usage(spark, path)
    kept = usage.in_period(stored, datetime(2024, 1, 3), datetime(2024, 1, 5))
    assert kept.count() == 3  # both ends count
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert usage.in_period(stored, None, None, as_of=datetime(2024, 1, 4), default_days=1).count() == 2
    empty = usage.usage_statistics(stored, datetime(2025, 1, 1), datetime(2025, 1, 2)).first()
    assert empty["total_actions"] == 0 and empty["average_processing_time"] is None
    assert usage.usage_statistics(stored, datetime(2024, 1, 1), datetime(2024, 2, 1), exact=False).first()["unique_documents"] == 1


def test_outcomes_are_shuffled_once_for_their_items(spark, workdir):
    items = spark.createDataFrame([("0", True), ("3", False), ("nowhere", False)], "document_id string, include_original boolean")
    out = lifecycle.process(items, metadata(spark), texts(spark), generator(), workdir, as_of=AT)
    assert {r.document_id: r.original_text for r in out.simplified.collect()} == {"0": "document number 0", "3": None}
    lines = out.simplified._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = max(i for i, line in enumerate(lines) if "Relation" in line and "key_points" in line)
    depth, above = lines[at].index("Relation"), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            above.append(line)
    # They meet their texts and their items, both by the call.
    assert 1 <= sum("Join" in line for line in above) <= 2


def test_responses_of_a_run_are_not_shuffled(spark, workdir):
    ledger = lifecycle.Ledger(f"{workdir}/ledger")
    made = spark.createDataFrame([("k", "one", None, 1.0, 3)], "call string, response string, error string, seconds double, words long")
    run = ledger.add(made)
    found = ledger.outcomes(spark, made.select("call"), run)
    assert [(r.call, r.response) for r in found.collect()] == [("k", "one")]
    # What this run made stands before the union, without an exchange.
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().children().apply(0).toString()


def test_responses_are_handed_on_in_pieces(spark, monkeypatch):
    from clauselight.functions import generation

    seen, frame = [], generation.pd.DataFrame
    monkeypatch.setattr(generation, "BATCH_CHARS", 1000)
    monkeypatch.setattr(generation.F, "pandas_udf", lambda f, _: seen.append(f) or generation.F.udf(f))
    generation.generated(F.lit("x"), lambda p: p * 2)
    pieces = list(seen[0](iter([frame({"p": ["a" * 100] * 50 + [None]})["p"], frame({"p": ["b"]})["p"]])))
    assert max(map(len, pieces)) <= 4 and sum(map(len, pieces)) == 52
    assert pieces[-1].response.tolist() == ["bb"]
