"""One file per document, tables in the catalog, and tables changed in parts."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_jobs import metadata

from clauselight import schemas
from clauselight.operators import keyed
from clauselight.sinks import tables as sinks
from clauselight.sinks.files import write_files
from clauselight.sinks.keyed_table import KeyedTable
from clauselight.sources import tables as sources


def rows(spark, *files):
    return spark.createDataFrame([(n, c and bytearray(c)) for n, c in files], "file string, content binary")


def listed(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_file_for_each_row(spark, tmp_path):
    path = str(tmp_path / "out")
    many = spark.range(300).select(
        F.concat(F.lit("uploads/d"), "id", F.lit("/a b.txt")).alias("file"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")
    )
    write_files(many.repartition(5), path)
    write_files(rows(spark, ("uploads/x/empty", None)), path)  # a second run adds its files
    write_files(rows(spark).filter("false"), path)
    assert len(listed(path)) == 301 and not [p for p in Path(path).iterdir() if p.name.startswith("_")]
    got = {r.document_id: (r.storage_path, r.length, bytes(r.content)) for r in sources.raw_files(spark, path).collect()}
    # Spark lists no empty files.
    assert len(got) == 300 and got["d7"][1:] == (1, b"7") and "x" not in got


@pytest.mark.parametrize("name", ["../x", "/x", "a//b", "", None, "a/./b"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, name):
    path = tmp_path / "out"
    with pytest.raises(Exception):
        write_files(rows(spark, ("good/file", b"1"), (name, b"2")).coalesce(1), str(path))
    assert not path.exists() or listed(path) == []


def test_listing_opens_no_file(spark, tmp_path):
    write_files(rows(spark, ("uploads/1/a.txt", b"abc"), ("uploads/2/b.pdf", b"abcd")), str(tmp_path / "out"))
    files = sources.raw_files(spark, str(tmp_path / "out"), names="*.pdf", content=False)
    assert [(r.document_id, r.length) for r in files.collect()] == [("2", 4)]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_files_are_listed_by_a_few_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    many = spark.range(600).selectExpr("'uploads/d' || id || '/f{' || id % 3 || '}.txt' AS file", "encode(id, 'UTF-8') AS content")
    write_files(many.repartition(3), path)
    for hidden in ("_tmp/x", ".x", "y._COPYING_", "_k=1/x"):
        (tmp_path / "out" / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / "out" / hidden).write_text("x")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    for names in ("*", "f{*", "f[{]{0}.txt", "f\\{[!12]}.t?t", "{x,f\\{2*}", "[^f]*"):
        try:
            want = sorted((r.path.removeprefix("file:"), r.length, bytes(r.content)) for r in read.option("pathGlobFilter", names).load(path).collect())
        except Exception:  # noqa: BLE001 - not a pattern
            continue
        got = sources.raw_files(spark, path, names=names)
        assert sorted((r.path, r.length, bytes(r.content)) for r in got.collect()) == want
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    assert sources.raw_files(spark, path).count() == 601
    stages = {s for j in jobs.getJobIdsForGroup("listing") for s in jobs.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert all(s.numTasks < 100 for s in map(jobs.getStageInfo, stages) if s)


def test_reports_as_files_and_as_a_table(spark, tmp_path):
    one = spark.createDataFrame(
        [("a/b c", "f.txt", "s", ["k"], {"t": "d"}, [], ["w"], [], datetime(2024, 1, 2), 0.9, "college")],
        "document_id string, original_filename string, summary string, key_points array<string>, important_terms map<string,string>,"
        " deadlines_obligations array<string>, warnings array<string>, next_steps array<string>, processing_timestamp timestamp,"
        " confidence_score double, reading_level string",
    )
    sinks.write_reports(one, str(tmp_path / "table"))
    sinks.write_reports(one, str(tmp_path / "files"), per_document=True)
    [name] = listed(tmp_path / "files")
    assert name.endswith("/reports/a%2Fb+c.md")
    text = (tmp_path / "files" / name).read_text()
    assert text.startswith("# Simplified Legal Document: f.txt")
    assert spark.read.parquet(str(tmp_path / "table")).first().markdown == text


def test_catalog_tables_are_created_once(spark, tmp_path):
    names = sinks.create_catalog_tables(spark, str(tmp_path), "once_")
    sinks.insert_rows(metadata(spark), "document_metadata", names["document_metadata"])
    assert sinks.create_catalog_tables(spark, str(tmp_path), "once_") == names
    table = spark.table(names["document_metadata"])
    assert table.count() == 4 and table.columns == schemas.columns(schemas.DOCUMENT_METADATA)
    with pytest.raises(Exception, match="document_metadata.filename must not be null"):
        sinks.insert_rows(metadata(spark).withColumn("filename", F.lit(None)), "document_metadata", names["document_metadata"])
    assert spark.table(names["document_metadata"]).count() == 4
    parts = spark.sql(f"DESCRIBE {names['usage_analytics']}").collect()
    assert [r.col_name for r in parts].count("event_date") == 2  # a column and the partitioning
    event = spark.createDataFrame([("d", "view", datetime(2024, 1, 2, 3))], "document_id string, action string, timestamp timestamp")
    for f in schemas.USAGE_ANALYTICS.fields:
        if f.name not in event.columns:
            event = event.withColumn(f.name, F.lit(None))
    sinks.insert_rows(event, "usage_analytics", names["usage_analytics"])
    assert str(spark.table(names["usage_analytics"]).first().event_date) == "2024-01-02"
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def kept(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), schemas.DOCUMENT_METADATA, parts=8)
    table.create(metadata(spark, 50))
    return table


def files(table):
    return {p for p in listed(table.path) if p.startswith("data/") and p.endswith(".parquet")}


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_a_change_rewrites_only_its_parts(spark, kept):
    assert as_set(kept.read(spark)) == as_set(metadata(spark, 50))
    before = files(kept)
    changes = spark.createDataFrame([("7", "completed", None), ("none", "failed", None)], "document_id string, status string, processed_path string")
    kept.update(changes)
    assert as_set(kept.read(spark)) == as_set(keyed.update_metadata(metadata(spark, 50), changes))
    added = files(kept) - before
    assert before <= files(kept) and len({p.split("/")[2] for p in added}) <= 2
    assert {p.split("/")[2] for p in added} < {p.split("/")[2] for p in before}
    doomed = spark.range(0, 50, 2).select(F.col("id").cast("string").alias("document_id"))
    kept.delete(doomed)
    kept.update(changes.filter("document_id = 'none'"))
    assert kept.read(spark).count() == 25 and "completed" in {r.status for r in kept.read(spark).collect()}


def test_a_table_may_become_empty(spark, kept):
    kept.delete(metadata(spark, 50))
    assert kept.read(spark).count() == 0
    kept.delete(metadata(spark, 50))
    assert kept.read(spark).columns == schemas.columns(schemas.DOCUMENT_METADATA)


def test_a_change_that_fails_is_not_seen(spark, kept):
    before = as_set(kept.read(spark))
    broken = spark.createDataFrame([("7", "x")], "document_id string, status string").withColumn(
        "status", F.when(F.rand() < 2, F.raise_error(F.lit("broken"))).cast("string")
    )
    with pytest.raises(Exception, match="broken"):
        kept.update(broken)
    assert as_set(kept.read(spark)) == before
