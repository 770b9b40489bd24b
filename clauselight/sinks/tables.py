"""Table writers. Every write is an append or goes to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselight import schemas
from clauselight.functions import report
from clauselight.sinks.files import write_files

# JSON keeps every field, and times to the microsecond.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table in its own order and types."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name].fields]
    )


def append_events(events: DataFrame, path: str) -> None:
    """Append events, one folder per day.

    Rows are gathered by day, so a task writes few files. The rebalancing is
    adaptive: small days share a task and a day with many events is split over
    several.
    """
    rows = conform(events, "usage_analytics").withColumn("event_date", F.to_date("timestamp"))
    (
        rows.hint("rebalance", "event_date")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def append_metadata(metadata: DataFrame, path: str) -> None:
    conform(metadata, "document_metadata").write.mode("append").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    conform(results, "processing_results").write.mode("append").parquet(path)


def write_uploads(uploads: DataFrame, path: str, *, per_document: bool = False) -> None:
    """Land raw uploads as a table, or as one file each under their storage path."""
    if per_document:
        write_files(uploads.select(F.col("storage_path").alias("file"), "content"), path)
    else:
        uploads.select(*schemas.columns(schemas.RAW_UPLOADS)).write.mode("append").parquet(path)


def write_simplified(simplified: DataFrame, path: str, *, per_document: bool = False) -> None:
    """Simplified documents as JSON lines.

    ``per_document`` makes a folder per document, for small exports; the plain
    form is the one to use for many documents.
    """
    rows = simplified.select(*schemas.columns(schemas.SIMPLIFIED_DOCUMENTS))
    if per_document:
        rows = rows.withColumn("document", F.col("document_id"))
        rows.write.options(**JSON_OPTIONS).partitionBy("document").mode("append").json(path)
    else:
        rows.write.options(**JSON_OPTIONS).mode("append").json(path)


def export_json(df: DataFrame, path: str) -> None:
    """Full copy of a table as JSON lines."""
    df.write.options(**JSON_OPTIONS).mode("errorifexists").json(path)


def write_reports(simplified: DataFrame, path: str, *, per_document: bool = False) -> None:
    """The Markdown report of each document: a table of document_id and markdown, or a file each.

    A file is named ``reports/<document id>.md``, the id as in a URL.
    """
    rows = simplified.select("document_id", report.markdown().alias("markdown"))
    if per_document:
        name = F.concat(F.lit("reports/"), F.url_encode("document_id"), F.lit(".md"))
        write_files(rows.select(name.alias("file"), F.encode("markdown", "UTF-8").alias("content")), path)
    else:
        rows.write.mode("append").parquet(path)


def create_tables(spark: SparkSession, root: str) -> None:
    """Create the three tables where they do not exist; existing data stays."""
    for name, schema in schemas.TABLES.items():
        if name == "usage_analytics":
            writer = spark.createDataFrame([], schemas.PARTITIONED_USAGE).write.partitionBy("event_date")
        else:
            writer = spark.createDataFrame([], schema).write
        writer.mode("ignore").parquet(f"{root}/{name}")


def create_catalog_tables(spark: SparkSession, root: str, prefix: str = "") -> dict[str, str]:
    """The three tables in the session's catalog, over folders below ``root``.

    Tables that are there stay as they are, with their data. Returns the catalog's
    names by table. Columns that must have a value are declared so; Spark does not hold its file
    tables to that, ``insert_rows`` does.
    """
    names = {}
    for table, schema in schemas.TABLES.items():
        by_day = table == "usage_analytics"
        fields = schemas.PARTITIONED_USAGE.fields if by_day else schema.fields
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in fields
        )
        names[table] = f"{prefix}{table}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {names[table]} ({columns}) USING parquet"
            f"{' PARTITIONED BY (event_date)' if by_day else ''} LOCATION '{root}/{table}'"
        )
    return names


def insert_rows(rows: DataFrame, table: str, target: str) -> None:
    """Append rows to a catalog table; a missing value in a required column fails the insert."""
    schema = schemas.TABLES[table]
    checked = conform(rows, table).select(
        *[
            F.col(f.name)
            if f.nullable
            else F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{table}.{f.name} must not be null"))).alias(f.name)
            for f in schema.fields
        ]
    )
    if table == "usage_analytics":
        checked = checked.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date")
    checked.write.insertInto(target)
