"""Table scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselight import schemas
from clauselight.operators.skew import salted_join
from clauselight.sources import files

UPLOAD_ID = r"uploads/([^/]+)/"


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One of the three analytic tables, in its fixed schema."""
    return spark.read.schema(schemas.TABLES[name]).format(fmt).load(path)


def usage_analytics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "usage_analytics", path, fmt)


def partitioned_usage(spark: SparkSession, path: str) -> DataFrame:
    """The event table as the event sink lays it out, one folder per day."""
    return spark.read.schema(schemas.PARTITIONED_USAGE).parquet(path)


def document_metadata(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "document_metadata", path, fmt)


def processing_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "processing_results", path, fmt)


def simplified_documents(spark: SparkSession, path: str, *, pretty: bool = False) -> DataFrame:
    """Simplified documents; ``pretty`` reads one indented object per file."""
    reader = spark.read.schema(schemas.SIMPLIFIED_DOCUMENTS)
    if pretty:
        reader = reader.option("multiLine", True).option("recursiveFileLookup", True)
    return reader.json(path)


def raw_files(
    spark: SparkSession, path: str, *, names: str | None = None, content: bool = True
) -> DataFrame:
    """Uploaded files in a folder and those below it, with the document id from their path.

    ``names`` is a pattern that file names must match. Without ``content`` only the
    listing is read and no file is opened. Empty files are left out. Listing and reading are
    tasks' work; a store that only Spark opens is left to its own reader.
    """
    if files.reachable(path):
        found = files.listed(spark, path, names)
        if content:
            found = files.with_bytes(found, path)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if names is not None:
            reader = reader.option("pathGlobFilter", names)
        found = reader.load(path)
    columns = ("path", "modificationTime", "length", *(["content"] if content else []))
    return found.select(
        F.regexp_extract("path", UPLOAD_ID, 1).alias("document_id"),
        F.regexp_extract("path", r"(uploads/[^/]+/.+)$", 1).alias("storage_path"),
        *columns,
    )


def raw_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploads landed as a table."""
    return spark.read.schema(schemas.RAW_UPLOADS).parquet(path)


def with_content(documents: DataFrame, raw: DataFrame) -> DataFrame:
    """Bytes of each document by storage path; NULL where the file is missing."""
    files = raw.select("storage_path", "content")
    return salted_join(documents, files, "storage_path", "left")


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)
