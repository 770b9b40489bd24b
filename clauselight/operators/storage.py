"""Reports over document metadata and processing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.operators.keyed import latest_metadata
from clauselight.operators.skew import salted_join


def storage_statistics(metadata: DataFrame) -> DataFrame:
    """Document count, stored bytes and number of owners; always one row."""
    return metadata.agg(
        F.count("*").alias("total_documents"),
        F.sum("file_size").alias("total_size_bytes"),
        F.avg("file_size").alias("average_file_size_bytes"),
        F.count_distinct("user_id").alias("unique_users"),
    )


def results_with_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Results with the fields only the metadata knows filled in."""
    known = latest_metadata(metadata).select(
        "document_id",
        "file_type",
        F.col("extraction_method").alias("_method"),
        F.col("language_detected").alias("_language"),
    )
    joined = salted_join(results, known, "document_id", "left")
    filled = {"extraction_method": "_method", "language_detected": "_language"}
    return joined.select(
        *[
            F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c)
            for c in results.columns
        ],
        "file_type",
    )


def results_with_processing_time(results: DataFrame, events: DataFrame) -> DataFrame:
    """Fill the processing time from each document's latest processing event."""
    times = (
        events.filter(F.col("action") == "document_processing")
        .groupBy("document_id")
        .agg(F.max(F.struct("timestamp", "processing_time")).alias("_latest"))
        .select("document_id", F.col("_latest.processing_time").alias("_seconds"))
    )
    joined = salted_join(results, times, "document_id", "left")
    return joined.select(
        *[
            F.coalesce("_seconds", c).alias(c) if c == "processing_time_seconds" else F.col(c)
            for c in results.columns
        ]
    )


def processing_by_file_type(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Processing figures by file type.

    Both sides shrink to one row per document (and type) before they meet, so
    the join moves sums instead of rows and no document can be hot in it.
    """
    per_document = results.groupBy("document_id").agg(
        F.count("*").alias("_n"),
        F.sum("confidence_score").alias("_conf"),
        F.count("confidence_score").alias("_n_conf"),
        F.sum("word_count_original").alias("_orig"),
        F.count("word_count_original").alias("_n_orig"),
        F.sum("word_count_simplified").alias("_simp"),
        F.count("word_count_simplified").alias("_n_simp"),
    )
    types = metadata.groupBy("document_id", "file_type").agg(F.count("*").alias("_copies"))
    joined = per_document.join(types, "document_id", "left").withColumn(
        "_copies", F.coalesce("_copies", F.lit(1))
    )

    def total(column: str):
        return F.sum(F.col(column) * F.col("_copies"))

    return joined.groupBy("file_type").agg(
        total("_n").alias("document_count"),
        F.try_divide(total("_conf"), total("_n_conf")).alias("avg_confidence"),
        F.try_divide(total("_orig"), total("_n_orig")).alias("avg_original_words"),
        F.try_divide(total("_simp"), total("_n_simp")).alias("avg_simplified_words"),
    )


def daily_processing(results: DataFrame) -> DataFrame:
    """Documents processed per day, newest day first."""
    return (
        results.groupBy(F.to_date("processing_timestamp").alias("date"))
        .agg(
            F.count("*").alias("documents_processed"),
            F.avg("processing_time_seconds").alias("avg_processing_time"),
        )
        .orderBy(F.desc("date"))
    )


def owned(metadata: DataFrame) -> DataFrame:
    """Documents that belong to a user."""
    return metadata.filter(F.col("user_id").isNotNull())


def user_uploads(metadata: DataFrame) -> DataFrame:
    """Uploads and stored bytes per user, most active first."""
    return (
        owned(metadata)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("documents_uploaded"),
            F.sum("file_size").alias("total_size_bytes"),
        )
        .orderBy(F.desc("documents_uploaded"), "user_id")
    )
