"""Batch requests: explode, look up, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.operators.keyed import latest_metadata
from clauselight.operators.skew import salted_join

NOT_FOUND = "Document not found"


def batch_items(requests: DataFrame) -> DataFrame:
    """One row per requested document, in request order, repeats kept."""
    rest = [c for c in requests.columns if c != "document_ids"]
    return requests.select(
        *rest, F.posexplode("document_ids").alias("position", "document_id")
    )


def look_up(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add the current metadata to each item, or an error where there is none."""
    current = latest_metadata(metadata).withColumn("_found", F.lit(True))
    joined = salted_join(items, current, "document_id", "left")
    return joined.withColumn(
        "error", F.when(F.col("_found").isNull(), NOT_FOUND)
    ).drop("_found")


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Requested, processed and failed documents per batch, and the time they took."""
    seconds = F.col("processing_time") if "processing_time" in outcomes.columns else F.lit(0.0)
    return outcomes.groupBy("batch_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("error").isNull()).alias("processed_documents"),
        F.count("error").alias("failed_documents"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("processing_time"),
    )
