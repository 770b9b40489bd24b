"""Keyed lookups and changes on tables without in-place updates.

Each function returns the new contents; write them to a new folder and switch
readers over, never onto the path being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselight.operators.skew import salted_join

UPDATED_COLUMNS = (
    "processing_timestamp",
    "status",
    "extraction_method",
    "ocr_confidence",
    "language_detected",
    "processed_path",
)
SALTS = 64


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to order or spread rows that agree on the key."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row per key in the given order, ties broken by row contents.

    Spark drops all but the best row per key and task before the shuffle, so a
    key with many rows is never brought together.
    """
    window = Window.partitionBy(key).orderBy(*order, row_hash(df))
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def stage(status: Column) -> Column:
    """How far a document has come; unknown states come first."""
    done = F.when(status.isin("completed", "failed"), 3)
    return F.coalesce(done, F.when(status == "processing", 2), F.when(status == "uploaded", 1), F.lit(0))


def latest_metadata(metadata: DataFrame, document_id: str | None = None) -> DataFrame:
    """Current metadata row per document; with an id, a point lookup."""
    if document_id is not None:
        metadata = metadata.filter(F.col("document_id") == document_id)
    return latest(
        metadata,
        "document_id",
        F.desc_nulls_last("processing_timestamp"),
        F.desc("upload_timestamp"),
        # A failed document has no processing time: the later stage is the newer row.
        F.desc(stage(F.col("status"))),
    )


def latest_documents(
    metadata: DataFrame, user_id: str | None = None, limit: int = 50
) -> DataFrame:
    """The most recent uploads of one user, or of every user."""
    order = [F.desc("upload_timestamp"), F.asc("document_id")]
    if user_id is not None:
        return metadata.filter(F.col("user_id") == user_id).orderBy(*order).limit(limit)
    rows = metadata.filter(F.col("user_id").isNotNull())
    # Within slices of a user first, then among what is left of them: however long the
    # list, no task holds all rows of a user.
    sliced = Window.partitionBy("user_id", "_part").orderBy(*order)
    rows = (
        rows.withColumn("_part", F.pmod(F.xxhash64("document_id"), F.lit(SALTS)))
        .withColumn("_rank", F.row_number().over(sliced))
        .filter(F.col("_rank") <= limit)
        .drop("_part", "_rank")
    )
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    )
    return ranked.filter(F.col("rank") <= limit)


def update_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply keyed changes; unknown keys are ignored.

    ``changes`` holds ``document_id`` and any of the updatable columns. Of several
    changes to a document the latest by processing time counts, then the later
    stage. A NULL in a change overwrites; a column the change set does not carry
    is left alone.
    """
    changed = [c for c in UPDATED_COLUMNS if c in changes.columns]
    order = []
    if "processing_timestamp" in changed:
        order.append(F.desc_nulls_last("processing_timestamp"))
    if "status" in changed:
        order.append(F.desc(stage(F.col("status"))))
    incoming = latest(changes.select("document_id", *changed), "document_id", *order).select(
        "document_id",
        F.struct(*[F.col(c) for c in changed]).alias("_change"),
    )
    joined = salted_join(metadata, incoming, "document_id", "left")
    matched = F.col("_change").isNotNull()
    return joined.select(
        *[
            F.when(matched, F.col(f"_change.{c}").cast(metadata.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            if c in changed
            else F.col(c)
            for c in metadata.columns
        ]
    )


def delete_documents(rows: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Rows whose document is not in the delete set.

    Apply to metadata, raw uploads and simplified documents. Usage events and
    processing results are kept as the record of what happened.
    """
    keys = document_ids.select("document_id").distinct()
    return salted_join(rows, keys, "document_id", "left_anti")
