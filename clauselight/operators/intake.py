"""Upload checks: good rows go on, the others are kept with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of an upload unless the caller sets others.
MAX_FILE_BYTES = 10 * 1024 * 1024
CONTENT_TYPES = (
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "image/jpeg",
    "image/png",
    "image/tiff",
    "text/plain",
)


def reject_reason(
    filename: Column,
    size: Column,
    content_type: Column,
    *,
    max_bytes: int = MAX_FILE_BYTES,
    content_types: Sequence[str] = CONTENT_TYPES,
) -> Column:
    """The first check an upload fails; NULL when it passes all of them."""
    return (
        F.when(F.coalesce(filename, F.lit("")) == "", "no_filename")
        .when(size > max_bytes, "too_large")
        .when(~F.coalesce(content_type.isin(*content_types), F.lit(False)), "unsupported_type")
    )


def checked(uploads: DataFrame, **limits) -> DataFrame:
    """Uploads with their size and the reason for a rejection, if any.

    ``limits`` are those of ``reject_reason``.
    """
    sized = uploads.withColumn("file_size", F.octet_length("content").cast("bigint"))
    return sized.withColumn(
        "reject_reason",
        reject_reason(F.col("filename"), F.col("file_size"), F.col("content_type"), **limits),
    )
