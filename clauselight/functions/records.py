"""Coercion of raw rows to the table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselight.functions.response import strict_json
from clauselight.schemas import DOCUMENT_METADATA, USAGE_ANALYTICS

OPTIONAL_METADATA = (
    "user_id",
    "extraction_method",
    "language_detected",
    "processed_path",
)


def json_metadata(metadata: Column) -> Column:
    """JSON text stays as it is; any other text is wrapped as ``{"value": text}``."""
    wrapped = F.to_json(F.struct(metadata.alias("value")))
    return F.when(
        metadata.isNotNull(),
        F.when(strict_json(metadata).isNotNull(), metadata).otherwise(wrapped),
    )


def _metadata_column(raw: DataFrame) -> Column:
    if "metadata" not in raw.columns:
        return F.lit("{}")
    if isinstance(raw.schema["metadata"].dataType, T.StringType):
        return json_metadata(F.col("metadata"))
    return F.to_json("metadata", {"ignoreNullFields": "false"})


def coerce_events(raw: DataFrame) -> DataFrame:
    """Cast raw events to the event schema and name the first column that fails.

    ``reject_reason`` is NULL for a good row, otherwise ``missing_<column>`` or
    ``invalid_<column>``. Missing optional columns become NULL.
    """
    values, reasons = {}, []
    for field in USAGE_ANALYTICS.fields:
        name = field.name
        if name == "metadata":
            values[name] = _metadata_column(raw)
            continue
        given = F.col(name) if name in raw.columns else F.lit(None)
        cast = given.try_cast(field.dataType)
        values[name] = cast
        if not field.nullable:
            reasons.append(F.when(given.isNull(), f"missing_{name}"))
        reasons.append(F.when(given.isNotNull() & cast.isNull(), f"invalid_{name}"))
    return raw.select(
        *[values[f.name].alias(f.name) for f in USAGE_ANALYTICS.fields],
        F.coalesce(*reasons).alias("reject_reason"),
    )


def accepted(coerced: DataFrame) -> DataFrame:
    return coerced.filter("reject_reason IS NULL").drop("reject_reason")


def rejected(coerced: DataFrame) -> DataFrame:
    return coerced.filter("reject_reason IS NOT NULL")


def metadata_rows(documents: DataFrame) -> DataFrame:
    """Metadata in table form: empty optional texts become NULL."""
    return documents.select(
        *[
            (F.nullif(F.col(f.name), F.lit("")) if f.name in OPTIONAL_METADATA else F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in DOCUMENT_METADATA.fields
        ]
    )


def result_rows(simplified: DataFrame) -> DataFrame:
    """Simplified documents as flat result rows.

    Processing time, method and language are filled in later, from the events
    and the metadata.
    """
    return simplified.select(
        "document_id",
        "processing_timestamp",
        "simplification_level",
        "confidence_score",
        "word_count_original",
        "word_count_simplified",
        "reading_level",
        F.lit(None).cast("double").alias("processing_time_seconds"),
        F.lit(None).cast("string").alias("extraction_method"),
        F.lit(None).cast("string").alias("language_detected"),
        (F.size("warnings") > 0).alias("has_warnings"),
        (F.size("deadlines_obligations") > 0).alias("has_deadlines"),
        F.size("key_points").cast("bigint").alias("key_points_count"),
        F.size("important_terms").cast("bigint").alias("important_terms_count"),
    )
