"""Figures and the Markdown report shown for a simplified document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round_half_up(value: Column) -> Column:
    """Nearest whole number, exact halves towards plus infinity."""
    return F.floor(value + 0.5).cast("bigint")


def reduction_percent(original: Column, simplified: Column) -> Column:
    """How much shorter the simplified text is; NULL without an original."""
    return _round_half_up((F.lit(1) - F.try_divide(simplified, original)) * 100)


def confidence_percent(score: Column) -> Column:
    return _round_half_up(score * 100)


def key_insights(key_points: Column, terms: Column) -> Column:
    return (F.size(key_points) + F.size(terms)).cast("bigint")


def tab_counts() -> list[Column]:
    """Number of entries per section of the report."""
    sections = {
        "key_points": "key_points_tab",
        "important_terms": "terms_tab",
        "warnings": "warnings_tab",
        "next_steps": "next_steps_tab",
    }
    return [F.size(c).cast("bigint").alias(name) for c, name in sections.items()]


def _bullets(items: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def markdown() -> Column:
    """The report of one simplified document; terms in alphabetical order."""
    terms = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("important_terms")),
            lambda e: F.concat(F.lit("**"), e["key"], F.lit("**: "), e["value"]),
        ),
        "\n",
    )
    # Headings and footer.
    sections = (
        ("Summary", F.col("summary")),
        ("Key Points", _bullets("key_points")),
        ("Important Terms", terms),
        ("Deadlines & Obligations", _bullets("deadlines_obligations")),
        ("Warnings", _bullets("warnings")),
        ("Next Steps", _bullets("next_steps")),
    )
    parts = [F.concat(F.lit("# Simplified Legal Document: "), F.col("original_filename"))]
    parts += [F.concat(F.lit(f"## {title}\n"), body) for title, body in sections]
    footer = F.concat(
        F.lit("---\n*Simplified on "),
        F.date_format("processing_timestamp", "M/d/yyyy"),
        F.lit("*\n*Confidence Score: "),
        confidence_percent(F.col("confidence_score")).cast("string"),
        F.lit("%*\n*Reading Level: "),
        F.col("reading_level"),
        F.lit("*"),
    )
    return F.concat_ws("\n\n", *parts, footer)
