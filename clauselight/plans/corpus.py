"""Corpus-wide text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.functions.text import with_complexity


def complexity_report(documents: DataFrame, text: str = "text") -> DataFrame:
    """Complexity and reading effort by language and source.

    One pass over the texts; only one row per task and group is shuffled.
    """

    def level(name: str):
        return F.count_if(F.col("complexity_level") == name)

    return (
        with_complexity(documents, text)
        .groupBy("lang", "source")
        .agg(
            F.count("*").alias("documents"),
            F.sum("total_words").alias("total_words"),
            F.sum("legal_term_count").alias("legal_terms"),
            F.sum("complex_sentence_count").alias("complex_sentences"),
            F.sum("estimated_reading_time").alias("reading_minutes"),
            F.avg("complex_sentence_ratio").alias("average_complex_ratio"),
            F.avg("legal_term_ratio").alias("average_legal_ratio"),
            level("high").alias("high_complexity"),
            level("medium").alias("medium_complexity"),
            level("low").alias("low_complexity"),
            F.count_if(F.col("reading_level") == "college").alias("college_level"),
        )
    )
