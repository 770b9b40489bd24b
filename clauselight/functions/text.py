"""Text measures as native column expressions.

``with_text_measures`` lays the shared intermediate columns out in stages, so
each text is scanned once for whitespace and once for sentences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters treated as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
# The same without the plain space; nearly all characters fail its first two tests.
_OTHER_SPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)

# The legal vocabulary that is counted.
LEGAL_TERMS = (
    "whereas", "hereby", "herein", "hereof", "hereto", "hereunder",
    "pursuant", "notwithstanding", "aforesaid", "aforementioned",
    "indemnify", "indemnification", "liability", "obligation",
    "covenant", "warrant", "represent", "guarantee", "undertake",
    "breach", "default", "termination", "rescission", "remedy",
    "damages", "penalty", "liquidated", "consequential", "incidental",
)

# Thresholds.
LONG_SENTENCE_WORDS = 25
MANY_COMMAS = 3
WORDS_PER_MINUTE = 200
SENTENCE_END = "[.!?]+"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space.

    Most runs are one space already: only the others are matched.
    """
    spaced = F.regexp_replace(text, _OTHER_SPACE + "++", " ")
    return F.regexp_replace(spaced, "  +", " ")


def normalise(text: Column, max_chars: int | None = None, *, collapsed: bool = False) -> Column:
    """Clean a text for a prompt.

    White space is collapsed, page markers, a text that is only a number,
    bracketed and parenthesised spans are removed in that order, and the rest
    is trimmed. Gaps left by a removal stay. The whole text is kept unless the
    caller sets ``max_chars``. A ``collapsed`` text has been through ``collapse``.
    """
    flat = text if collapsed else collapse(text)
    cleaned = flat
    for pattern in (
        r"Page \p{Nd}+ of \p{Nd}+",
        r"^\p{Nd}+\s*$",
        r"\[[^\]]*\]",
        r"\([^)]*\)",
    ):
        cleaned = F.regexp_replace(cleaned, pattern, "")
    # Most texts hold nothing to remove: they are not searched pattern by pattern.
    marks = [F.contains(text, F.lit(mark)) for mark in ("Page", "[", "(")]
    first = F.substring(text, 1, 1).rlike(r"\p{Nd}")
    cleaned = F.when(reduce(Column.__or__, marks, first), cleaned).otherwise(flat)
    if max_chars is not None:
        # One pattern keeps the text a single subexpression.
        cleaned = F.regexp_replace(cleaned, r"(?s)^(.{%d}).+$" % max_chars, "$1...")
    return F.trim(cleaned)


def _occurrences(text: Column, ascii_term: str) -> Column:
    """Non-overlapping occurrences of an ASCII string.

    Byte lengths are stored with the value; character lengths need a scan.
    """
    removed = F.replace(text, F.lit(ascii_term), F.lit(""))
    return (F.octet_length(text) - F.octet_length(removed)) / len(ascii_term)


def legal_term_count(text: Column) -> Column:
    """Substring occurrences of the legal vocabulary, each term on its own."""
    return lowered_term_count(F.lower(text))


def lowered_term_count(lowered: Column) -> Column:
    """Occurrences in a text already in lower case.

    Each term is a search of its own, as terms are counted independently. Most
    texts lack most terms: only those found in the bytes are counted in the characters.
    """
    counts = [
        F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(term))).otherwise(F.lit(0))
        for term in LEGAL_TERMS
    ]
    # A missing text has no count.
    return F.when(lowered.isNotNull(), reduce(Column.__add__, counts)).cast("bigint")


def _single_spaced_words(trimmed: Column) -> Column:
    """Words of a text whose only white space is single inner spaces."""
    gaps = _occurrences(trimmed, " ")
    return F.when(trimmed == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


def spaced_word_count(collapsed: Column) -> Column:
    """``word_count`` of a text that has been through ``collapse``: counts bytes, lists no words."""
    return _single_spaced_words(F.trim(collapsed))


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(text, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+")).cast("bigint")


def _is_complex(sentence: Column) -> Column:
    """Whether a piece of a collapsed text is long or heavy with commas."""
    size = F.octet_length(sentence)
    gaps = _occurrences(sentence, " ")
    outer = F.startswith(sentence, F.lit(" ")).cast("int") + F.endswith(
        sentence, F.lit(" ")
    ).cast("int")
    # n words take n - 1 gaps and at least 2n - 1 bytes; most pieces are shorter.
    long = (size > 2 * LONG_SENTENCE_WORDS) & (gaps - outer >= LONG_SENTENCE_WORDS)
    return long | ((size > MANY_COMMAS) & (_occurrences(sentence, ",") > MANY_COMMAS))


def complex_sentence_count(text: Column) -> Column:
    """Segments between sentence ends that are long or heavy with commas."""
    return F.size(F.filter(F.split(collapse(text), SENTENCE_END), _is_complex)).cast("bigint")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / WORDS_PER_MINUTE)).cast("bigint")


def with_text_measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``total_words``, ``word_chars``, ``segments``, ``complex_sentence_count``.

    Segments are the pieces between sentence ends; the piece after the last
    one counts too, even when empty. ``prefix`` goes before the new names.
    """
    kept = df.columns
    staged = df.withColumn("_flat", collapse(F.col(text)))
    staged = staged.withColumns(
        {
            "_trimmed": F.trim("_flat"),
            "_segments": F.split("_flat", SENTENCE_END),
        }
    )
    solid = F.replace(F.col("_trimmed"), F.lit(" "), F.lit(""))
    return staged.select(
        *[F.col(c) for c in kept],
        _single_spaced_words(F.col("_trimmed")).alias(f"{prefix}total_words"),
        F.length(solid).cast("bigint").alias(f"{prefix}word_chars"),
        F.size("_segments").cast("bigint").alias(f"{prefix}segments"),
        F.size(F.filter("_segments", _is_complex))
        .cast("bigint")
        .alias(f"{prefix}complex_sentence_count"),
    )


def reading_level_of(words: Column, word_chars: Column, segments: Column) -> Column:
    sentence = words / segments
    word = F.try_divide(word_chars, words)
    return (
        F.when(words.isNull(), F.lit(None).cast("string"))
        .when(words == 0, "unknown")
        .when((sentence < 10) & (word < 5), "elementary")
        .when((sentence < 15) & (word < 6), "intermediate")
        .when((sentence < 20) & (word < 7), "high_school")
        .otherwise("college")
    )


def complexity_level_of(term_ratio: Column, sentence_ratio: Column) -> Column:
    return (
        F.when((term_ratio > 0.1) | (sentence_ratio > 0.3), "high")
        .when((term_ratio > 0.05) | (sentence_ratio > 0.15), "medium")
        .otherwise("low")
    )


def with_complexity(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the complexity record and the reading level of a text column."""
    kept = df.columns
    lowered = with_text_measures(df, text, "_").withColumn("_lower", F.lower(F.col(text)))
    counted = lowered.withColumn("_legal_terms", lowered_term_count(F.col("_lower")))
    words, terms, complex_ones = (
        F.col(c) for c in ("_total_words", "_legal_terms", "_complex_sentence_count")
    )
    ratios = counted.withColumns(
        {
            "_term_ratio": F.when(words > 0, terms / words).otherwise(F.lit(0.0)),
            "_sentence_ratio": F.when(
                F.col(text) != "", complex_ones / F.col("_segments")
            ).otherwise(F.lit(0.0)),
        }
    )
    term_ratio, sentence_ratio = F.col("_term_ratio"), F.col("_sentence_ratio")
    return ratios.select(
        *[F.col(c) for c in kept],
        complexity_level_of(term_ratio, sentence_ratio).alias("complexity_level"),
        terms.alias("legal_term_count"),
        term_ratio.alias("legal_term_ratio"),
        complex_ones.alias("complex_sentence_count"),
        sentence_ratio.alias("complex_sentence_ratio"),
        words.alias("total_words"),
        reading_minutes(words).alias("estimated_reading_time"),
        reading_level_of(words, F.col("_word_chars"), F.col("_segments")).alias("reading_level"),
    )


def with_reading_level(
    df: DataFrame, text: str, level: str = "reading_level", words: str | None = None
) -> DataFrame:
    """Add the reading level of a text column, and its word count on request."""
    kept = df.columns
    measured = with_text_measures(df, text, "_")
    total = F.col("_total_words")
    return measured.select(
        *[F.col(c) for c in kept if c != level],
        reading_level_of(total, F.col("_word_chars"), F.col("_segments")).alias(level),
        *([total.alias(words)] if words else []),
    )
