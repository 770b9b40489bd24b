"""Text measures: golden rows, and random texts against a plain statement of the rules."""

import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauselight.functions import text as tx


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("A  b\nPage 1 of 2 c [x] (y) d", "A b  c   d"),
        ("42 ", ""),
        ("12 apples", "12 apples"),
        ("(a (b) c)", "c)"),
        ("page 1 of 2", "page 1 of 2"),
        ("x" * 16_001, "x" * 16_001),
        ("x" * 16_000, "x" * 16_000),
        ("\U0001f600" * 16_001, "\U0001f600" * 16_001),
        ("a  \x1cb", "a b"),
        ("Page ١ of ٢!", "!"),
    ],
)
def test_normalise(spark, given_text, expected):
    out = frame(spark, [given_text]).select("id", tx.normalise(F.col("text")).alias("n"))
    assert values(out, "n") == [expected]


def test_legal_terms_are_counted_as_substrings(spark):
    out = frame(spark, ["Representation of DEFAULTS hereto.", "indemnification", ""])
    out = out.select("id", tx.legal_term_count(F.col("text")).alias("n"))
    assert values(out, "n") == [3, 1, 0]


def test_complex_sentences(spark):
    texts = ["w " * 26, "w " * 25, "a, b, c, d, e", "a, b, c, d"]
    out = tx.with_text_measures(frame(spark, texts))
    assert values(out, "complex_sentence_count") == [1, 0, 1, 0]
    assert values(out, "segments") == [1, 1, 1, 1]


def test_complexity_record(spark):
    legal = "hereby " + "w " * 9  # one term in ten words
    rare = "hereby " + "w " * 19  # one term in twenty words
    out = tx.with_complexity(frame(spark, ["", "Hi there.", legal, rare]))
    assert values(out, "complexity_level") == ["low", "low", "medium", "low"]
    assert values(out, "reading_level")[:2] == ["unknown", "elementary"]
    assert values(out, "legal_term_ratio") == [0.0, 0.0, 0.1, 0.05]
    assert values(out, "estimated_reading_time") == [1, 1, 1, 1]


def test_reading_minutes(spark):
    out = spark.createDataFrame([(199,), (399,), (400,)], "id int")
    out = out.select("id", tx.reading_minutes(F.col("id")).alias("m"))
    assert values(out, "m") == [1, 1, 2]


def test_no_term_hides_another():
    """Counting by removal is exact only when a term cannot overlap itself."""
    for term in tx.LEGAL_TERMS:
        assert not any(term.startswith(term[i:]) for i in range(1, len(term)))
    assert len(tx.LEGAL_TERMS) == 29


def test_white_space_is_all_white_space():
    assert set(tx.WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def plain_measures(text):
    words = text.split()
    segments = re.split("[.!?]+", text)
    busy = sum(len(s.split()) > 25 or s.count(",") > 3 for s in segments)
    return (
        len(words),
        sum(map(len, words)),
        len(segments),
        busy,
        sum(text.lower().count(t) for t in tx.LEGAL_TERMS),
    )


def plain_normalise(text):
    text = re.sub(r"\s+", " ", text)
    for pattern in (r"Page \d+ of \d+", r"(?m)^\d+\s*$", r"\[.*?\]", r"\(.*?\)"):
        text = re.sub(pattern, "", text)
    return text.strip()


pieces = st.one_of(
    st.sampled_from(
        [
            " ", "\n", "\t", ".", "!?", ",", ", , , ,", "(", ")", "[", "]", "Page 3 of 12",
            "42", "٤", " ", "\x1f", " ", "\x85", "hereby", "BREACH", "represents",
            "w " * 26, "é", "\U0001f600",
        ]
    ),
    st.text(max_size=8),
)
texts = st.lists(st.lists(pieces, max_size=14).map("".join), min_size=60, max_size=60)


@settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=list(HealthCheck),
    # Shrinking would run a Spark job per step.
    phases=[Phase.generate],
)
@given(texts)
def test_random_texts(spark, batch):
    # Lone surrogates cannot be stored as text.
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    measured = tx.with_text_measures(frame(spark, batch), prefix="m_")
    out = tx.with_complexity(measured)
    out = out.withColumn("n", tx.normalise(F.col("text"))).withColumn(
        "w", tx.word_count(F.col("text"))
    )
    rows = out.orderBy("id").collect()
    for text, row in zip(batch, rows):
        measured = (
            row["m_total_words"], row["m_word_chars"], row["m_segments"],
            row["complex_sentence_count"], row["legal_term_count"],
        )
        assert measured == plain_measures(text), repr(text)
        assert row["w"] == row["total_words"], repr(text)
        assert row["n"] == plain_normalise(text), repr(text)


def test_white_space_of_any_kind_is_collapsed(spark):
    """Every character on its own and in runs, against the class as one pattern."""
    point = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    rows = spark.range(0x3100).withColumn("c", point).select(
        F.concat(F.lit("a"), "c", F.lit("b "), "c", F.lit("\n"), "c", "c", F.lit(" c"), "c").alias("text")
    )
    plain = F.regexp_replace("text", tx.WHITESPACE_CLASS + "+", " ")
    assert rows.filter(tx.collapse(F.col("text")) != plain).count() == 0
    assert rows.filter(tx.spaced_word_count(tx.collapse(F.col("text"))) != tx.word_count(F.col("text"))).count() == 0
    # Runs of one space, which most are, are not matched.
    assert tx.WHITESPACE_CLASS + "+" not in str(tx.collapse(F.col("text")))
    edges = frame(spark, ["", " ", "\n", " \t ", None])
    assert values(edges.select("id", tx.spaced_word_count(tx.collapse(F.col("text"))).alias("n")), "n") == [0, 0, 0, 0, None]


def test_only_texts_that_may_hold_a_match_are_searched(spark):
    rows = frame(spark, ["7", "٣ ", " 7", "7 Page 1 of 2", "Page\n1 of 22", "Pages", "a [b", "[(] c)", "plain  text", "", None])
    assert values(rows.select("id", tx.normalise(F.col("text")).alias("n")), "n") == [
        "", "", "7", "", "", "Pages", "a [b", "c)", "plain text", "", None
    ]
    plan = rows.select(tx.normalise(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("Page \\p{Nd}+")
