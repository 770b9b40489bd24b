"""Text measures and the corpus report."""

from pyspark.sql import functions as F

from clauselight.catalog import query, rounded
from clauselight.functions import text as tx
from clauselight.plans import corpus
from clauselight.sources.adapters import texts

# The same white space in the other engine's regular expressions.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
FLAT = f"regexp_replace(text, '{WS}+', ' ', 'g')"

NORMALISED = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({FLAT},"
    r" 'Page \p{Nd}+ of \p{Nd}+', '', 'g'), '^\p{Nd}+\s*$', '', 'g'),"
    r" '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g')"
)


def normalised_check(source: str) -> str:
    """Every column of a source with a text, plus the cleaned text."""
    return (
        f"SELECT *, trim(n) AS cleaned FROM (SELECT *, {NORMALISED} AS n FROM {source}) t"
    )


_TERMS = " + ".join(
    f"(length(lo) - length(replace(lo, '{t}', ''))) // {len(t)}" for t in tx.LEGAL_TERMS
)
_WORDS = f"len(list_filter(regexp_split_to_array(%s, '{WS}+'), lambda w: w <> ''))"


def measures_check(source: str) -> str:
    """Every column of a source with a text, plus its measures."""
    words = _WORDS % "text"
    sentence_words = _WORDS % "s"
    return f"""SELECT *, CAST({_TERMS} AS BIGINT) AS legal_term_count,
  CAST({words} AS BIGINT) AS total_words,
  CAST(length(regexp_replace(text, '{WS}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(seg) AS BIGINT) AS segments,
  CAST(len(list_filter(seg, lambda s: {sentence_words} > 25
    OR length(s) - length(replace(s, ',', '')) > 3)) AS BIGINT) AS complex_sentence_count
FROM (SELECT *, lower(text) AS lo, regexp_split_to_array(text, '[.!?]+') AS seg FROM {source}) m"""


READING = """CASE WHEN total_words = 0 THEN 'unknown'
  WHEN total_words / segments < 10 AND word_chars / total_words < 5 THEN 'elementary'
  WHEN total_words / segments < 15 AND word_chars / total_words < 6 THEN 'intermediate'
  WHEN total_words / segments < 20 AND word_chars / total_words < 7 THEN 'high_school'
  ELSE 'college' END"""

_COMPLEXITY = f"""SELECT *, CASE WHEN tr > 0.1 OR sr > 0.3 THEN 'high'
  WHEN tr > 0.05 OR sr > 0.15 THEN 'medium' ELSE 'low' END AS complexity_level,
  greatest(1, total_words // 200) AS estimated_reading_time, {READING} AS reading_level
FROM (SELECT *, CASE WHEN total_words > 0 THEN legal_term_count / total_words ELSE 0 END AS tr,
  CASE WHEN text <> '' THEN complex_sentence_count / segments ELSE 0 END AS sr
  FROM ({measures_check('documents')}) a) b"""


@query("fn1_normalised_text", f"""
SELECT CAST(doc_id AS STRING) AS document_id, cleaned FROM ({normalised_check('documents')}) q""")
def fn1(spark, sf_dir):
    return texts(spark, sf_dir).select("document_id", tx.normalise(F.col("text")).alias("cleaned"))


@query("fn2_legal_term_count", f"""
SELECT CAST(doc_id AS STRING) AS document_id, legal_term_count FROM ({measures_check('documents')}) q""")
def fn2(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "document_id", tx.legal_term_count(F.col("text")).alias("legal_term_count")
    )


@query("fn3_complex_sentence_count", f"""
SELECT CAST(doc_id AS STRING) AS document_id, complex_sentence_count
FROM ({measures_check('documents')}) q""")
def fn3(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "document_id", tx.complex_sentence_count(F.col("text")).alias("complex_sentence_count")
    )


@query("fn4_complexity", f"""
SELECT CAST(doc_id AS STRING) AS document_id, complexity_level, legal_term_count,
  round(tr, 6) AS legal_term_ratio, complex_sentence_count, round(sr, 6) AS complex_sentence_ratio,
  total_words, CAST(estimated_reading_time AS BIGINT) AS estimated_reading_time
FROM ({_COMPLEXITY}) q""")
def fn4(spark, sf_dir):
    out = tx.with_complexity(texts(spark, sf_dir)).drop("text", "lang", "source", "reading_level")
    return rounded(out, "legal_term_ratio", "complex_sentence_ratio")


@query("fn5_reading_level", f"""
SELECT CAST(doc_id AS STRING) AS document_id, reading_level FROM ({_COMPLEXITY}) q""")
def fn5(spark, sf_dir):
    measured = tx.with_reading_level(texts(spark, sf_dir), "text")
    return measured.select("document_id", "reading_level")


@query("fn6_reading_minutes", f"""
SELECT CAST(doc_id AS STRING) AS document_id,
  CAST(estimated_reading_time AS BIGINT) AS estimated_reading_time FROM ({_COMPLEXITY}) q""")
def fn6(spark, sf_dir):
    minutes = tx.reading_minutes(tx.word_count(F.col("text")))
    return texts(spark, sf_dir).select("document_id", minutes.alias("estimated_reading_time"))


@query("fn7_word_count", f"""
SELECT CAST(doc_id AS STRING) AS document_id, total_words FROM ({measures_check('documents')}) q""")
def fn7(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "document_id", tx.word_count(F.col("text")).alias("total_words")
    )


@query("job6_corpus_complexity", f"""
SELECT lang, source, count(*) AS documents, CAST(sum(total_words) AS BIGINT) AS total_words,
  CAST(sum(legal_term_count) AS BIGINT) AS legal_terms,
  CAST(sum(complex_sentence_count) AS BIGINT) AS complex_sentences,
  CAST(sum(estimated_reading_time) AS BIGINT) AS reading_minutes,
  round(avg(sr), 6) AS average_complex_ratio, round(avg(tr), 6) AS average_legal_ratio,
  CAST(count_if(complexity_level = 'high') AS BIGINT) AS high_complexity,
  CAST(count_if(complexity_level = 'medium') AS BIGINT) AS medium_complexity,
  CAST(count_if(complexity_level = 'low') AS BIGINT) AS low_complexity,
  CAST(count_if(reading_level = 'college') AS BIGINT) AS college_level
FROM ({_COMPLEXITY}) q GROUP BY lang, source""")
def job6(spark, sf_dir):
    out = corpus.complexity_report(texts(spark, sf_dir))
    return rounded(out, "average_complex_ratio", "average_legal_ratio")
