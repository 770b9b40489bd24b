"""Model responses made from the documents, structured and reported on."""

from pyspark.sql import functions as F

from clauselight.catalog import query
from clauselight.catalog.text import READING, measures_check
from clauselight.functions import records, report, response
from clauselight.functions.text import with_reading_level
from clauselight.sources.adapters import documents

_NL = "chr(10)"
_PLAIN = "translate(text, chr(34) || chr(92), '  ')"
_ESCAPED = f"replace({_PLAIN}, {_NL}, chr(92) || 'n')"
_LIST = f"'[\"' || replace({_PLAIN}, {_NL}, '\",\"') || '\"]'"
_SECTIONS = (
    f"'Summary' || {_NL} || text || {_NL} || 'Key Points:' || {_NL} || '- ' ||"
    f" replace(text, {_NL}, {_NL} || '* ') || {_NL} || 'Important Terms' || {_NL} || 'Lang: ' || lang ||"
    f" {_NL} || 'Source : ' || source || {_NL} || 'Lang: again ' || lang || {_NL} || '- dropped: x' || {_NL} ||"
    f" 'Warnings' || {_NL} || '- high risk of loss' || {_NL} || '• late fee ' || source || {_NL} ||"
    f" 'Next steps' || {_NL} || ' * sign ' || {_NL} || 'no bullet'"
)
# Every shape a response can take, each holding the whole text of its document.
RESPONSE = f"""CASE doc_id % 8
WHEN 0 THEN 'Here it is:' || {_NL} || '{{"summary": "' || {_ESCAPED} || '", "key_points": ' || {_LIST}
  || ', "important_terms": {{"lang": "' || lang || '", "source": " ' || source
  || ' ", "": "x", "none": ""}}, "deadlines_obligations": "due in ' || lang
  || '", "warnings": [], "next_steps": null}}' || {_NL} || 'Done.'
WHEN 1 THEN '{{"summary": " ' || {_ESCAPED} || ' "}}'
WHEN 2 THEN '{{"key_points": [1, true, null, "' || source || '", " "], "summary": null,'
  || ' "important_terms": ["q"], "warnings": false, "next_steps": 0, "deadlines_obligations": true,'
  || ' "note": "' || {_ESCAPED} || '"}}'
WHEN 3 THEN '{{"a": 1}} x {{"b": 2}}' || {_NL} || {_SECTIONS}
WHEN 4 THEN {_SECTIONS}
WHEN 5 THEN 'Summary:' || {_NL} || '- ' || text
WHEN 6 THEN 'Summary:' || {_NL} || '- ' || text || ' {{x}}'
ELSE text END"""

_STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"


def _as_text(j: str) -> str:
    return (
        f"CASE json_type({j}) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN"
        f" CASE WHEN CAST({j} AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END"
        f" WHEN 'VARCHAR' THEN json_extract_string({j}, '$') ELSE CAST({j} AS VARCHAR) END"
    )


def _truthy(j: str) -> str:
    return (
        f"CASE json_type({j}) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN CAST({j} AS VARCHAR) = 'true'"
        f" WHEN 'VARCHAR' THEN json_extract_string({j}, '$') <> ''"
        f" WHEN 'ARRAY' THEN CAST({j} AS VARCHAR) <> '[]' WHEN 'OBJECT' THEN CAST({j} AS VARCHAR) <> '{{}}'"
        f" ELSE CAST({j} AS DOUBLE) <> 0 END"
    )


def _json_list(name: str, keep_falsy: bool) -> str:
    j = f"json_extract(jv, '$.{name}')"
    keep = "true" if keep_falsy else _truthy(j)
    # A JSON null in a list arrives as an SQL NULL.
    item = f"(coalesce({_as_text('x')}, 'None'))"
    clean = f"lambda x: {_STRIP % item}"
    return (
        f"CASE WHEN {j} IS NULL THEN CAST([] AS VARCHAR[]) WHEN json_type({j}) = 'ARRAY' THEN"
        f" list_filter(list_transform(CAST({j} AS JSON[]), {clean}), lambda s: s <> '')"
        f" WHEN {keep} THEN list_filter([{_STRIP % ('(' + _as_text(j) + ')')}], lambda s: s <> '')"
        " ELSE CAST([] AS VARCHAR[]) END"
    )


_LISTS = ("key_points", "deadlines_obligations", "warnings", "next_steps")


def _heading() -> str:
    arms = []
    for section, words in response.SECTION_WORDS:
        test = " OR ".join(f"contains(lower(line), '{w}')" for w in words)
        arms.append(f"WHEN {test} THEN '{section}'")
    return f"CASE {' '.join(arms)} END"


def _bulleted(name: str) -> str:
    return (
        f"coalesce(list({_STRIP % 'substring(line, 2)'} ORDER BY pos)"
        f" FILTER (section = '{name}' AND bullet), CAST([] AS VARCHAR[])) AS {name}"
    )


def _join(items: str) -> str:
    return f"array_to_string({items}, '|')"


def structured_check(source: str = "documents") -> str:
    """The whole cascade in the other engine: lines are unnested and windowed."""
    fallback = {
        "key_points": f"['{response.FALLBACK_KEY_POINT}']",
        "deadlines_obligations": "CAST([] AS VARCHAR[])",
        "warnings": f"['{response.FALLBACK_WARNING}']",
        "next_steps": f"['{response.FALLBACK_NEXT_STEP}']",
    }
    lists = ",\n  ".join(
        f"CASE parse_path WHEN 'json' THEN {_json_list(n, n == 'key_points')}"
        f" WHEN 'text' THEN coalesce(b.{n}, CAST([] AS VARCHAR[])) WHEN 'fallback' THEN {fallback[n]} END AS {n}"
        for n in _LISTS
    )
    return rf"""
WITH responses AS (SELECT doc_id, {RESPONSE} AS response FROM {source}),
parsed AS (SELECT *, regexp_extract(response, '(?s)\{{.*\}}', 0) AS js FROM responses),
kinds AS (SELECT *, js <> '' AND json_valid(js) AS is_json,
  CASE WHEN js <> '' AND json_valid(js) THEN js END AS jv FROM parsed),
cut AS (SELECT doc_id, unnest(str_split(response, chr(10))) AS line,
  generate_subscripts(str_split(response, chr(10)), 1) AS pos FROM kinds WHERE NOT is_json),
stripped AS (SELECT doc_id, pos, {_STRIP % 'line'} AS line FROM cut),
headed AS (SELECT *, {_heading()} AS head FROM stripped WHERE line <> ''),
filled AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
  substring(line, 1, 1) IN ('-', '•', '*') AS bullet FROM headed),
body AS (SELECT * FROM filled WHERE head IS NULL AND section IS NOT NULL),
terms AS (SELECT doc_id, {_STRIP % "split_part(line, ':', 1)"} AS k,
    {_STRIP % "substring(line, position(':' IN line) + 1)"} AS v, pos
  FROM body WHERE section = 'important_terms' AND NOT bullet AND contains(line, ':')),
last_terms AS (SELECT doc_id, string_agg(k || '=' || v, '|' ORDER BY k) AS terms, count(*) AS n FROM (
    SELECT doc_id, k, arg_max(v, pos) AS v FROM terms GROUP BY doc_id, k) t GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(bool_or(section = 'summary' AND bullet), false) AS broken,
  arg_min(line, pos) FILTER (section = 'summary' AND NOT bullet) AS summary,
  {', '.join(_bulleted(n) for n in _LISTS)}
  FROM body GROUP BY doc_id),
pathed AS (SELECT k.*, CASE WHEN is_json THEN 'json' WHEN NOT coalesce(broken, false) THEN 'text'
  WHEN js = '' THEN 'fallback' ELSE 'error' END AS parse_path
  FROM kinds k LEFT JOIN b USING (doc_id)),
json_terms AS (SELECT doc_id, string_agg(k || '=' || v, '|' ORDER BY k) AS terms, count(*) AS n FROM (
    SELECT doc_id, {_STRIP % 'key'} AS k, {_STRIP % ('(' + _as_text("json_extract(t, '$.\"' || key || '\"')") + ')')} AS v
    FROM (SELECT doc_id, t, unnest(json_keys(t)) AS key FROM (
      SELECT doc_id, json_extract(jv, '$.important_terms') AS t FROM pathed WHERE parse_path = 'json') j
      WHERE json_type(t) = 'OBJECT') u
    WHERE key <> '' AND {_truthy("json_extract(t, '$.\"' || key || '\"')")}) e GROUP BY doc_id),
structured AS (SELECT p.doc_id, response, parse_path,
  CASE parse_path
    WHEN 'json' THEN coalesce({_STRIP % ('(' + _as_text("json_extract(jv, '$.summary')") + ')')}, '')
    WHEN 'text' THEN coalesce(b.summary, '')
    WHEN 'fallback' THEN response
  END AS summary,
  {lists},
  CASE parse_path WHEN 'json' THEN coalesce(jt.terms, '') WHEN 'text' THEN coalesce(lt.terms, '')
    WHEN 'fallback' THEN '' END AS terms,
  CASE parse_path WHEN 'json' THEN coalesce(jt.n, 0) WHEN 'text' THEN coalesce(lt.n, 0)
    WHEN 'fallback' THEN 0 END AS n_terms
  FROM pathed p LEFT JOIN b USING (doc_id) LEFT JOIN last_terms lt USING (doc_id)
  LEFT JOIN json_terms jt USING (doc_id)),
scored AS (SELECT *, CAST(0.5 AS DOUBLE)
  + CASE WHEN length(summary) > 50 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN len(key_points) > 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN n_terms > 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN len(next_steps) > 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence_score
  FROM structured)
"""


def responses(spark, sf_dir):
    return documents(spark, sf_dir).selectExpr(
        "CAST(doc_id AS STRING) AS document_id", "n_chars", f"{RESPONSE} AS response"
    )


def _flat_terms():
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries("important_terms")),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        "|",
    ).alias("terms")


@query(
    "rsp1_json_block",
    rf"""SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract(response, '(?s)\{{.*\}}', 0) AS json_block
FROM (SELECT doc_id, {RESPONSE} AS response FROM documents) r""",
)
def rsp1(spark, sf_dir):
    block = response.json_block(F.col("response")).alias("json_block")
    return responses(spark, sf_dir).select("document_id", block)


_FLAT_SQL = ", ".join(f"{_join(n)} AS {n}" for n in _LISTS)


@query(
    "rsp5_structured_responses",
    structured_check()
    + f"SELECT CAST(doc_id AS VARCHAR) AS document_id, parse_path, summary, terms, {_FLAT_SQL} FROM structured",
)
def rsp5(spark, sf_dir, only=None):
    out = response.with_structure(responses(spark, sf_dir), only=only)
    flat = [F.array_join(n, "|").alias(n) for n in _LISTS]
    return out.select("document_id", "parse_path", "summary", _flat_terms(), *flat)


def _by_path(name: str, path: str) -> None:
    """One query per way of reading a response."""

    @query(
        name,
        structured_check()
        + f"SELECT CAST(doc_id AS VARCHAR) AS document_id, summary, terms, {_FLAT_SQL}"
        + f" FROM structured WHERE parse_path = '{path}'",
    )
    def run(spark, sf_dir):
        return rsp5(spark, sf_dir, only=[path]).drop("parse_path")


_by_path("rsp2_json_responses", "json")
_by_path("rsp3_text_responses", "text")
_by_path("rsp4_fallback_responses", "fallback")


@query(
    "rsp6_confidence",
    structured_check()
    + "SELECT CAST(doc_id AS VARCHAR) AS document_id, parse_path,"
    " CASE WHEN parse_path <> 'error' THEN confidence_score END AS confidence_score FROM scored",
)
def rsp6(spark, sf_dir):
    out = response.with_structure(responses(spark, sf_dir))
    return out.select(
        "document_id", "parse_path", response.confidence().alias("confidence_score")
    )


def simplified(spark, sf_dir):
    """Simplified documents as they are stored, errors left out."""
    out = response.with_structure(responses(spark, sf_dir), only=["json", "text", "fallback"])
    done = with_reading_level(
        out.drop("response").withColumn("confidence_score", response.confidence()),
        "summary",
        words="word_count_simplified",
    )
    return done.withColumns(
        {
            "original_filename": F.concat(F.lit("doc_"), "document_id", F.lit(".txt")),
            "processing_timestamp": F.lit("2024-01-02 00:00:00").cast("timestamp"),
            "simplification_level": F.lit("standard"),
            "original_text": F.lit(None).cast("string"),
            "word_count_original": F.floor(F.col("n_chars") / 6).cast("bigint"),
        }
    )


_SIMPLIFIED_SQL = (
    structured_check()
    + f""", shown AS (SELECT * FROM scored WHERE parse_path <> 'error'),
measured AS (SELECT *, {READING} AS reading_level FROM ({measures_check(
    '(SELECT s.*, s.summary AS text, d.n_chars // 6 AS word_count_original FROM shown s JOIN documents d USING (doc_id))'
)}) z)
"""
)


@query(
    "prj4_result_rows",
    _SIMPLIFIED_SQL
    + """SELECT CAST(doc_id AS VARCHAR) AS document_id, TIMESTAMP '2024-01-02 00:00:00' AS processing_timestamp,
  'standard' AS simplification_level, confidence_score, CAST(word_count_original AS BIGINT) AS word_count_original,
  total_words AS word_count_simplified, reading_level, CAST(NULL AS DOUBLE) AS processing_time_seconds,
  CAST(NULL AS VARCHAR) AS extraction_method, CAST(NULL AS VARCHAR) AS language_detected,
  len(warnings) > 0 AS has_warnings, len(deadlines_obligations) > 0 AS has_deadlines,
  CAST(len(key_points) AS BIGINT) AS key_points_count, CAST(n_terms AS BIGINT) AS important_terms_count
FROM measured""",
)
def prj4(spark, sf_dir):
    return records.result_rows(simplified(spark, sf_dir))


@query(
    "fn19_report_figures",
    _SIMPLIFIED_SQL
    + """SELECT CAST(doc_id AS VARCHAR) AS document_id,
  CAST(CASE WHEN word_count_original > 0 THEN
    floor((1 - total_words / word_count_original) * 100 + 0.5) END AS BIGINT) AS reduction_percent,
  CAST(len(key_points) + n_terms AS BIGINT) AS key_insights,
  CAST(floor(confidence_score * 100 + 0.5) AS BIGINT) AS confidence_percent,
  CAST(len(key_points) AS BIGINT) AS key_points_tab, CAST(n_terms AS BIGINT) AS terms_tab,
  CAST(len(warnings) AS BIGINT) AS warnings_tab, CAST(len(next_steps) AS BIGINT) AS next_steps_tab
FROM measured""",
)
def fn19(spark, sf_dir):
    return simplified(spark, sf_dir).select(
        "document_id",
        report.reduction_percent(
            F.col("word_count_original"), F.col("word_count_simplified")
        ).alias("reduction_percent"),
        report.key_insights(F.col("key_points"), F.col("important_terms")).alias("key_insights"),
        report.confidence_percent(F.col("confidence_score")).alias("confidence_percent"),
        *report.tab_counts(),
    )


def _md(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda x: '- ' || x), chr(10))"


_MD_TERMS = "CASE WHEN terms = '' THEN '' ELSE regexp_replace(replace('**' || terms, '|', chr(10) || '**'), '=', '**: ', 'g') END"


REPORT_SQL = (
    _SIMPLIFIED_SQL
    + f"""SELECT CAST(doc_id AS VARCHAR) AS document_id,
  '# Simplified Legal Document: doc_' || CAST(doc_id AS VARCHAR) || '.txt' || chr(10) || chr(10)
  || '## Summary' || chr(10) || summary || chr(10) || chr(10)
  || '## Key Points' || chr(10) || {_md('key_points')} || chr(10) || chr(10)
  || '## Important Terms' || chr(10) || {_MD_TERMS} || chr(10) || chr(10)
  || '## Deadlines & Obligations' || chr(10) || {_md('deadlines_obligations')} || chr(10) || chr(10)
  || '## Warnings' || chr(10) || {_md('warnings')} || chr(10) || chr(10)
  || '## Next Steps' || chr(10) || {_md('next_steps')} || chr(10) || chr(10)
  || '---' || chr(10) || '*Simplified on 1/2/2024*' || chr(10) || '*Confidence Score: '
  || CAST(CAST(floor(confidence_score * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%*' || chr(10)
  || '*Reading Level: ' || reading_level || '*' AS markdown
FROM measured"""
)


@query("fn22_markdown_report", REPORT_SQL)
def fn22(spark, sf_dir):
    return simplified(spark, sf_dir).select("document_id", report.markdown().alias("markdown"))
