"""The lifecycle jobs over the documents, with a stand-in for the model."""

from datetime import datetime

from pyspark.sql import functions as F

from clauselight.catalog import query
from clauselight.catalog.extraction import _NAME
from clauselight.catalog.responses import _flat_terms
from clauselight.catalog.storage import delete_set
from clauselight.catalog.text import READING, WS, measures_check, normalised_check
from clauselight.functions import extraction, prompts
from clauselight.operators import batch, intake
from clauselight.operators.keyed import update_metadata
from clauselight.operators.skew import salted_join
from clauselight.plans import lifecycle
from clauselight.plans.calls import Ledger
from clauselight.sources.adapters import METADATA_SQL, document_metadata, documents, table, texts

AS_OF = datetime(2024, 3, 1)
_AS_OF = f"TIMESTAMP '{AS_OF}'"
SHORT = 40


def stand_in(mark: str, end: str | None = None):
    """A fixed function in place of a model: it repeats the document.

    It fails on documents it finds too short. Defined inside a function so that
    tasks receive its code and need not import this module.
    """

    def generate(prompt: str) -> str:
        import json

        document = prompt.split(mark, 1)[1]
        if end is not None:
            document = document.split(end, 1)[0]
        if len(document) < 40:
            raise ValueError("too short")
        if end is not None:
            return document
        return json.dumps(
            {
                "summary": document,
                "key_points": [document, " "],
                "important_terms": {"length": str(len(document))},
                "deadlines_obligations": [f"within {len(document)} days"],
                "warnings": ["long"] if len(document) > 1000 else [],
                "next_steps": ["review"],
            }
        )

    return generate


# --- validation and ingest -------------------------------------------------

_TYPE = (
    "CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain'"
    " WHEN 2 THEN 'image/tiff' ELSE 'text/html' END"
)
_FILE = f"CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_NAME} END"


def _reason(size: str) -> str:
    types = ", ".join(f"'{t}'" for t in intake.CONTENT_TYPES)
    return (
        f"CASE WHEN filename = '' THEN 'no_filename' WHEN {size} > {intake.MAX_FILE_BYTES}"
        f" THEN 'too_large' WHEN content_type NOT IN ({types}) THEN 'unsupported_type' END"
    )


@query(
    "flt7_upload_checks",
    f"""SELECT doc_id, {_reason('size')} AS reject_reason FROM (
  SELECT doc_id, {_FILE} AS filename, {_TYPE} AS content_type, n_chars * 5000 AS size FROM documents) u""",
)
def flt7(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{_FILE} AS filename", f"{_TYPE} AS content_type", "n_chars * 5000 AS size"
    )
    reason = intake.reject_reason(F.col("filename"), F.col("size"), F.col("content_type"))
    return rows.select("doc_id", reason.alias("reject_reason"))


_UPLOADS = (
    f"SELECT CAST(doc_id AS VARCHAR) AS document_id, {_FILE} AS filename, {_TYPE} AS content_type,"
    " 'user_' || source AS user_id, CAST(strlen(text) AS BIGINT) AS file_size FROM documents"
)
_KIND = """CASE lower(regexp_extract(filename, '[^.]*$')) WHEN 'pdf' THEN 'pdf' WHEN 'doc' THEN 'doc'
  WHEN 'docx' THEN 'docx' WHEN 'jpeg' THEN 'image' WHEN 'tiff' THEN 'image' ELSE 'text' END"""


def _ingested(spark, sf_dir):
    uploads = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.expr(_FILE).alias("filename"),
        F.expr(_TYPE).alias("content_type"),
        F.concat(F.lit("user_"), "source").alias("user_id"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return lifecycle.ingest(uploads, lifecycle.new_workdir(spark, "ingest"), AS_OF)


@query(
    "job1_ingested_metadata",
    f"""SELECT document_id, filename, file_type, file_size, {_AS_OF} AS upload_timestamp, 'uploaded' AS status, user_id,
  CASE file_type WHEN 'pdf' THEN 'pdfplumber' WHEN 'image' THEN 'ocr' WHEN 'doc' THEN 'python-docx'
    WHEN 'docx' THEN 'python-docx' END AS extraction_method,
  'uploads/' || document_id || '/' || filename AS storage_path
FROM (SELECT *, {_KIND} AS file_type FROM ({_UPLOADS}) u WHERE {_reason('file_size')} IS NULL) v""",
)
def job1(spark, sf_dir):
    return _ingested(spark, sf_dir).metadata.drop(
        "processing_timestamp", "ocr_confidence", "language_detected", "processed_path"
    )


@query(
    "job1_rejected_uploads",
    f"""SELECT filename, content_type, file_size, user_id, {_reason('file_size')} AS reject_reason
FROM ({_UPLOADS}) u WHERE {_reason('file_size')} IS NOT NULL""",
)
def job1_rejected(spark, sf_dir):
    return _ingested(spark, sf_dir).rejected


@query(
    "job1_upload_events",
    f"""SELECT document_id, user_id, 'document_upload' AS action, {_AS_OF} AS timestamp, file_size,
  '{{"file_size":' || CAST(file_size AS VARCHAR) || ',"file_type":"' || {_KIND} || '"}}' AS metadata
FROM ({_UPLOADS}) u WHERE {_reason('file_size')} IS NULL""",
)
def job1_events(spark, sf_dir):
    return _ingested(spark, sf_dir).events.select(
        "document_id", "user_id", "action", "timestamp", "file_size", "metadata"
    )


# --- processing ------------------------------------------------------------

_LEVEL = (
    "CASE WHEN source = 'src1' THEN 'basic' WHEN source = 'src2' THEN 'detailed'"
    " WHEN source = 'src3' THEN 'brief' ELSE 'standard' END"
)
_AUDIENCE = (
    "CASE lang WHEN 'en' THEN 'general_public' WHEN 'fr' THEN 'business_owners'"
    " WHEN 'de' THEN 'students' ELSE 'somebody_else' END"
)
_TEXT_WORDS = f"len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))"
# What the stand-in makes of every document.
_OUTCOMES = f"""
normalised AS (SELECT doc_id, lang, source, text AS original, cleaned AS text,
    CAST({_TEXT_WORDS} AS BIGINT) AS word_count_original FROM ({normalised_check('documents')}) n),
measured AS (SELECT *, {READING} AS reading_level FROM ({measures_check('normalised')}) m),
outcomes AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text AS summary, original, lang, source, word_count_original,
    total_words AS word_count_simplified, reading_level, trim(text) AS key_point,
    CASE WHEN original = '' THEN '{lifecycle.NO_TEXT}' WHEN length(text) < {SHORT} THEN 'too short' END AS error,
    CAST(0.5 AS DOUBLE) + CASE WHEN length(text) > 50 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS confidence_score
  FROM measured)"""


def _processed(spark, sf_dir, items, ledger=None):
    return lifecycle.process(
        items,
        document_metadata(spark, sf_dir),
        texts(spark, sf_dir),
        stand_in(prompts.DOCUMENT_MARK),
        lifecycle.new_workdir(spark, "process"),
        as_of=AS_OF,
        ledger=ledger,
    )


def _all_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS document_id",
        f"{_LEVEL} AS simplification_level",
        f"{_AUDIENCE} AS target_audience",
        "lang = 'en' AS include_original",
    )


@query(
    "job2_simplified_documents",
    f"""WITH {_OUTCOMES}
SELECT o.document_id, m.filename AS original_filename, summary, key_point AS key_points, 'review' AS next_steps,
  'length=' || length(summary) AS terms, 'within ' || length(summary) || ' days' AS deadlines_obligations,
  CASE WHEN length(summary) > 1000 THEN 'long' ELSE '' END AS warnings,
  {_LEVEL} AS simplification_level, confidence_score, CASE WHEN lang = 'en' THEN original END AS original_text,
  word_count_original, word_count_simplified, reading_level, {_AS_OF} AS processing_timestamp
FROM outcomes o JOIN ({METADATA_SQL}) m USING (document_id) WHERE error IS NULL""",
)
def job2(spark, sf_dir):
    out = _processed(spark, sf_dir, _all_documents(spark, sf_dir)).simplified
    lists = ("key_points", "next_steps", "deadlines_obligations", "warnings")
    flat = out.withColumns({n: F.array_join(n, "|") for n in lists})
    return flat.select("*", _flat_terms()).drop("batch_id", "position", "important_terms")


@query(
    "job2_processing_errors",
    f"""WITH {_OUTCOMES}
SELECT document_id, 'processing_error' AS error, 'Failed to process document ' || document_id AS message,
  error AS detail FROM outcomes WHERE error IS NOT NULL""",
)
def job2_errors(spark, sf_dir):
    out = _processed(spark, sf_dir, _all_documents(spark, sf_dir)).errors
    return out.select("document_id", "error", "message", "detail")


@query(
    "job2_updated_metadata",
    f"""WITH {_OUTCOMES}
SELECT m.document_id, m.filename, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN error IS NULL THEN {_AS_OF} ELSE m.processing_timestamp END AS processing_timestamp,
  CASE WHEN error IS NULL THEN 'processed/' || m.document_id || '/simplified.json' END AS processed_path,
  m.extraction_method
FROM ({METADATA_SQL}) m JOIN outcomes o USING (document_id)""",
)
def job2_metadata(spark, sf_dir):
    changes = _processed(spark, sf_dir, _all_documents(spark, sf_dir)).changes
    return update_metadata(document_metadata(spark, sf_dir), changes).select(
        "document_id", "filename", "status", "processing_timestamp", "processed_path",
        "extraction_method",
    )


@query(
    "job2_processing_events",
    f"""WITH {_OUTCOMES}
SELECT o.document_id, m.user_id, 'document_processing' AS action, {_AS_OF} AS timestamp,
  {_LEVEL} AS simplification_level, confidence_score
FROM outcomes o JOIN ({METADATA_SQL}) m USING (document_id) WHERE error IS NULL""",
)
def job2_events(spark, sf_dir):
    out = _processed(spark, sf_dir, _all_documents(spark, sf_dir)).events
    return out.select(
        "document_id", "user_id", "action", "timestamp", "simplification_level", "confidence_score"
    )


# The first run takes the English documents, the second all of them: only calls are made that the
# first one did not finish, and equal texts share theirs.
_LATER = f"""WITH {_OUTCOMES},
calls AS (SELECT document_id, error, lang = 'en' AS earlier, {_LEVEL} AS simplification_level,
    md5(original) || ' ' || {_LEVEL} || ' ' || {_AUDIENCE} AS call FROM outcomes WHERE original <> ''),
finished AS (SELECT DISTINCT call FROM calls WHERE earlier AND error IS NULL)
"""


@query(
    "job2_calls_of_a_second_run",
    _LATER
    + """SELECT simplification_level, count(DISTINCT call) FILTER (earlier) AS calls_before,
  count(DISTINCT call) FILTER (call NOT IN (SELECT call FROM finished)) AS calls_now,
  count(*) FILTER (error IS NULL) AS documents
FROM calls GROUP BY 1""",
)
def job2_second_run(spark, sf_dir):
    ledger = Ledger(lifecycle.new_workdir(spark, "ledger"))
    everything = _all_documents(spark, sf_dir)
    first = _processed(spark, sf_dir, everything.filter("include_original"), ledger)
    second = _processed(spark, sf_dir, everything, ledger)

    def per_level(rows, name):
        return rows.groupBy("simplification_level").agg(F.count("*").alias(name))

    out = per_level(second.simplified, "documents")
    for rows, name in ((first.calls, "calls_before"), (second.calls, "calls_now")):
        out = out.join(per_level(rows, name), "simplification_level", "left")
    return out.na.fill(0)


@query(
    "job2_not_yet_processed",
    _LATER
    + """SELECT document_id FROM outcomes WHERE original = ''
UNION ALL SELECT document_id FROM calls WHERE call NOT IN (SELECT call FROM finished)""",
)
def job2_open(spark, sf_dir):
    ledger = Ledger(lifecycle.new_workdir(spark, "ledger"))
    everything = _all_documents(spark, sf_dir)
    _processed(spark, sf_dir, everything.filter("include_original"), ledger)
    return lifecycle.not_yet_processed(everything, texts(spark, sf_dir), ledger).select("document_id")


# From raw bytes to results: uploads are checked and landed, texts extracted by type (PDFs by a
# stand-in that decodes them; images and Word files have no extractor here), documents marked,
# processed, and their metadata brought up to date.
@query(
    "job2_from_raw_bytes",
    f"""WITH {_OUTCOMES},
landed AS (SELECT document_id, {_KIND} AS file_type FROM ({_UPLOADS}) u WHERE {_reason('file_size')} IS NULL),
done AS (SELECT l.document_id, file_type, word_count_simplified, o.confidence_score,
  CASE WHEN file_type NOT IN ('pdf', 'text') THEN '{lifecycle.NO_TEXT}' ELSE o.error END AS error
  FROM landed l JOIN outcomes o USING (document_id))
SELECT document_id, file_type, 'processing' AS status_before, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN error IS NULL THEN {_AS_OF} END AS processing_timestamp, error,
  CASE WHEN error IS NULL THEN word_count_simplified END AS word_count_simplified,
  CASE WHEN error IS NULL THEN confidence_score END AS confidence_score
FROM done""",
)
def job2_from_raw_bytes(spark, sf_dir):
    landed = _ingested(spark, sf_dir)
    taken = lifecycle.mark_processing(landed.metadata, landed.metadata)
    extracted = lifecycle.extract_texts(taken, landed.raw, {"pdf": extraction.decode_text})
    out = lifecycle.process(
        taken.select("document_id"),
        taken,
        extracted,
        stand_in(prompts.DOCUMENT_MARK),
        lifecycle.new_workdir(spark, "process"),
        as_of=AS_OF,
    )
    found = F.col("error").isNull()
    items = out.items.select(
        "document_id", "error",
        *[F.when(found, F.col(c)).alias(c) for c in ("word_count_simplified", "confidence_score")],
    )
    before = taken.select("document_id", F.col("status").alias("status_before"))
    done = update_metadata(taken, out.changes).select("document_id", "file_type", "status", "processing_timestamp")
    return done.join(before, "document_id").join(items, "document_id")


# --- batches ---------------------------------------------------------------

# Each user's clicks are a batch; some name a document that does not exist.
_ITEMS = [
    "CAST(user_id AS VARCHAR(20)) AS batch_id",
    "event_id AS position",
    "CASE WHEN k % 10 = 9 THEN 'missing-' || CAST(k AS VARCHAR(20)) WHEN k % 50 <> 4 THEN CAST(k AS VARCHAR(20))"
    " END AS document_id",
]
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k"
_ITEMS_SQL = f"SELECT {', '.join(_ITEMS)} FROM (SELECT *, {_K} FROM events) e"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("*", _K).selectExpr(*_ITEMS)


@query(
    "jn2_batch_lookup",
    f"""SELECT batch_id, position, i.document_id, m.filename, m.status,
  CASE WHEN m.document_id IS NULL THEN '{batch.NOT_FOUND}' END AS error
FROM ({_ITEMS_SQL}) i LEFT JOIN ({METADATA_SQL}) m ON m.document_id = i.document_id""",
)
def jn2(spark, sf_dir):
    out = batch.look_up(_items(spark, sf_dir), document_metadata(spark, sf_dir))
    return out.select("batch_id", "position", "document_id", "filename", "status", "error")


_BATCH = f"""WITH {_OUTCOMES}, items AS ({_ITEMS_SQL}),
done AS (SELECT i.batch_id, i.position, i.document_id, word_count_simplified, confidence_score, reading_level,
  CASE WHEN o.document_id IS NULL THEN '{batch.NOT_FOUND}' ELSE o.error END AS error,
  coalesce(o.original <> '', FALSE) AS called
  FROM items i LEFT JOIN outcomes o ON o.document_id = i.document_id)
"""


@query(
    "job3_batch_results",
    _BATCH
    + """SELECT batch_id, position, document_id, word_count_simplified, confidence_score, reading_level
FROM done WHERE error IS NULL""",
)
def job3(spark, sf_dir):
    out = _processed(spark, sf_dir, _items(spark, sf_dir)).simplified
    return out.select(
        "batch_id", "position", "document_id", "word_count_simplified", "confidence_score",
        "reading_level",
    )


@query(
    "job3_batch_errors",
    _BATCH
    + """SELECT batch_id, position, document_id, error AS detail,
  'Failed to process document ' || coalesce(document_id, '(no id)') AS message FROM done WHERE error IS NOT NULL""",
)
def job3_errors(spark, sf_dir):
    out = _processed(spark, sf_dir, _items(spark, sf_dir)).errors
    return out.select("batch_id", "position", "document_id", "detail", "message")


@query(
    "agg12_batch_summary",
    _BATCH
    + """SELECT batch_id, count(*) AS total_documents,
  CAST(count_if(error IS NULL) AS BIGINT) AS processed_documents, count(error) AS failed_documents,
  count_if(called) > 0 AS took_time
FROM done GROUP BY batch_id""",
)
def agg12(spark, sf_dir):
    out = _processed(spark, sf_dir, _items(spark, sf_dir)).summary
    # How long calls take differs from run to run.
    return out.withColumn("took_time", F.col("processing_time") > 0).drop("processing_time")


# --- questions -------------------------------------------------------------

_QUESTIONS = [
    "CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) AS question_id",
    "CAST(conv_id AS VARCHAR(20)) AS document_id",
    "text AS question",
]
_QA = f"""WITH normalised AS ({normalised_check('documents')}),
asked AS (SELECT {', '.join(_QUESTIONS)} FROM conversations WHERE role = 'user'),
answered AS (SELECT a.*, n.cleaned, n.text AS original, n.doc_id IS NOT NULL AS found
  FROM asked a LEFT JOIN normalised n ON CAST(n.doc_id AS VARCHAR) = a.document_id)
"""
_APOLOGY = prompts.APOLOGY.replace("'", "''")
_ANSWER = f"CASE WHEN length(cleaned) < {SHORT} THEN '{_APOLOGY}' ELSE trim(cleaned) END"


def _asked(spark, sf_dir):
    questions = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return lifecycle.ask(
        questions.selectExpr(*_QUESTIONS),
        document_metadata(spark, sf_dir),
        texts(spark, sf_dir),
        stand_in("DOCUMENT:\n", "\n\nQUESTION:\n"),
        lifecycle.new_workdir(spark, "ask"),
        as_of=AS_OF,
    )


@query(
    "job4_answers",
    _QA
    + f"""SELECT question_id, document_id, question, {_ANSWER} AS answer,
  CASE WHEN length(cleaned) < {SHORT} THEN 0.3 ELSE 0.7 END AS confidence_score
FROM answered WHERE found AND original <> ''""",
)
def job4(spark, sf_dir):
    return _asked(spark, sf_dir).answers


@query(
    "job4_question_events",
    _QA
    + f"""SELECT document_id, CAST(NULL AS VARCHAR) AS user_id, 'document_qa' AS action, {_AS_OF} AS timestamp,
  json_extract_string(CAST(json_object('question', question) AS VARCHAR), '$.question') AS question,
  CASE WHEN length(cleaned) < {SHORT} THEN 0.3 ELSE 0.7 END AS confidence_score
FROM answered WHERE found AND original <> ''""",
)
def job4_events(spark, sf_dir):
    out = _asked(spark, sf_dir).events
    return out.select(
        "document_id", "user_id", "action", "timestamp",
        F.get_json_object("metadata", "$.question").alias("question"), "confidence_score",
    )


@query(
    "job4_distinct_calls",
    _QA
    + """SELECT question, count(DISTINCT md5(original)) AS calls FROM answered WHERE found AND original <> '' GROUP BY 1""",
)
def job4_calls(spark, sf_dir):
    return _asked(spark, sf_dir).calls.groupBy("question").agg(F.count("*").alias("calls"))


# What a model might say: the turns of the conversations, some of them blank.
_SAID = "CASE WHEN role = 'user' THEN ' ' || text || chr(10) WHEN turn % 4 = 1 THEN '  ' ELSE text END"


@query(
    "fn18_answer_confidence",
    f"""SELECT conv_id, turn, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS answer,
  CASE WHEN regexp_replace(said, '^\\s+|\\s+$', '', 'g') <> '' THEN 0.7 ELSE 0.3 END AS confidence_score
FROM (SELECT conv_id, turn, {_SAID} AS said FROM conversations) c""",
)
def fn18(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_SAID} AS said")
    return said.select(
        "conv_id",
        "turn",
        prompts.answer(F.col("said")).alias("answer"),
        prompts.answer_confidence(F.col("said")).alias("confidence_score"),
    )


# What this caller tells its model.
GUIDANCE = prompts.Guidance(
    {"basic": "Two sentences.", "standard": "One page.", "detailed": "Clause by clause."},
    {"general_public": "Readers at large.", "business_owners": "Owners of a firm.", "students": "A seminar."},
)


def _prompt_sql() -> str:
    def table_case(column: str, values: dict, default: str) -> str:
        arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
        return f"CASE {column} {arms} ELSE '{values[default]}' END"

    title = (
        "CASE target_audience WHEN 'general_public' THEN 'General Public' WHEN 'business_owners'"
        " THEN 'Business Owners' WHEN 'students' THEN 'Students' ELSE 'Somebody Else' END"
    )
    return f"""SELECT CAST(doc_id AS VARCHAR) AS document_id,
  '{prompts.TASK}' || chr(10) || chr(10) || 'SIMPLIFICATION LEVEL: ' || upper(simplification_level) || chr(10)
  || {table_case('simplification_level', GUIDANCE.levels, prompts.DEFAULT_LEVEL)} || chr(10) || chr(10)
  || 'TARGET AUDIENCE: ' || {title} || chr(10)
  || {table_case('target_audience', GUIDANCE.audiences, prompts.DEFAULT_AUDIENCE)} || chr(10) || chr(10)
  || '{prompts.RESPONSE_CONTRACT}' || chr(10) || chr(10) || 'DOCUMENT TO SIMPLIFY:' || chr(10) || cleaned AS prompt
FROM (SELECT *, {_LEVEL} AS simplification_level, {_AUDIENCE} AS target_audience FROM ({normalised_check('documents')}) n) p"""


@query("fn16_simplification_prompts", _prompt_sql())
def fn16(spark, sf_dir):
    from clauselight.functions.text import normalise

    rows = documents(spark, sf_dir).selectExpr(
        "CAST(doc_id AS STRING) AS document_id", "text",
        f"{_LEVEL} AS simplification_level", f"{_AUDIENCE} AS target_audience",
    )
    prompt = prompts.simplification_prompt(
        normalise(F.col("text")), F.col("simplification_level"), F.col("target_audience"), GUIDANCE
    )
    return rows.select("document_id", prompt.alias("prompt"))


@query(
    "jn5_guidance_lookup",
    f"""SELECT doc_id, CASE simplification_level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in GUIDANCE.levels.items())}
    ELSE '{GUIDANCE.levels[prompts.DEFAULT_LEVEL]}' END AS level_guidance,
  CASE target_audience {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in GUIDANCE.audiences.items())}
    ELSE '{GUIDANCE.audiences[prompts.DEFAULT_AUDIENCE]}' END AS audience_guidance
FROM (SELECT doc_id, {_LEVEL} AS simplification_level, {_AUDIENCE} AS target_audience FROM documents) p""",
)
def jn5(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{_LEVEL} AS simplification_level", f"{_AUDIENCE} AS target_audience"
    )
    return rows.select(
        "doc_id",
        prompts.level_guidance(F.col("simplification_level"), GUIDANCE).alias("level_guidance"),
        prompts.audience_guidance(F.col("target_audience"), GUIDANCE).alias("audience_guidance"),
    )


@query(
    "fn17_question_prompts",
    _QA
    + f"""SELECT question_id, '{prompts.QUESTION_TASK}' || chr(10) || chr(10) || 'TARGET AUDIENCE: General Public'
  || chr(10) || chr(10) || 'DOCUMENT:' || chr(10) || cleaned || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question
  || chr(10) || chr(10) || 'Give the answer and nothing else.' AS prompt
FROM answered WHERE found""",
)
def fn17(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").selectExpr(*_QUESTIONS)
    joined = salted_join(asked, texts(spark, sf_dir), "document_id", "inner")
    audience = F.lit(prompts.DEFAULT_AUDIENCE)
    prompt = prompts.question_prompt(F.col("text"), F.col("question"), audience)
    return joined.select("question_id", prompt.alias("prompt"))


# --- purge -----------------------------------------------------------------


@query(
    "job5_deletion_events",
    f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, 'document_deletion' AS action, {_AS_OF} AS timestamp
FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)""",
)
def job5(spark, sf_dir):
    return _purged(spark, sf_dir).events.select("document_id", "action", "timestamp")


@query(
    "job5_remaining_texts",
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def job5_raw(spark, sf_dir):
    return _purged(spark, sf_dir).raw


def _purged(spark, sf_dir):
    raw = texts(spark, sf_dir).select(
        "document_id", F.octet_length("text").cast("bigint").alias("size_bytes")
    )
    return lifecycle.purge(
        document_metadata(spark, sf_dir), raw, raw, delete_set(spark, sf_dir), AS_OF
    )
