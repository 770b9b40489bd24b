"""Upload checks, typing, decoding, cascades and joins of extracted text."""

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauselight.functions import events, extraction, records
from clauselight.operators import intake

PDF, HTML, TIFF = "application/pdf", "text/html", "image/tiff"
LIMIT = intake.MAX_FILE_BYTES


@pytest.mark.parametrize(
    ("filename", "size", "content_type", "reason", "kind"),
    [
        ("", LIMIT + 1, HTML, "no_filename", "text"),
        (None, 1, PDF, "no_filename", "text"),
        ("a.pdf", LIMIT, PDF, None, "pdf"),
        ("a.pdf", LIMIT + 1, HTML, "too_large", "pdf"),
        ("a.html", 10, HTML, "unsupported_type", "text"),
        ("a.pdf", 10, None, "unsupported_type", "pdf"),
        ("a.b.TIFF", 10, TIFF, None, "image"),
        ("a.tif", 10, TIFF, None, "text"),
        ("pdf", 10, PDF, None, "pdf"),
    ],
)
def test_upload_checks(spark, filename, size, content_type, reason, kind):
    df = spark.createDataFrame([(filename, size, content_type)], "f string, s bigint, c string")
    row = df.select(
        intake.reject_reason(F.col("f"), F.col("s"), F.col("c")).alias("reason"),
        extraction.file_type(F.col("f")).alias("kind"),
    ).first()
    assert (row["reason"], row["kind"]) == (reason, kind)


@settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=list(HealthCheck),
    # Shrinking would run a Spark job per step.
    phases=[Phase.generate],
)
@given(
    st.lists(
        st.lists(
            st.one_of(
                st.text(max_size=3).map(lambda s: s.encode("utf-8", "ignore")),
                st.binary(max_size=4),
                st.sampled_from([b"\xef\xbf\xbd", b"\x01", b"\x010", b"\xe2\x82", b"\xed\xa0\x80", b"\xf0\x9f"]),
            ),
            max_size=6,
        ).map(b"".join),
        min_size=80,
        max_size=80,
    )
)
def test_decoding_drops_invalid_bytes(spark, contents):
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "id int, c binary")
    got = df.select("id", extraction.decode_text(F.col("c")).alias("t")).orderBy("id").collect()
    for content, row in zip(contents, got):
        assert row["t"] == content.decode("utf-8", "ignore"), content


def test_cascades(spark):
    df = spark.createDataFrame(
        [(" " + "a" * 100, "b" * 101, "c" * 500, "v" * 10, "ab"), ("a", "b", None, "v" * 11, None)],
        "a string, b string, c string, v string, t string",
    )
    rows = df.select(
        extraction.pdf_text(F.col("a"), F.col("b"), F.col("c")).alias("pdf"),
        extraction.image_text(F.col("v"), F.col("t")).alias("image"),
    ).collect()
    assert [tuple(r) for r in rows] == [("b" * 101, "ab"), (None, "v" * 11)]


def test_pages_and_blocks(spark):
    df = spark.sql(
        f"""SELECT CAST(array(named_struct('page_no', 3, 'text', 'y', 'n_images', 2, 'n_tables', 0),
             named_struct('page_no', 1, 'text', 'x', 'n_images', 0, 'n_tables', 0),
             named_struct('page_no', 2, 'text', CAST(NULL AS STRING), 'n_images', 0, 'n_tables', 0)) AS {extraction.PAGES}) AS pages,
        CAST(array(named_struct('kind', 'row', 'pos', 0, 'text', CAST(NULL AS STRING), 'cells', array(' a ', '', 'b')),
             named_struct('kind', 'paragraph', 'pos', 1, 'text', ' ', 'cells', CAST(NULL AS ARRAY<STRING>)),
             named_struct('kind', 'paragraph', 'pos', 0, 'text', ' p ', 'cells', CAST(NULL AS ARRAY<STRING>))) AS {extraction.BLOCKS}) AS blocks"""
    )
    row = df.select(
        extraction.pages_text(F.col("pages")).alias("p"),
        extraction.blocks_text(F.col("blocks")).alias("b"),
        extraction.page_facts(F.col("pages")).alias("f"),
    ).first()
    assert row["p"] == "x\n\ny"
    assert row["b"] == " p \n\na | b"
    assert tuple(row["f"]) == (3, True, False)


def test_annotation_confidence(spark):
    df = spark.createDataFrame(
        [([("t", 0.1), ("t", 0.8), ("t", 0.6)],), ([("t", 0.9)],), ([],), (None,)],
        f"a {extraction.ANNOTATIONS}",
    )
    mean = extraction.annotation_confidence(F.col("a"))
    rows = df.select(mean.alias("m"), extraction.image_method(mean).alias("k")).collect()
    assert rows[0]["m"] == pytest.approx(0.7, abs=1e-9)
    assert [r["m"] for r in rows[1:]] == [None, None, None]
    assert [r["k"] for r in rows] == ["google_vision", "ocr", "ocr", "ocr"]


def test_notes(spark):
    df = spark.createDataFrame([("ocr",), ("documentai",), ("pdfplumber",), (None,)], "m string")
    notes = [r[0] for r in df.select(extraction.processing_notes(F.col("m"))).collect()]
    assert notes == [[extraction.NOTES["ocr"]], [extraction.NOTES["documentai"]], [], []]


def test_user_id_is_lossy(spark):
    df = spark.createDataFrame([("a.b@c",), ("a_b@c",)], "e string")
    assert {r[0] for r in df.select(events.user_id(F.col("e"))).collect()} == {"user_a_b_c"}


def test_event_defaults(spark):
    df = spark.createDataFrame([("d", "u")], "document_id string, user_id string")
    row = events.uploads(df).first()
    assert row["metadata"] == '{"file_size":0,"file_type":"unknown"}' and row["file_size"] == 0
    row = events.processing(df).first()
    assert (row["simplification_level"], row["confidence_score"], row["processing_time"]) == ("standard", 0.0, 0.0)
    assert events.views(df).first()["metadata"] == '{"view_duration":null}'
    assert events.logouts(df).first()["document_id"] == "system"


def test_coercion(spark):
    raw = spark.createDataFrame(
        [
            ("d", "view", "2024-01-01 00:00:00", "1.5", "7", '{"a":1}'),
            ("d", "view", "2024-01-01 00:00:00", "1.5", "7.9", "plain"),
            ("d", None, "2024-01-01 00:00:00", None, None, None),
            ("d", "view", "then", None, None, '{"a":1} x'),
        ],
        "document_id string, action string, timestamp string, processing_time string,"
        " file_size string, metadata string",
    )
    out = records.coerce_events(raw)
    rows = out.collect()
    assert [r["reject_reason"] for r in rows] == [
        None, "invalid_file_size", "missing_action", "invalid_timestamp",
    ]
    assert [r["metadata"] for r in rows] == ['{"a":1}', '{"value":"plain"}', None, '{"value":"{\\"a\\":1} x"}']
    assert records.accepted(out).count() == 1 and records.rejected(out).count() == 3
    nested = spark.sql("SELECT 'd' AS document_id, 'x' AS action, now() AS timestamp, map('a', 1) AS metadata")
    assert records.coerce_events(nested).first()["metadata"] == '{"a":1}'
    assert records.coerce_events(nested.drop("metadata")).first()["metadata"] == "{}"
