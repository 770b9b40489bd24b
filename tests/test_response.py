"""Golden model responses."""

import pytest
from pyspark.sql import functions as F

from clauselight.functions import report, response

TEXT = """Summary
This is a lease.
Second line ignored.
Key Points:
- rent is 100
* pay monthly
• no pets
Important Terms
Lessee: the tenant
- Lessor: the owner
Warnings
- high risk of eviction
- late fee applies
Next steps
- sign"""
NOTHING = ("", [], {}, [], [], [])
FALLBACK_TAIL = (
    [response.FALLBACK_KEY_POINT],
    {},
    [],
    [response.FALLBACK_WARNING],
    [response.FALLBACK_NEXT_STEP],
)

CASES = {
    "prose around": (
        'Sure: {"summary":" S ","key_points":["a"," ","b "],"important_terms":'
        '{"T":"d","":"x","E":""},"deadlines_obligations":"pay by 1 May","warnings":[],'
        '"next_steps":null} done',
        "json",
        ("S", ["a", "b"], {"T": "d"}, ["pay by 1 May"], [], []),
    ),
    "only summary": ('{"summary":"x"}', "json", ("x", [], {}, [], [], [])),
    "nulls": ('{"key_points":null,"summary":null}', "json", ("None", ["None"], {}, [], [], [])),
    "wrong types": (
        '{"key_points":"solo","important_terms":["q"]}', "json", ("", ["solo"], {}, [], [], []),
    ),
    "items": ('{"key_points":[1,true,null]}', "json", ("", ["1", "True", "None"], {}, [], [], [])),
    "falsy lone values": (
        '{"warnings":"0","next_steps":{},"deadlines_obligations":0}',
        "json",
        ("", [], {}, [], ["0"], []),
    ),
    "falsy definitions": (
        '{"important_terms":{"a":null,"b":0,"c":true,"d":[],"e":"x"}}',
        "json",
        ("", [], {"c": "True", "e": "x"}, [], [], []),
    ),
    "last key wins": ('{"summary":"a","summary":"b"}', "json", ("b", [], {}, [], [], [])),
    "two objects": ('{"a":1} x {"b":2}', "text", NOTHING),
    "closed early": ('{"a":1}],[{"b":2}', "text", NOTHING),
    "listed objects": ('{"a":1},{"b":2}', "text", NOTHING),
    "sections": (
        TEXT,
        "text",
        (
            "This is a lease.",
            ["rent is 100", "pay monthly", "no pets"],
            {"Lessee": "the tenant"},
            [],
            ["late fee applies"],
            ["sign"],
        ),
    ),
    "last term wins": (
        "Terms\na: 1\na: 2\n: 3\nb:c:d", "text", ("", [], {"a": "2", "": "3", "b": "c:d"}, [], [], []),
    ),
    "bullet below summary": (
        "Summary:\n- The lease runs 12 months",
        "fallback",
        ("Summary:\n- The lease runs 12 months", *FALLBACK_TAIL),
    ),
    "long fallback": (
        "Summary:\n- " + "x" * 600, "fallback", ("Summary:\n- " + "x" * 600, *FALLBACK_TAIL),
    ),
    "bullet and broken braces": ("Summary:\n- bullet {x}", "error", (None,) * 6),
    "orphan bullet": ("- orphan bullet", "text", NOTHING),
    "empty": ("", "text", NOTHING),
    "missing": (None, None, (None,) * 6),
}


@pytest.fixture(scope="module")
def structured(spark):
    rows = [(name, text) for name, (text, _, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, response string")
    return {r["name"]: r for r in response.with_structure(df).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_structure(structured, name):
    _, path, expected = CASES[name]
    row = structured[name]
    assert row["parse_path"] == path
    assert tuple(row[f] for f in response.FIELDS) == expected


@pytest.mark.parametrize(
    ("chars", "lists", "expected"),
    [
        (0, 0, 0.5),
        (50, 0, 0.5),
        (51, 0, 0.7),
        (51, 1, 0.7999999999999999),
        (51, 2, 0.8999999999999999),
        (51, 3, 0.9999999999999999),
        (0, 1, 0.6),
        (0, 2, 0.7),
        (0, 3, 0.7999999999999999),
    ],
)
def test_confidence(spark, chars, lists, expected):
    points = ["p"] if lists > 0 else []
    terms = {"t": "d"} if lists > 1 else {}
    steps = ["s"] if lists > 2 else []
    df = spark.createDataFrame(
        [("s" * chars, points, terms, steps)],
        "summary string, key_points array<string>, important_terms map<string,string>,"
        " next_steps array<string>",
    )
    assert df.select(response.confidence()).first()[0] == expected


def test_report_figures(spark):
    df = spark.createDataFrame(
        [(2500, 800), (8, 9), (0, 5)], "original bigint, simplified bigint"
    )
    percent = report.reduction_percent(F.col("original"), F.col("simplified"))
    assert [r[0] for r in df.select(percent).collect()] == [68, -12, None]
    shown = report.confidence_percent(F.lit(0.9999999999999999))
    assert df.select(shown).first()[0] == 100


def test_markdown(spark):
    df = spark.createDataFrame(
        [("a.pdf", "S", ["p"], {"b": "2", "a": "1"}, [], ["w"], ["n"], 0.7, "college")],
        "original_filename string, summary string, key_points array<string>,"
        " important_terms map<string,string>, deadlines_obligations array<string>,"
        " warnings array<string>, next_steps array<string>, confidence_score double,"
        " reading_level string",
    ).withColumn("processing_timestamp", F.lit("2024-01-02 10:00:00").cast("timestamp"))
    assert df.select(report.markdown()).first()[0] == (
        "# Simplified Legal Document: a.pdf\n\n## Summary\nS\n\n## Key Points\n- p\n\n"
        "## Important Terms\n**a**: 1\n**b**: 2\n\n## Deadlines & Obligations\n\n\n"
        "## Warnings\n- w\n\n## Next Steps\n- n\n\n---\n*Simplified on 1/2/2024*\n"
        "*Confidence Score: 70%*\n*Reading Level: college*"
    )


def test_the_block_between_braces(spark):
    texts = ["{}", "{", "}", "}{", "{}{}", " {a} ", "x{\n}y}", "{a} b", "a {b}", "", None, "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r[0] for r in rows.orderBy("id").select(response.json_block(F.col("text"))).collect()]
    assert got == ["{}", "", "", "", "{}{}", "{a}", "{\n}y}", "{a}", "{b}", "", None, ""]
