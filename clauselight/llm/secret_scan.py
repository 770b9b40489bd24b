"""Secret scan with an incremental blob ledger, in built-in functions only.

A text is addressed by its content. The ledger is a Parquet table of the blobs
scanned under each version of the rules; only pairs it lacks are scanned, each
blob once however many paths or historical versions hold it, and the findings
are joined back to all of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselight.session import new_path


def either_case(words: str) -> str:
    """A pattern for the words in either case, for ASCII letters alone."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap, kept if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# What counts as a secret.
ASSIGN = (
    f"({either_case('password|passwd|secret|token|api_?key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8),
    # A run too short fails as a whole, so the least length can stand in the pattern.
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
RULE_VERSION = "1"
REDACTED = "[secret]"

SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("end", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rule_version", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans in code points: lengths of what lies between matches, and of matches, added up."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.transform(
        F.arrays_zip(whole.alias("m"), judged.alias("g"), gaps.alias("b")),
        lambda x: F.struct(
            F.char_length(x["b"]).cast("long").alias("gap"),
            F.char_length(x["m"]).cast("long").alias("size"),
            (F.char_length(x["g"]) >= rule.least).alias("fits"),
        ),
    )
    none = F.array().cast(T.ArrayType(SPAN))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            (start + x["size"]).alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        grown = F.when(x["fits"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(
            (start + F.coalesce(x["size"], F.lit(0))).alias("at"), grown.cast(T.ArrayType(SPAN)).alias("spans")
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    found = F.aggregate(lengths, first, step, lambda s: s["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; a new one is an empty table."""
    empty = spark.createDataFrame([], LEDGER_SCHEMA)
    empty.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan(
    documents: DataFrame,
    ledger: str,
    *,
    rules: tuple[Rule, ...] = BASE_RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """(doc_id, blob, spans) of every row of ``documents`` (doc_id, text).

    ``ledger`` is a folder that calls share; a call adds the pairs of blob and
    rule version that it scanned. The rules themselves are part of the version, so other
    rules scan anew. Rows of one doc_id with different texts are
    historical versions, each with its own row. A null text is the empty blob.
    Spans are sorted by start, then by the order of the rules. No rows give no
    rows; other columns are not read.
    """
    spark = documents.sparkSession
    rule_version = f"{rule_version}-{hashlib.sha256(repr(rules).encode()).hexdigest()[:16]}"
    text = F.coalesce("text", F.lit(""))
    paths = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"))
    paths = _stored(paths, new_path(spark, "blob-paths"))
    known = _ledger(spark, ledger).filter(F.col("rule_version") == rule_version)
    unseen = (
        paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(known.select("blob"), "blob", "left_anti")
    )
    # One row holds the blob: its text is read there, and no text is shuffled twice.
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    here = unseen.select(F.col("doc_id").alias("at"), "blob")
    texts = held.join(here, F.col("doc_id").eqNullSafe(F.col("at"))).filter(
        F.sha2("text", 256) == F.col("blob")
    )
    found = texts.select(
        "blob",
        F.lit(rule_version).alias("rule_version"),
        F.sort_array(F.concat(*(_spans(F.col("text"), r, i) for i, r in enumerate(rules)))).alias("spans"),
    ).dropDuplicates(["blob"])
    found.write.mode("append").parquet(ledger)
    findings = (
        spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
        .filter(F.col("rule_version") == rule_version)
        .filter(F.size("spans") > 0)
        # Calls at the same time may both have scanned a blob.
        .groupBy("blob").agg(F.any_value("spans").alias("spans"))
    )
    none = F.array().cast(T.ArrayType(SPAN))
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(documents: DataFrame, ledger: str, **options) -> DataFrame:
    """The documents with every secret replaced; texts without one stay as they are.

    Overlapping findings are replaced as one. Findings are joined by content, so
    rows that repeat a doc_id are each redacted by their own text.
    """
    found = scan(documents, ledger, **options)
    secrets = (
        found.filter(F.size("spans") > 0).groupBy("blob").agg(F.any_value("spans").alias("_spans"))
        .select(F.col("blob").alias("_blob"), "_spans")
    )
    # As a table its size is known: texts are not shuffled to meet a small one.
    secrets = _stored(secrets, new_path(documents.sparkSession, "secrets"))

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(s["start"], state["at"])
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))
        # A span that touches the last one only lengthens what is left out.
        piece = F.when(s["start"] < state["at"], F.lit("")).otherwise(F.concat(gap, F.lit(REDACTED)))
        return F.struct(
            F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], piece).alias("out")
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(
        s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.char_length("text"))
    )
    clean = F.when(F.col("_spans").isNotNull(), F.aggregate("_spans", first, step, rest)).otherwise(F.col("text"))
    joined = documents.withColumn("_key", F.sha2("text", 256)).join(
        secrets, F.col("_key") == F.col("_blob"), "left"
    )
    return joined.withColumn("text", clean).select(*documents.columns)
