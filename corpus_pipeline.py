"""From raw documents to packed training sequences.

Each stage takes the table its predecessor kept and returns the next one; all
but the last return the columns of ``documents``. Stages are written as Parquet
in the shared folder and read back, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm import decontamination, near_dedup, ordinal, packing, secret_scan
from clauselight.session import configure, new_path

#: The stages need learned weights, MinHash and a tokenizer: no SQL says the same.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _recounted(documents: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage may have changed; null texts keep theirs."""
    if "n_chars" not in documents.columns:
        return documents
    kind = documents.schema["n_chars"].dataType
    counted = F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
    return documents.withColumn("n_chars", counted).select(*documents.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a good grade; toxic and poor ones go."""
    model = ordinal.train(docs, ordinal.graded(_table(spark, sf_dir, "labels")))
    return ordinal.select(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Of rows that repeat an id the first by text stays.
    """
    found = _stored(near_dedup.near_duplicates(docs), "near-duplicates")
    ids = F.col("doc_id").cast("long").alias("_id")
    dropped = _stored(found.filter(~F.col("kept")).select(ids).distinct(), "dropped")
    repeated = found.groupBy(ids).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id")
    repeated = _stored(repeated.filter("_id IS NOT NULL"), "repeated")
    same = F.col("doc_id").cast("long") == F.col("_id")
    kept = docs.join(dropped, same, "left_anti")
    once = kept.join(repeated, same, "left_anti")
    first = Window.partitionBy("doc_id").orderBy("text")
    again = (
        kept.join(repeated, same, "left_semi")
        .withColumn("_place", F.row_number().over(first))
        .filter("_place = 1")
        .select(*docs.columns)
    )
    return once.union(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return _recounted(decontamination.remove_leaks(docs, _table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder."""
    return _recounted(secret_scan.redact(docs, new_path(spark, "secret-ledger")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token lies in windows of the corpus's mixture of sources."""
    return packing.pack(docs, with_ids=False).drop("ids", "queue")


STAGES = [
    ("quality classifier", classify),
    ("near-duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
