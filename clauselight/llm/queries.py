"""Registered queries of the operators, and their checks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselight.llm import (
    block_pruning, chat_format, checks, decontamination, hard_negatives, html_text, language_id,
    near_dedup, ordinal, packing, periodic_runs, perplexity, secret_scan, token_files,
)
from clauselight.session import configure, new_path

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_tensored_minhash")
def op4(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_mixture_packing")
def op5(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.drop("ids", "queue")


@query("op7_arrow_token_files")
def op7(spark, sf_dir):
    folder = new_path(spark, "token-files")
    return token_files.token_table(spark, table(spark, sf_dir, "documents"), folder)


@query("op9_fm_index_decontamination")
def op9(spark, sf_dir):
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def held_out():
    """Documents kept from learning: a third by the checksum of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op3_rank_order_profiles")
def op3(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = language_id.identify(documents, documents.filter(~held_out()).select("lang", "text"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_perplexity_bands")
def op10(spark, sf_dir):
    return perplexity.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "log_perplexity", "lang",
    )


@query("op1_perspective_rotation", checks.OP1)
def op1(spark, sf_dir):
    return chat_format.perspectives(table(spark, sf_dir, "conversations"))


@query("op2_blob_ledger_secrets", checks.secrets())
def op2(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger"))
    text = secret_scan.as_text(F.col("spans"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}")
        for r in secret_scan.BASE_RULES
    ]
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


@query("op6_ordinal_quality")
def op6(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = ordinal.train(documents, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.grade(documents, model)


@query("op8_block_tree_text")
def op8(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_block_pruned_top_k", checks.OP11)
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return block_pruning.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def looped(documents: DataFrame) -> DataFrame:
    """Every tenth text, by the checksum of its id, goes on periodically from some word."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = documents.select("doc_id", "text", F.when(chosen, words).alias("w"), (h / 10).cast("long").alias("g"))
    rows = rows.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.expr("g % greatest(n, 1)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))])")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_maximal_pair_runs")
def op12(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.find(looped(documents)))


@query("op13_l2ap_hard_negatives", checks.OP13)
def op13(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
