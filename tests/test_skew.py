"""Hot keys: a third of all rows share one key, copies included."""

from pyspark.sql import functions as F

from clauselight.operators import keyed, skew, storage


def skewed(spark, n=30_000):
    return spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"),
        F.lit(1).alias("copy"),
    )


def test_hot_keys_are_found_and_few(spark):
    assert skew.hot_keys(skewed(spark), "key") == ["hot"]
    assert skew.hot_keys(skewed(spark, 300), "key") == []
    even = spark.range(50_000).select(F.col("id").cast("string").alias("key"))
    assert skew.hot_keys(even, "key") == []
    assert skew.hot_keys(even.filter("key IS NULL"), "key") == []


def counts(df):
    return {tuple(r) for r in df.groupBy(*df.columns).count().collect()}


def test_salted_joins_equal_plain_joins(spark):
    left = skewed(spark).unionByName(
        spark.sql("SELECT CAST(NULL AS STRING) AS key, 1 AS copy")
    )
    right = spark.sql("SELECT 'hot' AS key, 7 AS v UNION ALL SELECT 'k1', 8 UNION ALL SELECT 'other', 9")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew.salted_join(left, right, "key", how)
        assert counts(salted) == counts(left.join(right, "key", how)), how


def test_rows_of_a_hot_key_are_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.sql("SELECT 'hot' AS key, 7 AS v")
        joined = skew.salted_join(skewed(spark), right, "key", "left").filter("key = 'hot'")
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 2
        assert sum(t[1] for t in tasks) == 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _metadata(spark, n=30_000):
    return spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "d").otherwise(F.concat(F.lit("d"), "id")).alias("document_id"),
        F.lit("u").alias("user_id"),
        F.lit("uploaded").alias("status"),
        F.lit("ocr").alias("extraction_method"),
        F.timestamp_seconds("id").alias("processing_timestamp"),
        F.timestamp_seconds("id").alias("upload_timestamp"),
    )


def test_updates_and_deletes_of_a_hot_document(spark):
    metadata = _metadata(spark)
    changes = spark.sql(
        "SELECT 'd' AS document_id, 'completed' AS status, CAST(NULL AS STRING) AS extraction_method"
        " UNION ALL SELECT 'unknown', 'failed', 'x'"
    )
    updated = keyed.update_metadata(metadata, changes)
    assert updated.columns == metadata.columns
    found = updated.groupBy("status", "extraction_method").count().collect()
    assert {tuple(r) for r in found} == {("completed", None, 10_000), ("uploaded", "ocr", 20_000)}
    kept = keyed.delete_documents(metadata, changes)
    assert kept.count() == 20_000 and kept.filter("document_id = 'd'").count() == 0


def test_long_lists_of_a_hot_user(spark):
    metadata = _metadata(spark)
    for limit in (5, 1500):
        out = keyed.latest_documents(metadata, limit=limit)
        assert [r[0] for r in out.orderBy("rank").select("rank").collect()] == list(range(1, limit + 1))
        assert out.agg(F.min("upload_timestamp").cast("long")).first()[0] == 30_000 - limit


def test_latest_keeps_one_row_per_key(spark):
    out = keyed.latest_metadata(_metadata(spark))
    assert out.count() == 20_001
    assert out.filter("document_id = 'd'").first()["processing_timestamp"].timestamp() == 29_997
    assert keyed.latest_metadata(_metadata(spark), "d").count() == 1
    assert keyed.latest_metadata(_metadata(spark), "nobody").count() == 0


def test_file_type_report_counts_every_result(spark):
    results = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "d").otherwise(F.concat(F.lit("d"), "id")).alias("document_id"),
        (F.col("id") % 10 / 10).alias("confidence_score"),
        F.col("id").alias("word_count_original"),
        F.lit(None).cast("bigint").alias("word_count_simplified"),
    )
    metadata = spark.sql("SELECT 'd' AS document_id, 'pdf' AS file_type UNION ALL SELECT 'd', 'pdf' UNION ALL SELECT 'd1', 'doc'")
    got = storage.processing_by_file_type(results, metadata)
    plain = results.join(metadata, "document_id", "left").groupBy("file_type").agg(
        F.count("*"), F.avg("confidence_score"), F.avg("word_count_original"), F.avg("word_count_simplified")
    )

    def rows(df):
        return sorted(
            tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect() if r[0]
        )

    assert rows(got) == rows(plain)
    assert got.filter("file_type IS NULL").first()["document_count"] == 1999
