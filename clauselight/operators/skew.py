"""Equi-joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the left rows. There are
# at most 1 / HOT_SHARE such keys, so their list is bounded whatever the input.
HOT_SHARE = 1 / 500
# Fewer rows than this fit any task, however large their share.
MIN_HOT_ROWS = 5_000
SALTS = 64
# Keys followed per sketch: enough to find every key above HOT_SHARE.
_TRACKED = 4096
# Sketches are merged in this many groups before the last merge.
_GROUPS = 512


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys with many rows and more than ``share`` of all; at most ``1 / share`` keys.

    Each task keeps a frequent-items sketch of fixed size, so neither the
    shuffle nor the result grows with the number of keys. The list only decides
    where rows are sent: a key it misses is still joined, unsalted.
    """
    partial = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("_group"))
        .agg(
            F.expr(f"approx_top_k_accumulate(`{key}`, {_TRACKED})").alias("_sketch"),
            F.count("*").alias("_n"),
        )
    )
    limit = int(1 / share)
    # Grouped by a constant: no rows then give no group, which sketches require.
    found = partial.groupBy(F.lit(True).alias("_all")).agg(
        F.expr(
            f"approx_top_k_estimate(approx_top_k_combine(_sketch, {_TRACKED}), {limit})"
        ).alias("top"),
        F.sum("_n").alias("n"),
    ).first()
    if found is None:
        return []
    floor = max(share * found.n, MIN_HOT_ROWS)
    return sorted(item.item for item in found.top if item["count"] > floor)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    *,
    keys_from: DataFrame | None = None,
    hot: list | None = None,
    share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds each key a bounded number of times.

    Without a hot key this is the plain join. Otherwise left rows of hot keys
    get a salt from the partition they are read in: that spreads even rows that
    are copies of each other, and a task that runs again salts them the same
    way. Only the matching right rows are repeated, once per salt.

    Finding the hot keys runs a job over the key column when the join is
    declared. ``keys_from`` names a cheaper source of the same keys when the
    left side itself is expensive, ``hot`` the keys where they were found before.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot be salted")
    if hot is None:
        hot = hot_keys(left if keys_from is None else keys_from, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(salts)).cast("int")
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    # Rows without a key match nothing; they are spread as well.
    spread_left = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt).otherwise(F.lit(0)))
    spread_right = right.withColumn(
        "_salt", F.explode(F.when(is_hot, every_salt).otherwise(F.array(F.lit(0))))
    )
    return spread_left.join(spread_right, [key, "_salt"], how).drop("_salt")
