"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

Two collections of ``COLLECTION`` band hashes are made per set, each of
``ROWS`` MinHash values. Every pair of one band of the first and one of the
second collection is the key of a table: COLLECTION squared tables from
2 * COLLECTION * ROWS MinHash values, where independent tables of the same key
length would take COLLECTION squared * 2 * ROWS.

At a similarity of 0.75 a pair meets in some table with probability 0.9995, and
on average in 32 of the 100. Tables name a leader per bucket, so candidates grow
with the members, not with their pairs. Buckets that the confirmed links leave in
several components are gone through afterwards by their rarest shingles, which
is exact and emits no pairs for a passage that many documents share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm.components import components
from clauselight.llm.words import batch_rows, hashed, mix, space_words, utf8, windows
from clauselight.session import new_path

WORDS = 5
SIMILARITY = 75  # of 100
COLLECTION = 10
ROWS = 2
# Shingles hashed at a time, so that a very long text needs no large matrix.
_BLOCK = 4096

_SEEDS = mix(np.arange(1, 2 * COLLECTION * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

SIGNATURE_SCHEMA = (
    "doc_id long, n_shingles long, set_hash long, first array<long>, second array<long>"
)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words (one run if there are fewer)."""
    return np.unique(windows(hashed(space_words(text)), WORDS))


def _bands(sets: np.ndarray) -> np.ndarray:
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(sets), _BLOCK):
        block = sets[start : start + _BLOCK, None]
        # A multiply-shift of well mixed values is enough to order them anew.
        values = (block ^ _SEEDS) * np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, (values ^ (values >> np.uint64(32))).min(axis=0), out=least)
    bands = least.reshape(2 * COLLECTION, ROWS)
    key = bands[:, 0]
    for i in range(1, ROWS):
        key = mix(key) + bands[:, i]
    return mix(key).view(np.int64)


def _as_long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """Set size, set hash and the two collections of each document."""

    def sign(batches):
        for batch in batch_rows(batches):
            sizes, hashes, first, second = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                with np.errstate(over="ignore"):
                    hashes.append(int(mix(found).sum(dtype=np.uint64)))
                bands = _bands(found) if len(found) else None
                first.append(None if bands is None else bands[:COLLECTION])
                second.append(None if bands is None else bands[COLLECTION:])
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(_as_long(np.array(hashes, np.uint64))),
                    pa.array(first, longs),
                    pa.array(second, longs),
                ],
                names=["doc_id", "n_shingles", "set_hash", "first", "second"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.mapInArrow(sign, SIGNATURE_SCHEMA)


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, grams) of the wanted documents."""

    def make(batches):
        for batch in batch_rows(batches):
            sets = [_as_long(shingles(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                names=["doc_id", "grams"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.join(wanted, "doc_id", "left_semi").mapInArrow(make, "doc_id long, grams array<long>")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _sizes_allow(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. Each pair brings each set once."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return pairs.join(right, "b").join(left, "a").filter(100 * common >= SIMILARITY * union).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text).

    Documents are linked if the Jaccard similarity of their five-word shingle
    sets is at least 0.75; ``component_id`` is the smallest doc_id reachable.
    Null texts and texts without words have no shingles, no links and are kept.
    Equal sets are one representative from the start, so exact copies never meet
    in pairs. Rows that repeat a doc_id are the same document: they share links,
    and each is returned. Other columns are not read; no rows give no rows.
    """
    signed = _stored(signatures(documents), "signatures")
    identity = ["set_hash", "n_shingles"]
    sets_of = signed.filter("n_shingles > 0").groupBy(*identity).agg(
        F.min_by(F.struct("doc_id", "first", "second"), "doc_id").alias("s")
    )
    classes = _stored(sets_of.select(*identity, "s.*"), "classes")

    pairs_of_bands = F.flatten(
        F.transform("first", lambda g: F.transform("second", lambda h: F.xxhash64(g, h)))
    )
    # The position in a collection belongs to the key, so tables stay apart.
    placed = lambda c: F.transform(c, lambda x, i: F.xxhash64(x, i))
    keyed = (
        classes.select("doc_id", "n_shingles", placed("first").alias("first"), placed("second").alias("second"))
        .select("doc_id", "n_shingles", F.explode(pairs_of_bands).alias("key"))
    )
    crowded = keyed.groupBy("key").agg(
        F.count("*").alias("members"), F.min_by(F.struct("doc_id", "n_shingles"), "doc_id").alias("l")
    )
    crowded = crowded.filter("members > 1").select(
        "key", "members", F.col("l.doc_id").alias("leader"), F.col("l.n_shingles").alias("leader_n")
    )
    buckets = _stored(keyed.join(crowded, "key"), "buckets")

    to_leader = (
        buckets.filter("doc_id <> leader")
        .filter(_sizes_allow(F.col("n_shingles"), F.col("leader_n")))
        .select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )
    to_leader = _stored(to_leader, "leader-pairs")
    # As a table its size is known: texts are not shuffled to meet a small one.
    members = _stored(buckets.select("doc_id").distinct(), "members")
    sets = _stored(_sets(documents, members).dropDuplicates(["doc_id"]), "sets")
    links = _stored(_confirmed(to_leader, sets), "links")
    named = components(links)

    rest = _stored(_left_over(buckets, named, sets, to_leader), "other-pairs")
    more = _confirmed(rest, sets)
    named = components(links.union(more))

    same = classes.select(*identity, F.col("doc_id").alias("node"))
    grouped = same.join(named, "node", "left").select(
        *identity, F.coalesce("component", "node").alias("component_id")
    )
    return (
        signed.select("doc_id", *identity)
        .join(grouped, identity, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
        )
    )


def _left_over(buckets: DataFrame, named: DataFrame, sets: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs from buckets in more than one component that may yet be similar.

    Sets as similar as asked share one of their rarest shingles: of ``n`` in one
    order of rarity, one of the first ``n - ceil(0.75 n) + 1``. So members that
    meet through a common passage only are never paired, and shingles that lie
    in one component need no comparison. This loses no link.
    """
    named = named.select(F.col("node").alias("doc_id"), "component")
    labelled = buckets.select("key", "doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    span = [F.min("component").alias("low"), F.max("component").alias("high")]
    split = labelled.groupBy("key").agg(*span).filter("low < high").select("key")
    open_members = labelled.join(split, "key", "left_semi").drop("key").distinct()
    grams = _stored(
        open_members.join(sets, "doc_id").withColumn("gram", F.explode("grams")).drop("grams"), "open-grams"
    )
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"), *span)
    by_rarity = Window.partitionBy("doc_id").orderBy("n", "gram")
    needed = F.floor((F.col("n_shingles") * SIMILARITY + 99) / 100)
    first = (
        grams.join(rarity, "gram")
        .withColumn("place", F.row_number().over(by_rarity))
        .filter(F.col("place") <= F.col("n_shingles") - needed + 1)
        .filter("low < high")
        .select("gram", "doc_id", "n_shingles", "component", "place")
    )
    first = _stored(first, "open-prefixes")
    other = first.select("gram", *(F.col(c).alias(f"{c}_b") for c in first.columns[1:]))
    # What two sets of these sizes have to share leaves each still fewer first places.
    share = F.ceil((F.col("n_shingles") + F.col("n_shingles_b")) * SIMILARITY / (100 + SIMILARITY))
    found = first.join(other, "gram").filter(
        (F.col("place") <= F.col("n_shingles") - share + 1)
        & (F.col("place_b") <= F.col("n_shingles_b") - share + 1)
        & (F.col("doc_id") < F.col("doc_id_b"))
        & (F.col("component") != F.col("component_b"))
        & _sizes_allow(F.col("n_shingles"), F.col("n_shingles_b"))
    )
    pairs = found.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b"))
    return pairs.distinct().join(done, ["a", "b"], "left_anti")
