"""A table in parts by key, for changes that touch few of its rows.

A change rewrites only the parts that hold changed keys, into a new version; all
other parts stay the files they are. A small manifest says in which version each
part lies. Writing it is the last step of a change, so readers see all of a
change or nothing, and a failed one leaves only files that nobody reads.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clauselight.operators import keyed

_MANIFEST = "part int, held_in bigint, version bigint"


class KeyedTable(NamedTuple):
    """``parts`` bounds all that is listed: the manifest, and the changed parts of one change."""

    path: str
    schema: StructType
    key: str = "document_id"
    parts: int = 256

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _held(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """The current version, and the version that holds each part with rows."""
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/parts")
        version = rows.agg(F.max("version")).first()[0]
        current = rows.filter((F.col("version") == version) & F.col("part").isNotNull())
        return version, {r["part"]: r["held_in"] for r in current.collect()}

    def _read(self, spark: SparkSession, held: dict[int, int]) -> DataFrame:
        if not held:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/version={v}/part={p}" for p, v in sorted(held.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, version: int, kept: dict[int, int]) -> None:
        spark, data = rows.sparkSession, f"{self.path}/data/version={version}"
        placed = rows.select(*self.schema.fieldNames()).withColumn("part", self._part())
        # Parts share tasks, and a part with very many rows is split over several.
        placed.hint("rebalance", "part").write.partitionBy("part").parquet(data)
        placing = StructType([*self.schema.fields, StructField("part", IntegerType())])
        written = spark.read.schema(placing).parquet(data)
        held = kept | {r["part"]: version for r in written.select("part").distinct().collect()}
        # A row without a part keeps the version when no part is left.
        rows = spark.createDataFrame([*held.items(), (None, version)], "part int, held_in bigint")
        rows.coalesce(1).write.parquet(f"{self.path}/parts/version={version}")

    def create(self, rows: DataFrame) -> None:
        self._write(rows, 0, {})

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self._held(spark)[1])

    def _change(self, changes: DataFrame, new_rows) -> None:
        spark = changes.sparkSession
        version, held = self._held(spark)
        touched = {r["p"] for r in changes.select(self._part().alias("p")).distinct().collect()} & set(held)
        if touched:
            old = self._read(spark, {p: held[p] for p in touched})
            kept = {p: v for p, v in held.items() if p not in touched}
            self._write(new_rows(old), version + 1, kept)

    def update(self, changes: DataFrame) -> None:
        """``keyed.update_metadata`` on the parts that hold changed keys."""
        self._change(changes, lambda old: keyed.update_metadata(old, changes))

    def delete(self, document_ids: DataFrame) -> None:
        """``keyed.delete_documents`` on the parts that hold deleted keys."""
        self._change(document_ids, lambda old: keyed.delete_documents(old, document_ids))
