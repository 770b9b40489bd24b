"""Many small files as a table: listed level by level in tasks, read by bytes in tasks.

Spark's own listing of a folder tree keeps every file on the driver and runs a task for each
folder; a folder for each document is then a task for each document. Here the
folders of a level are one table, dealt over the tasks; only its size reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselight.session import new_path

LISTING = "below string, modificationTime timestamp, length long, folder boolean"
_ENTRIES = pa.schema(
    [("below", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("folder", pa.bool_())]
)
# Entries or bytes handed on at a time.
_ROWS, _BYTES = 10_000, 8 << 20
# Bytes of files that a task reads, and files that count as much.
TASK_BYTES, TASK_FILES = 64 << 20, 50_000


def reachable(path: str) -> bool:
    """Whether tasks can open the store of ``path`` themselves."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def _pattern(names: str) -> str:
    """A file name pattern as Spark takes it (``* ? [a-c] [^a] {a,b} \\x``) as a regular expression."""
    out, depth, at = "", 0, 0
    while at < len(names):
        c = names[at]
        at += 1
        if c == "\\" and at < len(names):
            out, at = out + re.escape(names[at]), at + 1
        elif c == "[" and (end := names.find("]", at + 1)) > 0:
            inside, at = names[at:end].replace("\\", "\\\\"), end + 1
            out += f"[^{inside[1:]}]" if inside[0] in "!^" else f"[{inside}]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif depth and c in ",}":
            out, depth = out + ("|" if c == "," else ")"), depth - (c == "}")
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
    return out


def _level(root: str):
    """A function from folders (``below`` the root) to their entries."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        top, rows = top.rstrip("/"), []
        for batch in batches:
            for below in batch.column("below").to_pylist():
                for info in store.get_file_info(fs.FileSelector(f"{top}{below}" or "/")):
                    name = info.base_name
                    # As in Spark, hidden and half-copied files don't count.
                    if name.startswith((".", "_")) and not (name[0] == "_" and "=" in name) or name.endswith("._COPYING_"):
                        continue
                    folder = info.type == fs.FileType.Directory
                    if folder or info.size:
                        rows.append((f"{below}/{name}", info.mtime, info.size, folder))
                    if len(rows) >= _ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return entries


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _ENTRIES)], schema=_ENTRIES)


def listed(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """path, below, modificationTime, length of the files in a folder and those below it; empty files are left out."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root, listing = path.rstrip("/"), new_path(spark, "listing")
    folders, n, level = spark.createDataFrame([("",)], "below string"), 1, 0
    while n:
        found = folders.repartition(min(n, tasks), "below").mapInArrow(_level(root), LISTING)
        found.write.partitionBy("folder").parquet(f"{listing}/level={level}")
        entries = spark.read.schema(f"{LISTING}, level int").option("basePath", listing)
        folders = entries.parquet(f"{listing}/level={level}").filter("folder").select("below")
        n, level = folders.count(), level + 1
    files = entries.parquet(listing).filter("NOT folder")
    if names is not None:
        files = files.filter(F.regexp_extract("below", r"([^/]+)$", 1).rlike(f"(?s)\\A(?:{_pattern(names)})\\z"))
    return files.select(F.concat(F.lit(root), "below").alias("path"), "below", "modificationTime", "length")


def with_bytes(files: DataFrame, path: str) -> DataFrame:
    """Listed files and their ``content``; each is opened once."""
    root = path.rstrip("/")
    total = files.agg(F.sum("length"), F.count("*")).first()
    tasks = 1 + (total[0] or 0) // TASK_BYTES + total[1] // TASK_FILES
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        top = top.rstrip("/")
        for batch in batches:
            contents, first, size = [], 0, 0
            for at, below in enumerate(batch.column("below").to_pylist()):
                with store.open_input_stream(top + below) as source:
                    contents.append(source.read())
                size += len(contents[-1])
                if size >= _BYTES or at + 1 == batch.num_rows:
                    own = batch.slice(first, len(contents))
                    yield pa.record_batch([*own.columns, pa.array(contents, pa.binary())], names=[*own.schema.names, "content"])
                    contents, first, size = [], at + 1, 0

    schema = "path string, below string, modificationTime timestamp, length long, content binary"
    return files.repartition(max(tasks, least), "below").mapInArrow(read, schema)
