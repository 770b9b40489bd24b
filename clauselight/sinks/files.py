"""A Spark data source that writes one file per row.

Tasks write below a hidden folder of the run. When all have ended the folder is
given its visible name in one move; if the write fails it is removed. Readers
see all files of a run or none.

For many small documents the table form of a sink is the better one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "document_files"


@dataclass
class _Written(WriterCommitMessage):
    """The folder of a task attempt that counts."""

    folder: str
    files: int


def _inside(name: str) -> str:
    """The file's relative path, if it stays below the folder it is written to."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not the name of a file below the target: {name!r}")
    return name


class _FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.run = uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = self._root()
        # Each attempt has its own folder: one that is repeated can't meet the first.
        folder = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        made, files = set(), 0
        for batch in iterator:
            for name, content in zip(batch.column("file"), batch.column("content")):
                target = f"{root}/_run-{self.run}/{folder}/{_inside(name.as_py())}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    if len(made) > 10_000:
                        made.clear()
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write(content.as_py() or b"")
                files += 1
        return _Written(folder, files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = self._root()
        hidden = f"{root}/_run-{self.run}"
        if not any(m and m.files for m in messages):
            return
        counted = {m.folder for m in messages if m}
        for info in store.get_file_info(fs.FileSelector(hidden)):
            if info.base_name not in counted:
                store.delete_dir(info.path)
        store.move(hidden, f"{root}/run-{self.run}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = self._root()
        hidden = f"{root}/_run-{self.run}"
        if store.get_file_info(hidden).type != fs.FileType.NotFound:
            store.delete_dir(hidden)


class DocumentFiles(DataSource):
    """``df.write.format("document_files").save(path)`` for columns file and content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> _FilesWriter:
        if overwrite:
            raise ValueError("files are only ever added; write to a new folder")
        return _FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """One file for each row (file, content); ``file`` is its path below the target.

    Two rows of one name in different tasks are two files; a null content is an empty file; a
    name that leaves the target fails the write, and nothing is left of it.
    """
    files.sparkSession.dataSource.register(DocumentFiles)
    rows = files.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).mode("append").save(path)
