"""Token ids as Arrow files of equal-length sequences and masks.

A file holds record batches with two fixed-size-list columns: ``ids`` (unsigned,
16 bits where the vocabulary fits, else 32) and ``mask`` (a bit, set for an id and
not for padding). Its footer places each batch,
so a reader maps the file and takes any sequence without a copy. Documents run
through the sequences of a file in order; a Parquet index says where each one lies.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm.tokens import DEFAULT_TOKENIZER, encoder
from clauselight.llm.words import batch_rows

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 512
END_ID = 2

INDEX_SCHEMA = "doc_id long, file string, file_no int, row_no long, at long, n_tokens long"


def _schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceFile:
    """Writes ids into equal-length sequences, one batch in memory at a time."""

    def __init__(self, sink, length: int, largest_id: int):
        self.length, self.room = length, length * SEQUENCES_PER_BATCH
        self.dtype = np.dtype("<u2" if largest_id < 1 << 16 else "<u4")
        self.schema = _schema(length, pa.from_numpy_dtype(self.dtype))
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.n_held = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.room:
            values = np.frombuffer(b"".join(self.held), "<u4")
            full = len(values) // self.room * self.room
            for start in range(0, full, self.room):
                self._batch(values[start : start + self.room], self.room)
            self.held, self.n_held = [values[full:].tobytes()], len(values) - full

    def _batch(self, values: np.ndarray, room: int) -> None:
        ids, mask = np.zeros(room, self.dtype), np.zeros(room, bool)
        ids[: len(values)], mask[: len(values)] = values, True
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        values = np.frombuffer(b"".join(self.held), "<u4")
        if len(values):
            self._batch(values, -(-len(values) // self.length) * self.length)
        self.writer.close()


class SequenceReader:
    """Random access to the ids of one file. A local file is mapped, not read."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.room = self.length * SEQUENCES_PER_BATCH
        self.last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, i: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != i:
            self.last = i, self.file.get_batch(i)
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i`` as views of the file."""
        b, row = divmod(i, SEQUENCES_PER_BATCH)
        ids, mask = (self._batch(b).column(c).values for c in ("ids", "mask"))
        at = row * self.length
        view = ids.slice(at, self.length).to_numpy(zero_copy_only=True)
        return view, mask.slice(at, self.length)

    def pieces(self, at: int, n: int) -> Iterator[np.ndarray]:
        """The ``n`` ids from position ``at``, in views of one batch each."""
        while n > 0:
            b, start = divmod(at, self.room)
            values = self._batch(b).column("ids").values.to_numpy(zero_copy_only=True)
            view = values[start : start + n]
            yield view
            at, n = at + len(view), n - len(view)


def write(
    documents: DataFrame,
    folder: str,
    *,
    tokenizer: str = DEFAULT_TOKENIZER,
    end_id: int = END_ID,
    length: int = SEQUENCE,
) -> DataFrame:
    """Write ``documents`` (doc_id, text) below ``folder``; return the index.

    Files follow each other in ascending doc_id (nulls first, equal ids by text).
    A null or empty text is the end id alone. No documents give an empty index.
    Other columns are not read. A task that runs again writes the same file
    under a name of its own, then moves it into place.
    """
    spark = documents.sparkSession
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def write_files(batches):
        part = TaskContext.get().partitionId()
        batches = batch_rows(batches)
        first = next(batches, None)
        if first is None:
            return
        coder = encoder(tokenizer)
        encode = coder.encode
        largest = max(end_id, coder.tokenizer.get_vocab_size() - 1)
        end = np.array([end_id], "<u4").tobytes()
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}.arrow"
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        at = row_no = 0
        with fs.open_output_stream(own) as sink:
            file = SequenceFile(sink, length, largest)
            batch = first
            while batch is not None:
                sizes, places = [], []
                for text in batch.column("text").to_pylist():
                    ids = encode(text) + end
                    file.add(ids)
                    sizes.append(len(ids) // 4)
                    places.append(at)
                    at += sizes[-1]
                n = len(sizes)
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array([f"{uri}/{name}"] * n, pa.string()),
                        pa.array([part] * n, pa.int32()),
                        pa.array(range(row_no, row_no + n), pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.array(sizes, pa.int64()),
                    ],
                    names=["doc_id", "file", "file_no", "row_no", "at", "n_tokens"],
                )
                row_no += n
                batch = next(batches, None)
            file.close()
        fs.move(own, f"{root}/{name}")

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    index_path = f"{folder}/index.parquet"
    ordered.mapInArrow(write_files, INDEX_SCHEMA).write.parquet(index_path)
    return spark.read.schema(INDEX_SCHEMA).parquet(index_path)


def starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before, over all files.

    The running total is over one row per file.
    """
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file_no").withColumn("start", F.col("base") + F.col("at"))


def read_digests(index: DataFrame) -> DataFrame:
    """Per document the unsigned CRC-32 of its ids, read back from the files."""

    def read(batches):
        opened: tuple[str, SequenceReader] | None = None
        for batch in batches:
            sums = []
            for file, at, n in zip(
                *(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))
            ):
                if opened is None or opened[0] != file:
                    opened = file, SequenceReader(file)
                crc = 0
                for view in opened[1].pieces(at, n):
                    crc = zlib.crc32(view.astype("<u4"), crc)
                sums.append(crc)
            yield pa.record_batch(
                [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
                + [pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return (
        starts(index)
        .select("doc_id", "start", "n_tokens", "file", "at")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def token_table(spark: SparkSession, documents: DataFrame, folder: str, **options) -> DataFrame:
    """Write all documents and read every one back from the files."""
    return read_digests(write(documents, folder, **options))
