"""Words, stable hashes and Arrow batches, shared by the operators on texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries a worker keeps per memo before it starts anew.
MEMO_ENTRIES = 150_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


class Memo(dict):
    """A function of one argument that remembers its results, within a bound."""

    def __init__(self, function: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


word_hash = Memo(xxhash.xxh3_64_intdigest)


def utf8(column: str) -> Column:
    """A text as bytes: tasks split bytes without decoding them first."""
    return F.col(column).cast("binary")


def space_words(text: bytes | None) -> list[bytes]:
    """Words between white space 09-0D and 20, with A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words; a shorter text is one run, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * _GOLDEN + hashes[i : n - width + 1 + i])
    # Runs shorter than the asked width can't equal full ones.
    return mix(out + np.uint64(width))


def batch_rows(
    batches: Iterator[pa.RecordBatch], bytes_per_slice: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes, so that long texts don't pile up."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // bytes_per_slice)))
        step = -(-batch.num_rows // parts)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
