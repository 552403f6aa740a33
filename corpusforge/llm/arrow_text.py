"""Word spans and hashes of whole Arrow string batches, in numpy.

A batch holds its texts in one buffer, so words, word hashes and shingles of many texts come from a few array
operations.  Hashes are polynomials modulo 2**64 with an odd base, taken from one running sum and finished by a
bit mixer; two different words or shingles agree with a chance of about their length over 2**64.
"""

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def worker_path(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    _, offsets = _buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the work on one has freed goes back to the system before the next, and when a task ends.

    Workers live on between tasks and stages, and their allocators keep what they have freed.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and their bounds; a null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


class Words:
    """Words of every text: byte bounds in ``data``, and ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: pa.Array, gaps: np.ndarray = ASCII_SPACE, fold: np.ndarray | None = None):
        data, self.offsets = _buffers(texts)
        self.data = data if fold is None else fold[data]
        solid = ~gaps[self.data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.stops)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1024), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of ``values[start:stop]`` for any spans, after one pass over the values."""

    def __init__(self, values: np.ndarray):
        up, self.down = _grown(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        plain = (self.total[stops] - self.total[starts]) * self.down[starts]
        return mixed(plain + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return SpanHasher(values)(starts, stops)


def log2_ceil(n: int) -> int:
    return max(0, int(n - 1).bit_length())
