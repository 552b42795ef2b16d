"""Arrow and numpy helpers shared by the operators of this package.

Texts reach Python as Arrow string arrays and are handled as one UTF-8 byte buffer plus offsets, so that
splitting into words, hashing and counting are array operations over a bounded chunk of documents. A null
text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed, written  # noqa: F401  (the operators here use them)

#: Bytes of text that one array operation sees at most (a single longer document is a chunk of its own).
CHUNK_BYTES = 2 << 20
#: The same for array operations that hold many numbers for each word.
SMALL_CHUNK_BYTES = 1 << 19
#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 16 << 20

U64 = np.uint64
#: Odd multipliers of hash tables and of the shingles' polynomials.
BASE, SHINGLE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes (they are bounded by rows alone otherwise) unless the user did."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > (1 << 30):
        spark.conf.set(key, str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves remainder 1 by 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trainable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def hash_share(column: Column, share: float) -> Column:
    """A deterministic share of rows by the hash of a column."""
    return F.pmod(F.xxhash64(column, F.lit("share")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1)


class Texts:
    """A chunk of documents: their bytes on end, and where each one starts (n + 1 offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most so many bytes together, or are one document."""
    sizes = np.diff(Texts.of(batch.column(text)).offsets)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over bounded chunks; work returns columns by name (or None for no rows)."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, most):
                if (out := work(part)) is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each [^\\x20\\x09-\\x0D]+ in the bytes, and the number of words before each document (n + 1)."""
    solid = ~SPACE[texts.data]
    size = len(solid)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts.n + 1, np.int64)
    inner = texts.offsets[1:-1]
    cut = np.zeros(size + 1, bool)
    cut[inner[inner < size]] = True
    begins, ends = np.empty(size, bool), np.empty(size, bool)
    begins[0], ends[-1] = solid[0], solid[-1]
    np.logical_and(solid[1:], ~solid[:-1] | cut[1:-1], out=begins[1:])
    np.logical_and(solid[:-1], ~solid[1:] | cut[1:-1], out=ends[:-1])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, texts.offsets)


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every \\n-split line in the bytes, and the number of lines before each document (n + 1)."""
    breaks = np.flatnonzero(texts.data == 10)
    counts = np.searchsorted(breaks, texts.offsets[1:]) - np.searchsorted(breaks, texts.offsets[:-1]) + 1
    firsts = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(firsts[-1], np.int64), np.empty(firsts[-1], np.int64)
    inner = np.ones(firsts[-1], bool)
    inner[firsts[:-1]] = False
    starts[firsts[:-1]], starts[inner] = texts.offsets[:-1], breaks + 1
    inner[:] = True
    inner[firsts[1:] - 1] = False
    ends[firsts[1:] - 1], ends[inner] = texts.offsets[1:], breaks
    return starts, ends, firsts


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (in place)."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans of so many bytes or more are hashed one at a time by the library.
LONG_SPAN = 128


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << U64(by) | x >> U64(64 - by)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, below: int = LONG_SPAN) -> np.ndarray:
    """64-bit hashes of spans of a byte buffer: eight bytes a step in numpy for spans below `below` bytes, XXH64 beyond.

    The steps are XXH64's own for the last bytes of an input, so with below = 32 every hash is XXH64 itself. They are not
    linear, so no plain family of texts collides, as it does under a polynomial modulo 2^64.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    size = ends - starts
    out = U64(seed) + P5 + size.astype(U64)
    eights = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    at = starts.copy()
    short = np.flatnonzero((size >= 8) & (size < below))
    for lane in range(below // 8):
        short = short[size[short] >= 8 * (lane + 1)]
        if not len(short):
            break
        out[short] = _turned(out[short] ^ _turned(eights[at[short]] * P2, 31) * P1, 27) * P1 + P4
        at[short] += 8
    rows = np.flatnonzero((size & 7) >= 4)
    out[rows] = _turned(out[rows] ^ (eights[at[rows]] & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[rows] += 4
    for last in range(3):
        rows = np.flatnonzero((size & 3) > last)
        out[rows] = _turned(out[rows] ^ data[at[rows] + last] * P5, 11) * P1
    out ^= out >> U64(33)
    out *= P2
    out ^= out >> U64(29)
    out *= P3
    out ^= out >> U64(32)
    view = memoryview(data).cast("B")
    for i in np.flatnonzero(size >= below).tolist():
        out[i] = xxhash.xxh64_intdigest(view[starts[i] : ends[i]], seed)
    return out


def shingles(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether these are all of one document."""
    total = len(hashes)
    room = total - n + 1
    if room <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out = np.zeros(room, U64)
    for k in range(n):
        out *= U64(SHINGLE_BASE)
        out += hashes[k : k + room]
    last = np.repeat(firsts[1:], np.diff(firsts))[:room]
    return mixed(out), np.arange(room) + n <= last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of spans, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each document's run of values (firsts: n + 1 offsets), for integers."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


def packed(data: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    at = offsets.tolist()
    return [view[a:b] for a, b in zip(at, at[1:])]
