"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a task holds at once; a single longer text is held whole.
BATCH_BYTES = 4 << 20
#: Bytes of words whose hashes are computed at once.
HASHED_BYTES = 1 << 19
#: Rows and bytes of the Arrow batches that tasks receive, whichever is reached first.
ARROW_ROWS = 2000
ARROW_BYTES = 8 << 20

_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def _by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    cut = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(cut)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches so that each holds about ``limit`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in _by_bytes(batch, column, limit):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)
    held = []
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that is kept for the next task or stage holds none of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True outside the given inclusive byte ranges."""
    out = np.ones(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: Lower-cases A-Z and leaves every other byte, UTF-8 sequences included, as it is.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: Word bytes of the two word patterns in use (bytes from 0x80 on belong to words).
ALNUM_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACED_WORD = byte_class((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


_MULT = _U64(0x9E3779B97F4A7C15 | 1)
#: Powers of the multiplier by place in a word that a worker keeps; longer words get theirs for the batch.
KEPT_POWERS = 1 << 12
_powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U64), np.full(KEPT_POWERS - 1, _MULT)]))


def _power(longest: int) -> np.ndarray:
    """The powers 0, 1, ... of the multiplier for places in words of up to ``longest`` bytes."""
    if longest <= KEPT_POWERS:
        return _powers
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U64), np.full(longest - 1, _MULT)]))


class Words:
    """The words of a list of texts as offsets into one lower-cased byte buffer.

    ``start``/``end`` are byte offsets, ``doc`` the index of the text of each
    word, ``first`` the index of each text's first word (one entry more than
    texts) and ``hash`` a 64-bit hash of each word's bytes.
    """

    def __init__(self, texts: list[str | None], word_bytes: np.ndarray):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        self.buf = LOWER_BYTES[np.frombuffer(joined, dtype=np.uint8)]
        inside = word_bytes[self.buf].view(np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Of each word the sum of (byte + 1) * multiplier ** place, mixed with its length."""
        size = self.end - self.start
        out = np.zeros(len(size), dtype=_U64)
        if not len(size):
            return out
        power = _power(int(size.max()))
        edges = np.concatenate([[0], np.cumsum(size)])
        cut = np.unique(np.searchsorted(edges, np.arange(0, edges[-1], HASHED_BYTES)))  # words of about that many bytes at a time
        for a, b in zip(cut, [*cut[1:], len(size)]):
            if b > a:
                first = edges[a:b] - edges[a]
                place = np.arange(edges[b] - edges[a]) - np.repeat(first, size[a:b])
                at = place + np.repeat(self.start[a:b], size[a:b])
                out[a:b] = np.add.reduceat((self.buf[at].astype(_U64) + _U64(1)) * power[place], first)
        return mix(out ^ mix(size.astype(_U64)))

    def text(self, k: int) -> bytes:
        return self.buf[self.start[k] : self.end[k]].tobytes()
