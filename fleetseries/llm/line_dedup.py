"""Line deduplication with sharded cuckoo filters over exact reference counts.

State in the shared folder, one new version per change, so a failed job leaves
the last version as it was:

* ``counts``: (shard, h1, h2, n): the number of documents that hold each line
  key, the key named by 128 bits of hash. Exact: inserting documents adds,
  deleting them subtracts, so deletion undoes insertion.
* ``filters``: one row per shard: a cuckoo filter of the keys with at least
  ``min_docs`` documents, and the exceptions, i.e. the shard's other keys that
  the filter takes for members. Filter and exceptions together answer exactly
  for every key that the counts hold. A change only inserts the keys that
  reached the threshold and deletes those that fell below it.

Documents are cleaned without moving them: the filters, whose measured size is
checked first, go to the tasks, and each task tests the hashes of its lines.
Beyond ``FILTER_BYTES`` the lines of the distinct texts meet the counts in a
shuffle join instead; the result is the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.session import new_scratch_path

from .common import small_batches, table, text_batches
from .queries import query

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of one shard; bounds what a task holds when it rebuilds a filter.
SHARD_KEYS = 200_000
#: Total size of filters and exceptions up to which they are sent to every task.
FILTER_BYTES = 64 << 20

FILTER_SCHEMA = "shard int, filter binary, exceptions binary"

_SLOTS = 4
_KICKS = 500


class CuckooFilter:
    """Cuckoo filter over pairs of 64-bit hashes: 4 slots a bucket, 16-bit fingerprints, partial-key kicks."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(keys * 1.25 / _SLOTS)).bit_length()
        return cls(np.zeros((buckets, _SLOTS), dtype=np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, _SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (h2 & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h1 >> np.uint64(20)) & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((mark * np.uint64(0x5BD1E995)) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(h1, h2)
        m = mark[:, None]
        return (self.table[a] == m).any(axis=1) | (self.table[b] == m).any(axis=1)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if free.size:
            self.table[bucket, free[0]] = mark
        return bool(free.size)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Add the keys; False if the table is too full (then build a larger one)."""
        state = 12345
        for mark, a, b in zip(*(x.tolist() for x in self._places(h1, h2))):
            if self._put(a, mark) or self._put(b, mark):
                continue
            at = a
            for _ in range(_KICKS):
                state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (state >> 16) % _SLOTS
                out = int(self.table[at, slot])
                self.table[at, slot] = mark
                mark = out
                at = int(self._other(np.uint64(at), np.uint64(mark)))
                if self._put(at, mark):
                    break
            else:
                return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(h1, h2))):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == mark)
                if at.size:
                    self.table[bucket, at[0]] = 0
                    break


#: Stands for the hash of a key that is too short to be dropped.
_NONE = bytes(16)


def line_digests(text: bytes | None, min_chars: int) -> list[bytes]:
    """The 128-bit hash of the key of each line of a UTF-8 text (bytes.lower and bytes.strip are ASCII only)."""
    keys = [line.strip() for line in (text or b"").lower().split(b"\n")]
    if min_chars > 1:
        return [blake2b(k, digest_size=16).digest() if len(k.decode()) >= min_chars else _NONE for k in keys]
    return [blake2b(k, digest_size=16).digest() if k else _NONE for k in keys]


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)


def _as_bytes(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (h1, h2, n): the keys of the documents, each document counted once, summed within batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, "text", 16 << 20):
            found: Counter[bytes] = Counter()
            for text in _as_bytes(part.column("text")):
                found.update(set(line_digests(text, min_chars)))
            found.pop(_NONE, None)
            pairs = _pairs(list(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(list(found.values()), pa.int64())],
                names=["h1", "h2", "n"],
            )

    return docs.select("text").mapInArrow(run, "h1 long, h2 long, n long")


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _rebuild(min_docs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(keys: pa.Table, old: pa.Table) -> pa.Table:
        """The new filter row of a shard from its keys (n before and after) and its old filter row."""
        h1, h2 = _unsigned(keys.column("h1")), _unsigned(keys.column("h2"))
        was = keys.column("was").to_numpy() >= min_docs
        now = keys.column("n").to_numpy() >= min_docs
        done = False
        if old.num_rows:
            kept = CuckooFilter.load(old.column("filter")[0].as_py())
            kept.delete(h1[was & ~now], h2[was & ~now])
            done = kept.insert(h1[now & ~was], h2[now & ~was])
        size = int(now.sum())
        while not done:
            kept = CuckooFilter.sized(size)
            done = kept.insert(h1[now], h2[now])
            size = 2 * size + 1
        rest = ~now & (keys.column("n").to_numpy() > 0)
        rest[rest] = kept.contains(h1[rest], h2[rest])
        exceptions = np.stack([h1[rest], h2[rest]], axis=1)
        shard = keys.column("shard")[0] if keys.num_rows else old.column("shard")[0]
        return pa.table(
            {
                "shard": pa.array([shard.as_py()], pa.int32()),
                "filter": pa.array([kept.dump()], pa.binary()),
                "exceptions": pa.array([exceptions.tobytes()], pa.binary()),
            }
        )

    return run


class LineIndex:
    """Reference counts and filters of line keys at a versioned path in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.path, self.version, self.shards = new_scratch_path(spark, "line-index"), 0, 0

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}/{name}")

    def counts(self) -> DataFrame:
        return self._table("counts")

    def filters(self) -> DataFrame:
        return self._table("filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back documents that were inserted before."""
        return self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        path = f"{self.path}/v{self.version + 1}"
        change = document_keys(docs, self.min_chars).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        change = change.select("h1", "h2", (F.col("n") * sign).alias("n"), F.lit(0).cast("long").alias("was"))
        if self.version:
            old = self.counts().select("h1", "h2", "n", F.col("n").alias("was"))
            change = change.unionByName(old).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        change.write.parquet(f"{path}/keys")
        keys = self.spark.read.parquet(f"{path}/keys")
        shards = 1 << (keys.count() // SHARD_KEYS).bit_length()
        sharded = keys.withColumn("shard", F.pmod("h1", F.lit(max(shards, self.shards))).cast("int"))
        sharded.where("n > 0").select("h1", "h2", "n").write.parquet(f"{path}/counts")
        if self.version and shards <= self.shards:
            old_filters = self.filters()
        else:  # the first version, or more shards than before: the filters are built anew
            old_filters = self.spark.createDataFrame([], FILTER_SCHEMA)
        sharded.groupBy("shard").cogroup(old_filters.groupBy("shard")).applyInArrow(
            _rebuild(self.min_docs), FILTER_SCHEMA
        ).write.parquet(f"{path}/filters")
        self.shards = max(shards, self.shards)
        self.version += 1
        return self

    def _send(self):
        """A broadcast of all filters, or None if they are too large for it."""
        size = self.filters().agg(F.sum(F.length("filter") + F.length("exceptions"))).first()[0] or 0
        if size > FILTER_BYTES:
            return None
        rows = self.filters().collect()
        return self.spark.sparkContext.broadcast({r.shard: (bytes(r.filter), bytes(r.exceptions)) for r in rows})

    def clean(self, docs: DataFrame, into: str = "__lines") -> DataFrame:
        """``docs`` with a column ``into``: struct of kept (text), n_lines, n_dropped.

        Every document must have been inserted before; then the answer is exact.
        """
        small_batches(self.spark)
        sent = self._send()
        if sent is None:
            return self.clean_by_join(docs, into)
        return docs.withColumn(into, _cleaner(sent, self.shards, self.min_chars)(F.col("text")))

    def clean_by_join(self, docs: DataFrame, into: str = "__lines") -> DataFrame:
        """The same by a shuffle join of the lines of the distinct texts with the counts."""
        min_chars = self.min_chars

        @F.arrow_udf("array<struct<h1:long,h2:long>>")
        def hashes(texts: pa.Array) -> pa.Array:
            lists = [line_digests(t, min_chars) for t in _as_bytes(texts)]
            pairs = _pairs([d for x in lists for d in x])
            both = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["h1", "h2"])
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), both)

        text = F.coalesce("text", F.lit(""))
        name = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), F.length(text).alias("n"))
        named = docs.withColumn("__name", name)
        distinct = named.groupBy("__name").agg(F.first(text).alias("text"))
        lines = distinct.select("__name", F.posexplode(hashes("text")).alias("__at", "__key"))
        frequent = self.counts().where(F.col("n") >= self.min_docs).select(F.struct("h1", "h2").alias("__key"))
        found = lines.join(frequent, "__key", "left_semi")
        found = found.groupBy(F.col("__name").alias("__found")).agg(F.collect_list("__at").alias("__drop"))
        marked = named.join(found, F.col("__name") == F.col("__found"), "left")
        drop = F.coalesce("__drop", F.array().cast("array<int>"))
        kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(drop, i))
        out = F.struct(
            F.array_join(kept, "\n").alias("kept"),
            F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
            F.size(drop).cast("long").alias("n_dropped"),
        )
        return marked.withColumn(into, out).drop("__name", "__found", "__drop")


def _cleaner(sent, shards: int, min_chars: int):
    """A function of the text: the text without its frequent lines, and how many lines there were and went."""
    loaded: dict[int, tuple[CuckooFilter, set]] = {}

    def frequent(digests: list[bytes]) -> np.ndarray:
        pairs = _pairs(digests)
        h1, h2 = (np.ascontiguousarray(pairs[:, k]).view(np.uint64) for k in (0, 1))
        out = np.zeros(len(pairs), dtype=bool)
        shard = np.where(pairs.any(axis=1), pairs[:, 0] % shards, -1)
        for s in np.unique(shard).tolist():
            if s not in loaded:
                if s not in sent.value:
                    continue
                data, rest = sent.value[s]
                others = np.frombuffer(rest, dtype=np.uint64).reshape(-1, 2).tolist()
                loaded[s] = CuckooFilter.load(data), set(map(tuple, others))
            kept, others = loaded[s]
            at = np.flatnonzero(shard == s)
            at = at[kept.contains(h1[at], h2[at])]
            if others and at.size:
                at = at[[pair not in others for pair in zip(h1[at].tolist(), h2[at].tolist())]]
            out[at] = True
        return out

    @F.arrow_udf("struct<kept:string,n_lines:long,n_dropped:long>")
    def clean(texts: pa.Array) -> pa.Array:
        raw = [t or b"" for t in _as_bytes(texts)]
        lists = [line_digests(t, min_chars) for t in raw]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        drop = frequent([d for x in lists for d in x])
        ends = np.cumsum(sizes)
        dropped = np.diff(np.concatenate([[0], np.cumsum(drop)])[np.concatenate([[0], ends])])
        for k in np.flatnonzero(dropped).tolist():
            own = drop[ends[k] - sizes[k] : ends[k]].tolist()
            raw[k] = b"\n".join([line for line, gone in zip(raw[k].split(b"\n"), own) if not gone])
        return pa.StructArray.from_arrays(
            [pa.array(raw, pa.binary()).cast(pa.string()), pa.array(sizes), pa.array(dropped, pa.int64())],
            ["kept", "n_lines", "n_dropped"],
        )

    return clean


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, into: str = "__lines"
) -> DataFrame:
    """``docs`` with a struct column ``into``: kept (the text without frequent lines), n_lines, n_dropped.

    A line's key is the line without white space (space, tab to carriage
    return) at both ends, A-Z lower-cased. A key of at least ``min_chars``
    characters that occurs in at least ``min_docs`` rows of ``docs`` loses all
    its lines. Null and empty text have one empty line, which stays. Every row
    is a document, repeated rows too; other columns stay as they are.
    """
    return LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs).clean(docs, into)


ORACLE = """
WITH l AS (
  SELECT doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rn) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY rn, doc_id
"""


@query("op8_line_dedup", ORACLE)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "__lines.n_lines",
        "__lines.n_dropped",
        F.sha2(F.col("__lines.kept").cast("binary"), 256).alias("kept_sha256"),
    )
