"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

The symbols of the search are words. A pattern is a window of ``window``
consecutive words of an item (an item of fewer words is one pattern by
itself); patterns of one length share a shift table over blocks of two words,
so most positions are skipped by ``length - 1`` words at a time. Where the
shift is zero, the bucket of that suffix block lists the patterns that may end
there; the hash of their first block is compared, then the words themselves.

Documents are scanned where they lie: no shuffle. The items are read in blocks
of about ``PATTERN_BYTES`` of text; each block's tables are broadcast, and its
hits are merged with those of the other blocks in the same row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, BATCH_BYTES, Words, mix, small_batches, table
from .queries import query

WINDOW = 10
#: Item text in one broadcast block of patterns.
PATTERN_BYTES = 2 << 20


class WuManber:
    """Shift and suffix tables for all patterns of one length (in words)."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, bytes, list[str]]]] = {}
        self._at: dict[bytes, list[str]] = {}

    def add(self, words: list[bytes], blocks: list[int], item: str) -> None:
        """``blocks[i]`` is the hash of the block that ends at word ``i``."""
        text = b" ".join(words)
        if text in self._at:
            if item not in self._at[text]:
                self._at[text].append(item)
            return
        items = self._at[text] = [item]
        n = self.length
        for i in range(self.block - 1, n):
            self.shift[blocks[i]] = min(self.shift.get(blocks[i], self.skip), n - 1 - i)
        self.bucket.setdefault(blocks[n - 1], []).append((blocks[self.block - 1], text, items))

    def scan(self, words: Words, blocks: list[int], first: int, last: int) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every occurrence among the words first..last-1."""
        shift, bucket, skip, n = self.shift, self.bucket, self.skip, self.length
        back = n - self.block
        i = first + n - 1
        while i < last:
            ahead = shift.get(blocks[i])
            if ahead is None:
                i += skip
            elif ahead:
                i += ahead
            else:
                head, at, here = blocks[i - back], i - n + 1, None
                for front, text, items in bucket[blocks[i]]:
                    if front == head:
                        if here is None:
                            here = b" ".join([words.text(k) for k in range(at, i + 1)])
                        if here == text:
                            yield at, items
                i += 1


def block_hashes(words: Words, block: int) -> np.ndarray:
    """Hash of the block of words that ends at each word (the first of a text is never asked for)."""
    if block == 1 or len(words.hash) < 2:
        return words.hash
    return np.concatenate([words.hash[:1], mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])])


def build_tables(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    words = Words([text for _, text in items], ALNUM_WORD)
    per_block = {b: block_hashes(words, b).tolist() for b in (1, 2)}
    tables: dict[int, WuManber] = {}
    for k, (item, _) in enumerate(items):
        first, last = int(words.first[k]), int(words.first[k + 1])
        n = min(window, last - first)
        if not n:
            continue
        own = tables.setdefault(n, WuManber(n))
        text = [words.text(j) for j in range(first, last)]
        for j in range(first, last - n + 1):
            own.add(text[j - first : j - first + n], per_block[own.block][j : j + n], item)
    return list(tables.values())


def _item_blocks(benchmark: DataFrame, pattern_bytes: int) -> list[list[tuple[str, str | None]]]:
    """The items in lists of about ``pattern_bytes`` of text, collected one list at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where(
        "item is not null and text is not null"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // pattern_bytes))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for b in range(n):
        yield [(r.item, r.text) for r in dealt.where(F.col("b") == b).select("item", "text").collect()]


_FOUND = "struct<n_words:long,hit_words:array<int>,items:array<string>>"


def _merged(spans: list[int]) -> list[int]:
    """A flat list of (first, after last) as disjoint spans in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scanner(shared):
    """A function of the text: its words, the spans of words inside windows, and the items these belong to."""

    def scan(texts: list[str | None]) -> list[dict]:
        tables = shared.value
        words = Words(texts, ALNUM_WORD)
        blocks = {b: block_hashes(words, b).tolist() for b in {t.block for t in tables}}
        first, out = words.first.tolist(), []
        for a, b in zip(first, first[1:]):
            spans, items = [], set()
            for t in tables:
                for at, names in t.scan(words, blocks[t.block], a, b):
                    if len(spans) > 1 and spans[-2] <= at - a <= spans[-1]:
                        spans[-1] = max(spans[-1], at - a + t.length)
                    else:
                        spans += [at - a, at - a + t.length]
                    items.update(names)
            out.append({"n_words": b - a, "hit_words": _merged(spans), "items": sorted(items)})
        return out

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        out, step = [], max(1, len(texts) * BATCH_BYTES // max(texts.nbytes, 1))
        for a in range(0, len(texts), step):
            out += scan(texts.slice(a, step).to_pylist())
        return pa.array(out, _ARROW_FOUND)

    return found


_ARROW_FOUND = pa.struct(
    [("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)


def _merger():
    """A function of what two blocks of patterns found in the same texts."""

    @F.arrow_udf(_FOUND)
    def both(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [
            {**x, "hit_words": _merged(x["hit_words"] + y["hit_words"]), "items": sorted({*x["items"], *y["items"]})}
            for x, y in zip(left.to_pylist(), right.to_pylist())
        ]
        return pa.array(out, _ARROW_FOUND)

    return both


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES, into: str = "__found"
) -> DataFrame:
    """``docs`` with a struct column ``into``: the words of ``text`` that lie inside a benchmark window.

    Fields: n_words; hit_words, a flat array of first word and word after the
    last of each merged hit; items, the ids, as sorted strings, of the items
    with an occurring window.

    Null or empty text has no words and no hits. Items with null id or no words
    match nothing; items of equal text are all reported. Other columns and
    repeated rows stay as they are; an empty ``benchmark`` gives no hits.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    out = None
    for items in _item_blocks(benchmark, pattern_bytes):
        own = _scanner(spark.sparkContext.broadcast(build_tables(items, window)))(F.col("text"))
        out = own if out is None else _merger()(out, own)
    return docs.withColumn(into, out)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, p.item FROM g JOIN p ON g.win = p.win AND g.n = p.n),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
       FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op7_decontaminate", ORACLE)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").cast("long").alias("doc_id"), "__found.*")
    after = F.aggregate("hit_words", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("s")), _hit_words, lambda a: a["n"])
    return found.select(
        "doc_id",
        "n_words",
        after.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def _hit_words(sum_, x):
    """Adds up the lengths of spans given as a flat array: ends count, starts are taken off."""
    ends = sum_["s"] > 0
    return F.struct((sum_["n"] + F.when(ends, x).otherwise(-x)).alias("n"), (-sum_["s"]).alias("s"))
