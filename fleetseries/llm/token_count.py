"""Token counts by rank-synchronous merging of pre-tokens held as ragged arrays.

A batch of texts is cut into pre-tokens; the distinct ones that the worker has
not seen yet lie one after another in flat numpy arrays. In each round every
sequence applies its pair of lowest rank: at all its places if no merge that
becomes possible thereby could have come first, else at the leftmost place
only. A sequence without a known pair is done, and its surviving symbols are
its tokens; a character outside the vocabulary counts its UTF-8 bytes.

Texts are counted where they lie: no shuffle, and the memory of a task is
bounded by a batch of texts and a cache of pre-token counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_batches
from .pieces import SPACE, code_points, pretokens, utf8_length, vocabulary
from .queries import query

OVER_LIMIT = 4096
#: Pre-tokens whose counts a worker remembers before it starts afresh.
CACHE = 600_000
_FAR = np.int64(1) << 40


class MergeTable:
    """Ranks of symbol pairs: sorted keys (left << 32 | right), rank, resulting piece."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.char_id = vocab.char_id
        pieces, score = vocab.pieces, vocab.score
        order = np.unique(-score[list(pieces.values())])
        rank = {p: int(np.searchsorted(order, -score[i])) for p, i in pieces.items()}
        rows = []
        best_around: dict[str, int] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if left in pieces and right in pieces:
                    rows.append((pieces[left] << 32 | pieces[right], rank[p], i))
                for part in (left, right):
                    best_around[part] = min(best_around.get(part, 1 << 40), rank[p])
        rows.sort()
        self.key, self.rank, self.result = (np.array(c, dtype=np.int64) for c in zip(*rows))
        hasty = {i for p, i in pieces.items() if best_around.get(p, 1 << 40) <= rank[p]}
        #: Whether a merge into this pair's piece can make a pair that comes before or level with it.
        self.one_by_one = np.array([r[2] in hasty for r in rows])
        # a run of marks alone: the longest piece of marks that merging reaches, found by the merges themselves
        self.run = max((len(p) for p in pieces if set(p) == {SPACE}), default=1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, or -1."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), at, -1)


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def surviving_symbols(words: list[str], merges: MergeTable) -> np.ndarray:
    """Number of tokens of each (spelled) pre-token."""
    out = np.zeros(len(words), dtype=np.int64)
    for seq, sym, codes in merged(words, merges):
        np.add.at(out, seq, np.where(sym < 0, utf8_length(codes), 1))
    return out


def merged(words: list[str], merges: MergeTable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The symbols of (spelled) pre-tokens, as pre-tokens are done: index of the pre-token, piece id, first code point.

    Symbols of a pre-token come together and in order; characters that no piece covers have the id -1.
    """
    codes, lens = code_points(words)
    sym = merges.char_id[codes].astype(np.int64)
    seq = np.repeat(np.arange(len(words)), lens)
    pair = np.full(len(sym), -1, dtype=np.int64)
    pair[:-1] = np.where(seq[:-1] == seq[1:], merges.find(sym[:-1], sym[1:]), -1)
    while len(sym):
        rank = np.where(pair >= 0, merges.rank[pair], _FAR)
        first = np.flatnonzero(np.diff(seq, prepend=-1))
        size = np.diff(np.append(first, len(seq)))
        low = np.minimum.reduceat(rank, first)
        done = low == _FAR
        if done.any():
            stay = np.repeat(~done, size)
            yield seq[~stay], sym[~stay], codes[~stay]
            sym, seq, pair, rank, codes = sym[stay], seq[stay], pair[stay], rank[stay], codes[stay]
            if not len(sym):
                break
            size, low = size[~done], low[~done]
            first = np.cumsum(size) - size
        at = np.flatnonzero(rank == np.repeat(low, size))
        own = seq[at]
        leftmost = np.append(True, own[1:] != own[:-1])
        run_start = np.append(True, at[1:] != at[:-1] + 1) | leftmost
        offset = at - np.maximum.accumulate(np.where(run_start, at, 0))
        same = pair[at] == np.repeat(pair[at[leftmost]], np.diff(np.append(np.flatnonzero(leftmost), len(at))))
        at = at[leftmost | (~merges.one_by_one[pair[at]] & (offset % 2 == 0) & same)]
        sym[at] = merges.result[pair[at]]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        here = at - np.arange(len(at))
        sym, seq, pair, codes = sym[stay], seq[stay], pair[stay], codes[stay]
        touched = np.zeros(len(seq) + 1, dtype=bool)
        touched[here] = touched[here - 1] = True  # entry -1 stands for no symbol
        around = np.flatnonzero(touched[:-1])
        pair[around] = -1
        around = around[: len(around) - (around[-1] + 1 == len(seq))]
        around = around[seq[around] == seq[around + 1]]
        pair[around] = merges.find(sym[around], sym[around + 1])


def shorten(tokens: list[str], run: int) -> tuple[list[str], np.ndarray]:
    """Spelled pre-tokens without the whole longest pieces of marks at the front of long runs, and the number of those.

    Every merge with a letter comes before merges of marks alone, and marks
    merge from the left, so a run fills pieces of ``run`` marks one after another.
    """
    words = [t if t[0] == SPACE else SPACE + t for t in tokens]
    whole = np.zeros(len(words), dtype=np.int64)
    for k, word in enumerate(words):
        if word.startswith(SPACE * 2 * run):
            whole[k] = (len(word) - len(word.lstrip(SPACE)) - 2 * run) // run
            words[k] = word[whole[k] * run :]
    return words, whole


_seen: dict[str, dict[str, int]] = {}


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    merges = merge_table(path)
    split = [pretokens(t) for t in texts]
    seen = _seen.setdefault(path, {})
    wanted = set().union(*split) if split else set()
    new = wanted - seen.keys()
    if len(seen) + len(new) > CACHE:
        seen.clear()
        new = wanted
    if new:
        words, whole = shorten(list(new), merges.run)
        seen.update(zip(new, (surviving_symbols(words, merges) + whole).tolist()))
    return [sum(map(seen.__getitem__, tokens)) for tokens in split]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, "text"):
            texts = part.column("text")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").combine_chunks(),
                    pc.cast(pc.binary_length(texts), pa.int64()).combine_chunks(),
                    pa.array(count_tokens(texts.to_pylist(), path), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens: one per row of ``docs`` (doc_id, text; others are not read).

    Counts are those of the library for the BPE model at ``path`` without begin
    and end tokens; the strings of special tokens are ordinary text. Null or
    empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated
    rows give a row each; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
