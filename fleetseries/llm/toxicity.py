"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, hashed into a fixed
number of embedding rows; a text is the average of its words; a linear softmax
over the average gives two classes. Embeddings and softmax are trained
together by Adam on a bounded sample of labelled rows (``SAMPLE`` of each
class, chosen by a hash of the row, whole texts). A misspelling that was never
seen shares most n-grams with the word it stands for.

As the text vector is an average, the score of a text is the average of
per-word numbers; a task computes those once per distinct word of a batch.
Scoring moves nothing; the model that is sent to the tasks has a fixed size.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, mix, small_batches, table
from .pieces import code_points
from .queries import query

#: Labelled rows of each class that training uses at most (a documented bound of the sample).
SAMPLE = 6000
#: Rows of the embedding table, its width, and the lengths of the character n-grams.
ROWS = 1 << 20
WIDTH = 4
GRAMS = (3, 4, 5)
EPOCHS = 120
RATE = 0.3
DECAY = 1e-7
#: Training texts that must share an embedding row for it to be learnt.
MIN_TEXTS = 15
#: Share of the loss that the clean class has, whatever the numbers of rows.
CLEAN_WEIGHT = 0.65
#: Logit of a text without words at the start of training.
PRIOR = -3.0
#: Least scale of a row's steps, as a share of the largest row's scale.
FLOOR = 0.1
#: Entries (words of texts, rows of words) that a step of training has in work at a time.
BLOCK = 1_000_000
#: Word scores that a task remembers before it starts afresh.
CACHE = 150_000
#: Bytes of texts whose words are counted at once.
SCORED_BYTES = 1 << 20
_EDGES = ".,;:!?\"'()[]{}<>«»„“”‚‘’…-–—|*#$%&_/\\"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _damped(times: np.ndarray) -> np.ndarray:
    """Weight of a word in its text: it grows with the logarithm of its count, so one repeated word does not fill a text."""
    return 1 + np.log(times)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words one after another, and the number of rows of each word."""
    marked = [f"<{w.strip(_EDGES)}>" for w in words]
    codes, lens = code_points(marked)
    ends = np.cumsum(lens)
    word = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(codes))  # characters up to the end of the word
    letters = mix(codes.astype(np.uint64) + np.uint64(1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(letters * _weights(lens))])
    whole = mix(total[ends] - total[ends - lens])
    rows, owner = [whole], [np.arange(len(words))]
    h = letters
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[n - 1 :] if len(h) > 1 else h[:0]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            rows.append(mix(h[at] + np.uint64(n)))
            owner.append(word[at])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (rows[order] % np.uint64(ROWS)).astype(np.int32), np.bincount(owner, minlength=len(words))


def _weights(lens: np.ndarray) -> np.ndarray:
    """Odd multipliers by place in the word, so that a word's sum names its letters in order."""
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over each slice of consecutive rows (an empty slice has sum 0)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


@dataclass
class Model:
    """What scoring needs: the number of each embedding row (its product with the softmax), and the bias."""

    row_score: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        rows, sizes = subwords(words)
        return _sums(self.row_score[rows], sizes) / np.maximum(sizes, 1)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit + self.bias, -40, 40)))


def _blocks(sizes: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, lo, hi): consecutive slices a:b with about ``limit`` entries, which are lo:hi of all"""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
        yield a, b, int(ends[a]), int(ends[b])
        a = b


def _subword_parts(words: Iterable[str], step: int = 20_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The number of the first word of each part of ``words``, and what ``subwords`` gives for the part."""
    rest, a = iter(words), 0
    while part := list(islice(rest, step)):
        yield a, *subwords(part)
        a += len(part)


def train(texts: Iterable[str | None], labels: Sequence[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit embeddings and softmax together; the classes have fixed weights whatever their numbers."""
    index: dict[str, int] = {}
    found, counts, sizes = array("i"), array("f"), array("i")
    for t in texts:
        bag = Counter(words_of(t))
        found.extend([index.setdefault(w, len(index)) for w in bag])
        counts.extend(bag.values())
        sizes.append(len(bag))
    labels = np.array(labels, dtype=np.int64)  # may be filled as the texts are read
    if not index or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(ROWS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    n_texts, n_words = len(sizes), len(index)
    word, share, sizes = (np.frombuffer(x, dtype=k) for x, k in ((found, np.int32), (counts, np.float32), (sizes, np.int32)))
    in_texts = list(_blocks(sizes))
    texts_of_word = np.zeros(n_words, dtype=np.int64)
    for a, b, lo, hi in in_texts:
        times = _damped(share[lo:hi])
        length = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), weights=times, minlength=b - a)
        share[lo:hi] = times / np.repeat(np.maximum(length, 1), sizes[a:b])
        texts_of_word += np.bincount(word[lo:hi], minlength=n_words)
    weight = np.where(labels == 1, (1 - CLEAN_WEIGHT) / (labels == 1).sum(), CLEAN_WEIGHT / (labels == 0).sum())

    # The vector of a text is sum(share x mean of the word's rows) and the class a product with ``soft``; so
    # forward and backward passes need one number per embedding row, per word and per text.
    # Rows that few texts share stay at zero (what they would learn is chance), so they are left out from the start.
    texts_of_row = np.zeros(ROWS)
    for a, rows, n in _subword_parts(index):
        texts_of_row += np.bincount(rows, weights=np.repeat(texts_of_word[a : a + len(n)], n), minlength=ROWS)
    known = texts_of_row >= MIN_TEXTS
    used = np.flatnonzero(known)
    place = np.zeros(ROWS, dtype=np.int32)
    place[used] = np.arange(len(used))
    kept, n_kept, n_rows = [], [], []
    for _, rows, n in _subword_parts(index):
        mine = known[rows]
        kept.append(place[rows[mine]])
        n_kept.append(np.bincount(np.repeat(np.arange(len(n)), n)[mine], minlength=len(n)).astype(np.int32))
        n_rows.append(n)
    del index, texts_of_row, known, place, texts_of_word
    rows, n_kept, n_rows = (np.concatenate(x) for x in (kept, n_kept, n_rows))
    del kept
    in_words = list(_blocks(n_kept))
    rng = np.random.default_rng(seed)
    table_ = (rng.standard_normal((len(used), WIDTH)) * 0.01).astype(np.float32)
    soft, bias = rng.standard_normal(WIDTH) / np.sqrt(WIDTH), PRIOR
    moment, spread = np.zeros_like(table_), np.zeros_like(table_)
    word_score, z = np.zeros(n_words), np.zeros(n_texts)
    for step in range(1, epochs + 1):
        row_score = (table_ @ soft).astype(np.float32)
        for a, b, lo, hi in in_words:
            own = np.repeat(np.arange(b - a), n_kept[a:b])
            word_score[a:b] = np.bincount(own, weights=row_score[rows[lo:hi]], minlength=b - a)
        word_score /= n_rows
        for a, b, lo, hi in in_texts:
            own = np.repeat(np.arange(b - a), sizes[a:b])
            z[a:b] = np.bincount(own, weights=share[lo:hi] * word_score[word[lo:hi]], minlength=b - a) * SCALE + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * weight
        word_pull = np.zeros(n_words)
        for a, b, lo, hi in in_texts:
            word_pull += np.bincount(word[lo:hi], weights=np.repeat(error[a:b], sizes[a:b]) * share[lo:hi], minlength=n_words)
        word_pull *= SCALE / n_rows
        pull = np.zeros(len(used))
        for a, b, lo, hi in in_words:
            pull += np.bincount(rows[lo:hi], weights=np.repeat(word_pull[a:b], n_kept[a:b]), minlength=len(used))
        grad = (pull[:, None] * soft[None, :] + DECAY * table_).astype(np.float32)
        soft_grad = table_.T @ pull
        moment = 0.9 * moment + 0.1 * grad
        # a row's own scale, but not below a share of the largest: rows with little to say move little
        spread = 0.99 * spread + 0.01 * grad * grad
        scale = np.sqrt(spread / (1 - 0.99**step))
        table_ -= RATE * (moment / (1 - 0.9**step)) / (scale + FLOOR * scale.max() + 1e-12)
        soft -= 0.1 * RATE * soft_grad / (np.abs(soft_grad).max() + 1e-12)
        bias -= 0.1 * error.sum() / weight.sum()
    row_score = np.zeros(ROWS)
    row_score[used] = table_ @ soft * SCALE
    return Model(row_score, float(bias))


#: Averages of long texts are small; logits are scaled so that training moves at the same pace.
SCALE = 10.0


def scorer(spark: SparkSession, model: Model):
    """A function of the text column: the score of each text (0 to 1, higher: toxic)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    seen: dict[str, float] = {}

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        out = []
        step = max(1, len(texts) * SCORED_BYTES // max(texts.nbytes, 1))
        for a in range(0, len(texts), step):
            bags = [Counter(words_of(t)) for t in texts.slice(a, step).to_pylist()]
            wanted = set().union(*bags)
            new = list(wanted - seen.keys())
            if len(seen) + len(new) > CACHE:
                seen.clear()
                new = list(wanted)
            if new:
                seen.update(zip(new, shared.value.word_scores(new).tolist()))
            sizes = np.array([len(b) for b in bags], dtype=np.int64)
            times = np.fromiter(chain.from_iterable(b.values() for b in bags), dtype=np.float64, count=sizes.sum())
            each = np.fromiter(map(seen.__getitem__, chain.from_iterable(bags)), dtype=np.float64, count=sizes.sum())
            weight = _damped(times)
            out.append(shared.value.score(_sums(each * weight, sizes) / np.maximum(_sums(weight, sizes), 1)))
        give_back()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score_of


def held_out(doc_id) -> F.Column:
    """Rows that never train: crc32 of the id as text is divisible by 5 (a null id trains nothing either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled rows of each class, none of them held out.

    A document with several label rows is toxic if one of them says so.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id"))
    marks = marks.agg(F.max(F.col("toxic").cast("int")).alias("__toxic")).where(~held_out(F.col("__id")))
    # the sample is chosen among ids, before any text is read: the smallest hashes of each class
    chosen = None
    for label in (0, 1):
        own = marks.where(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id").dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id")
    marks = array("q")

    def texts_of():  # one partition at a time: the driver never holds the whole sample
        for text, toxic in rows.select("__text", "__toxic").toLocalIterator():
            marks.append(toxic)
            yield text

    return train(texts_of(), marks)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, score (0 to 1, higher: toxic): one per row of ``docs`` (doc_id, text; others are not read).

    Null, empty and blank texts have the score of a text without words.
    """
    score_of = scorer(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(F.col("text")).alias("score"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
