"""SentencePiece encoding by rank-ordered merges (BPE) or batched Viterbi (unigram), and decoding.

The scores of a BPE model are the ranks of its merges, so its pre-tokens are
merged in that order as ``token_count`` does, which gives the library's ids.

For a unigram model each pre-token gets the segmentation with the highest sum
of piece scores (of equal sums the one whose last piece is longest, then
likewise in front of it). The distinct pre-tokens of a batch that have the same
length stand in one matrix and advance together: hashes of all substrings up to
the longest piece probe the sorted hashes of the pieces, and at each end
position a vectorised maximum over the piece lengths stores the back-pointers.
A character that no piece covers costs more than any piece.

Either way such a character becomes the byte pieces of its UTF-8 form.

Decoding gathers the bytes of the pieces with ragged array indexing.

Both work on texts where they lie: no shuffle, and a task holds one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, small_batches, table, text_batches
from .pieces import SPACE, code_points, pretokens, utf8_length, vocabulary
from .queries import query
from .token_count import MergeTable, merge_table, merged, shorten

#: Cells (pre-tokens x length) of one Viterbi matrix.
CELLS = 200_000
#: Pre-tokens, and their characters, whose ids a task remembers before it starts afresh.
CACHE = 200_000
CACHE_CHARS = 4_000_000
#: Ids that are decoded at once (a longer text is decoded whole).
DECODED_IDS = 1 << 17
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LEAD = np.uint64(44)


class PieceTable:
    """Pieces by the hash of their code points, sorted; scores; bytes of every id."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        names = list(vocab.pieces)
        ids = np.array([vocab.pieces[p] for p in names], dtype=np.int64)
        self.longest = max(map(len, names))
        self.power = np.multiply.accumulate(np.full(self.longest + 1, _MULT, dtype=np.uint64))
        self.byte_id = vocab.byte_id.astype(np.int64)
        hashes = np.zeros(len(names), dtype=np.uint64)
        lens = np.array([len(p) for p in names])
        for n in np.unique(lens):
            at = np.flatnonzero(lens == n)
            codes, _ = code_points([names[k] for k in at])
            hashes[at] = self.substrings(codes.reshape(len(at), n))[n - 1][:, 0]
        order = np.argsort(hashes)
        self.hash, self.id = hashes[order], ids[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two pieces share a hash")
        # where the sorted hashes with the same leading bits begin; the largest number of them
        lead = (self.hash >> _LEAD).astype(np.int64)
        self.begin = np.searchsorted(lead, np.arange((1 << int(64 - _LEAD)) + 1))
        self.crowd = int(np.diff(self.begin).max())
        #: The longest piece of space marks alone.
        self.marks = max((len(p), i) for p, i in vocab.pieces.items() if set(p) == {SPACE})[1] if SPACE in vocab.pieces else -1
        score = vocab.score
        self.score = np.append(score, -np.inf)
        self.unknown = score[ids].min() - 10
        spelled = [p.replace(SPACE, " ").encode() if p in vocab.pieces else b"" for p in vocab.names]
        for b, i in enumerate(vocab.byte_id.tolist()):
            spelled[i] = bytes([b])
        self.spell_len = np.array([len(b) for b in spelled], dtype=np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length 1.. the hashes of the substrings that start at each column."""
        width = codes.shape[1]
        letters = mix(codes.astype(np.uint64) + np.uint64(1))
        out, h = [], np.zeros_like(letters)
        for n in range(1, min(self.longest, width) + 1):
            h = h[:, : width - n + 1] * _MULT + letters[:, n - 1 :]
            out.append(mix(h + np.uint64(n)))
        return out

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, or -1."""
        at = self.begin[(hashes >> _LEAD).astype(np.int64)]
        last = len(self.hash) - 1
        out = np.full(hashes.shape, -1, dtype=np.int64)
        for k in range(self.crowd):
            here = np.minimum(at + k, last)
            np.copyto(out, self.id[here], where=self.hash[here] == hashes)
        return out


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def viterbi(codes: np.ndarray, pieces: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows of a matrix of code points one after another, and their number in each row."""
    rows, width = codes.shape
    found = [pieces.probe(h) for h in pieces.substrings(codes)]  # by length - 1: [row, start]
    score = [pieces.score[f] for f in found]
    score[0] = np.where(found[0] < 0, pieces.unknown, score[0])
    useful = [n for n in range(len(found), 0, -1) if n == 1 or (found[n - 1] >= 0).any()]
    best = np.full((width + 1, rows), -np.inf)
    best[0] = 0
    back = np.zeros((width + 1, rows), dtype=np.int64)
    for end in range(1, width + 1):
        for n in useful:  # longest first: of equal sums it stays
            if n <= end:
                total = score[n - 1][:, end - n] + best[end - n]
                better = total > best[end]
                np.copyto(best[end], total, where=better)
                np.copyto(back[end], n, where=better)
    picked = np.full((rows, width), -2, dtype=np.int64)
    live, end = np.arange(rows), np.full(rows, width)
    while live.size:
        n = back[end, live]
        end = end - n
        for k in np.unique(n):
            of = n == k
            picked[live[of], end[of]] = found[k - 1][live[of], end[of]]
        live, end = live[end > 0], end[end > 0]
    if not (picked == -1).any():
        used = picked >= 0
        return picked[used].astype(np.int32), used.sum(axis=1)
    flat, size = spell_out(picked.ravel(), codes.ravel(), pieces)
    return flat, size.reshape(rows, width).sum(axis=1)


def spell_out(picked: np.ndarray, codes: np.ndarray, pieces: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the byte pieces of the code point in place of each -1 (-2 gives none), and the number of ids of each."""
    size = np.where(picked >= 0, 1, np.where(picked == -1, utf8_length(codes), 0))
    flat = np.repeat(picked, size)
    spelled = "".join(map(chr, codes[picked == -1].tolist())).encode("utf-8", "surrogatepass")
    flat[flat == -1] = pieces.byte_id[np.frombuffer(spelled, dtype=np.uint8)]
    return flat.astype(np.int32), size


def merge(tokens: list[str], pieces: PieceTable, merges: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all pre-tokens one after another, and their number in each, by the merges of a BPE model."""
    words, whole = shorten(tokens, merges.run)
    seq, sym, codes = (np.concatenate(x) for x in zip(*merged(words, merges)))
    order = np.argsort(seq, kind="stable")
    flat, size = spell_out(sym[order], codes[order], pieces)
    sizes = np.zeros(len(words), dtype=np.int64)
    np.add.at(sizes, seq[order], size)
    if whole.any():
        flat = np.insert(flat, np.repeat(np.cumsum(sizes) - sizes, whole), pieces.marks)
    return flat, sizes + whole


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each slice, one slice after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lens, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lens[order])) + 1):
        width = int(lens[group[0]])
        step = max(1, CELLS // width)
        for a in range(0, len(group), step):
            at = group[a : a + step].tolist()
            codes, _ = code_points([words[k] for k in at])
            yield at, codes.reshape(len(at), width)


class Known:
    """Ids of the pre-tokens that a worker has encoded: slices of one flat array."""

    def __init__(self, path: str, merges: MergeTable | None = None):
        self.pieces, self.merges = piece_table(path), merges
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.flat = np.empty(1 << 16, dtype=np.int32)  # with room at the end, doubled when it is used up
        self.used = 0
        self.start = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)

    def room_for(self, tokens: list[str]) -> bool:
        return len(self.at) + len(tokens) <= CACHE and self.chars + sum(map(len, tokens)) <= CACHE_CHARS

    def add(self, tokens: list[str]) -> None:
        if self.merges is not None:
            self._append(tokens, *merge(tokens, self.pieces, self.merges))
            return
        flat, sizes, order = [], [], []
        for at, codes in _by_length([t if t[0] == SPACE else SPACE + t for t in tokens]):
            ids, size = viterbi(codes, self.pieces)
            flat.append(ids)
            sizes.append(size)
            order += at
        self._append([tokens[k] for k in order], np.concatenate(flat), np.concatenate(sizes))

    def _append(self, tokens: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        if self.used + len(flat) > len(self.flat):
            larger = np.empty(2 * (self.used + len(flat)), dtype=np.int32)
            larger[: self.used] = self.flat[: self.used]
            self.flat = larger
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        first = len(self.at)
        self.at.update((t, first + j) for j, t in enumerate(tokens))
        self.chars += sum(map(len, tokens))


def known_by(path: str) -> Known:
    """An empty cache for the method of the model's type."""
    return Known(path, merge_table(path) if vocabulary(path).bpe else None)


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each, by the highest sum of scores whatever the model's type."""
    return encoded_ids(texts, Known(path))


def encoded_ids(texts: list[str | None], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text; ``known`` keeps those of the pre-tokens."""
    split = [pretokens(t) for t in texts]
    wanted = set().union(*split) if split else set()
    new = list(wanted - known.at.keys())
    if not known.room_for(new):
        known.clear()
        new = list(wanted)
    if new:
        known.add(new)
    row = np.fromiter(map(known.at.__getitem__, chain.from_iterable(split)), dtype=np.int64)
    size = known.size[row]
    ids = known.flat[ragged(known.start[row], size)]
    total = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum([len(tokens) for tokens in split])]).astype(np.int64)
    return ids, np.diff(total[first])


def decode_ids(ids: np.ndarray, first: np.ndarray, path: str) -> list[str]:
    """Texts of consecutive lists of ids; list k is ``ids[first[k]:first[k + 1]]``."""
    pieces = piece_table(path)
    size = pieces.spell_len[ids]
    data = pieces.spell[ragged(pieces.spell_at[ids], size)].tobytes()
    edge = np.concatenate([[0], np.cumsum(size)])[first].tolist()
    out = []
    for a, b in zip(edge, edge[1:]):
        text = data[a:b].decode("utf-8", "replace")
        out.append(text[1:] if text[:1] == " " else text)
    return out


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_by(path)  # of this task: a worker that goes on to another stage keeps nothing
        for part in text_batches(batches, "text", 2 << 20):
            ids, sizes = encoded_ids(part.column("text").to_pylist(), known)
            first = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            data, edge = ids.astype("<i4").tobytes(), (first * 4).tolist()
            digest = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").combine_chunks(),
                    part.column("text").combine_chunks(),
                    lists,
                    pa.array(sizes),
                    pa.array(digest),
                ],
                names=["doc_id", "text", "token_ids", "n_tokens", "ids_sha256"],
            )

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            sizes = np.array([len(x) if x is not None else 0 for x in lists], dtype=np.int64)
            for a, b in _decoded_rows(sizes):
                part = batch.slice(a, b - a)
                ids = part.column("token_ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode_ids(ids, np.concatenate([[0], np.cumsum(sizes[a:b])]), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in part.schema.names] + [pa.array(texts)],
                    names=[*part.schema.names, "decoded"],
                )

    return run


def _decoded_rows(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of rows with about ``DECODED_IDS`` ids each: decoding needs several bytes of index a byte of text."""
    cut = np.cumsum(sizes) // DECODED_IDS
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


_TRIP = "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _round_tripper(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encoder(path)(batches):
            sizes = batch.column("n_tokens").to_numpy()
            ids = batch.column("token_ids").flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])
            digests, same = [], []
            for a, b in _decoded_rows(sizes):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                for text, back in zip(texts, decode_ids(ids[first[a] : first[b]].astype(np.int64), first[a : b + 1] - first[a], path)):
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == text.replace(SPACE, " "))
            kept = [batch.column(c) for c in ("doc_id", "n_tokens", "token_ids", "ids_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                                             names=["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` and ``decode`` in one step, so that a task has one Python worker and the texts come back as digests.

    Rows doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256 (of the decoded text), round_trip (it equals the
    text, the space mark itself read as a space); null and repeated rows as in ``encode``.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(_round_tripper(path), _TRIP)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows doc_id, text, token_ids, n_tokens, ids_sha256: one per row of ``docs``.

    Only doc_id and text are read. Null and empty text have no tokens (the text
    column shows null as empty); a null doc_id stays; repeated rows give a row
    each. ids_sha256 is over the ids as little-endian 32-bit integers.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(
        _encoder(path), "doc_id long, text string, token_ids array<int>, n_tokens long, ids_sha256 string"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ``token_ids`` (none: empty).

    Exact for any text but that U+2581, the space mark itself, comes back as a space.
    """
    small_batches(encoded.sparkSession)
    schema = encoded.drop("decoded")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return schema.mapInArrow(_decoder(path), f"{columns}, decoded string")


@query("op9_piece_codec")
def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return round_trip(table(spark, sf_dir, "documents"), path).drop("token_ids")
