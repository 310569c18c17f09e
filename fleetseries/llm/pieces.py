"""The vocabulary of a SentencePiece model file, and splitting of texts into pre-tokens.

The model file is a parameter. It must exist at that path on every executor
(it is installed there, or was shipped with ``SparkContext.addFile``); it is
read once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = "▁"
_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def is_bpe(model: bytes) -> bool:
    """Whether a serialised model says so: field 3 (model_type, 1 unigram, 2 BPE) of its field 2 (trainer_spec)."""
    spec = b"".join(v for k, v in _fields(model) if k == 2)
    return [1, *(v for k, v in _fields(spec) if k == 3)][-1] == 2


class Vocabulary:
    """Ordinary pieces with their ids and scores, byte pieces, and the id of every known character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.size = len(ids)
        self.names = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        self.pieces = {self.names[i]: i for i in ids if not special[i]}
        #: Scores are ranks of merges, to be applied in order, and no logarithms of probabilities.
        self.bpe = is_bpe(model.serialized_model_proto())
        self.score = np.array([model.get_score(i) for i in ids], dtype=np.float64)
        self.byte_id = np.full(256, model.unk_id(), dtype=np.int32)
        for i in ids:
            if model.is_byte(i):
                self.byte_id[int(self.names[i][1:-1], 16)] = i
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space mark after another character: pre-tokens can't be split there")
        if model.normalize("  A ﬁ  b ") != SPACE * 3 + f"A ﬁ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pretokens(text: str | None) -> list[str]:
    """The pre-tokens of a text: runs of space marks with what follows them.

    No piece goes on after a space mark that follows another character, so
    pre-tokens are encoded one by one. The usual one mark in front is left
    out; a pre-token that starts with a mark is given in full.
    """
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE + SPACE not in marked and marked[-1] != SPACE:
        return marked[1:].split(SPACE)
    return [t[1:] if len(t) > 1 and t[1] != SPACE else t for t in _TOKEN.findall(marked)]


def spelled(token: str) -> str:
    return token if token[0] == SPACE else SPACE + token


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the length of each text."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64), lens


def utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
