"""BPE encoding and decoding of whole texts, with tree concatenation for long text that nothing splits.

White space separates what the tokenizer encodes, so a text is the row of its chunks between ASCII
white space, and a chunk that comes again is encoded once per task. A chunk longer than ``piece``
characters is encoded as the leaves of a tree of halves, in parallel; at every join a window is
encoded again and grows until it agrees with a whole token of the left side and one of the right.
Tokens agree at the same place with the same id, so every pair of neighbours in the joined row stands
side by side in an encoding of its own, which for BPE makes the row the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from snapforge.llm.common import with_computed

PIECE = 8192
WINDOW = 64
_REMEMBERED = 300_000  # chunks that a task keeps encoded
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_PART = 4 << 20  # characters of texts that are looked up together


def load(path: str):
    """Tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _spans(encoding, shift: int) -> tuple[list[int], list[tuple[int, int]]]:
    return encoding.ids, [(a + shift, b + shift) for a, b in encoding.offsets]


def _agree(side: tuple, window: tuple, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Places (in side, in window) of one token of the same id and span within (low, high); the last or first such."""
    places = {span: i for i, span in enumerate(window[1]) if low < span[0] < span[1] < high}
    ids, spans = side
    steps = range(len(ids) - 1, -1, -1) if last else range(len(ids))
    for i in steps:
        a, b = spans[i]
        if (b <= low) if last else (a >= high):
            return None
        j = places.get((a, b))
        # Parts of one character share its span; such tokens don't tell where they stand.
        alone = spans[i - 1 : i].count((a, b)) + spans[i + 1 : i + 2].count((a, b)) == 0 if i else spans[1:2].count((a, b)) == 0
        if j is not None and window[0][j] == ids[i] and alone and window[1].count((a, b)) == 1:
            return i, j
    return None


def encode_long(tokenizer, text: str, piece: int = PIECE, window: int = WINDOW) -> list[int]:
    """Ids of a text, encoded as a tree of halves of at most ``piece`` characters.

    A join whose window has grown over both sides is the encoding of both sides at once, so the
    result is exact whatever the text.
    """
    cuts = [(0, len(text))]
    while any(b - a > piece for a, b in cuts):
        cuts = [c for a, b in cuts for c in (((a, (a + b) // 2), ((a + b) // 2, b)) if b - a > piece else ((a, b),))]
    leaves = tokenizer.encode_batch([text[a:b] for a, b in cuts], add_special_tokens=False)
    level = [(a, b, _spans(e, a)) for (a, b), e in zip(cuts, leaves)]
    while len(level) > 1:
        joined = [_join(tokenizer, text, *level[i], *level[i + 1], window) for i in range(0, len(level) - 1, 2)]
        level = joined + level[len(joined) * 2 :]
    return list(level[0][2][0])


def _join(tokenizer, text: str, a: int, m: int, left: tuple, m2: int, b: int, right: tuple, window: int) -> tuple:
    width = window
    while True:
        low, high = max(a, m - width), min(b, m + width)
        middle = _spans(tokenizer.encode(text[low:high], add_special_tokens=False), low)
        if low == a and high == b:
            return a, b, middle
        start = (0, 0) if low == a else _agree(left, middle, low, m, last=True)
        end = (len(right[0]), len(middle[0])) if high == b else _agree(right, middle, m, high, last=False)
        if start and end and start[1] <= end[1]:
            ids = left[0][: start[0]] + middle[0][start[1] : end[1]] + right[0][end[0] :]
            spans = left[1][: start[0]] + middle[1][start[1] : end[1]] + right[1][end[0] :]
            return a, b, (ids, spans)
        width *= 2


class ChunkCodec:
    """Encodes texts chunk by chunk; remembers (number of ids, ids as text, decoded text) of each chunk."""

    def __init__(self, path: str, piece: int = PIECE) -> None:
        self.tokenizer, self.piece = load(path), piece
        self.known: dict[str, tuple[int, str, str]] = {}

    def _learn(self, chunks: list[str]) -> None:
        short = [c for c in chunks if len(c) <= self.piece]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = e.ids
                self.known[chunk] = self._entry(ids)
        for chunk in chunks:
            if len(chunk) > self.piece:
                self.known[chunk] = self._entry(encode_long(self.tokenizer, chunk, self.piece))

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as decimal text, decoded text) of each text."""
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        split = [_SPACE.split(t) for t in texts]
        self._learn([c for c in dict.fromkeys(c for s in split for c in s if c) if c not in self.known])
        known, out = self.known, []
        for chunks in split:
            found = [known[c] for c in chunks if c]
            found = [f for f in found if f[0]]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(decoded)))
        return out


def _parts(texts: list[str]):
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > _PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def _text(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode_digests(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """``docs`` and ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of each whole text, without passing the ids on.

    A null text counts as empty: no ids, and an empty decoded text.
    """

    def factory():
        codec = ChunkCodec(path, piece)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def compute(column: pa.Array):
            rows = [(n, digest(ids), digest(decoded)) for part in _parts(_text(column)) for n, ids, decoded in codec.encode(part)]
            return list(zip(*rows)) if rows else [[], [], []]

        return compute

    return with_computed(docs, factory, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """``docs`` and ``ids`` (array of int) of each whole text; a null text has none."""

    def factory():
        codec = ChunkCodec(path, piece)

        def compute(column: pa.Array):
            rows = [np.array(ids.split(), np.int32) for part in _parts(_text(column)) for _, ids, _ in codec.encode(part)]
            return [pa.array(rows, pa.list_(pa.int32()))]

        return compute

    return with_computed(docs, factory, "ids array<int>")


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``encoded`` and ``decoded``, the text of the ids in ``column``; null ids give a null text."""

    def factory() -> Callable:
        tokenizer = load(path)

        def compute(ids: pa.Array):
            return [[None if x is None else tokenizer.decode(x, skip_special_tokens=False) for x in ids.to_pylist()]]

        return compute

    assert isinstance(encoded.schema[column].dataType, T.ArrayType)
    return with_computed(encoded, factory, "decoded string", source=column)
