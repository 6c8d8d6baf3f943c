"""Exact removal of word windows that occur earlier in the corpus.

Every window of ``size`` words gets two Rabin-Karp hashes, made from running sums, so a document
costs a few vector operations. All window hashes are counted in Spark: a task packs the hashes of its
documents by bucket and sends one packed row per bucket, after it has settled repeats among its own
documents; a bucket then sees where each hash stands first. Places that are not first travel back
to their documents, where covered words merge into maximal intervals and are cut out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.llm.common import arrow_schema, others, partitions, pieces, planes, quoted, text_bytes, union_all, unplanes

WINDOW = 20
_NULL = -(1 << 63)  # stands for a null id, which counts as the smallest
_FLUSH = 1_000_000  # windows that a task packs at once
_WORDS = 400_000  # hashed words that a task remembers
_PACKED = "place int, kind int, data binary"
_PLACE = np.dtype([("doc", "<i8"), ("sub", "<u4"), ("start", "<u4")])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` word codes: sums of code * base^place modulo 2^64, mixed."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, _INVERSE, np.uint64))
        back = np.cumprod(np.full(n, _BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
        h = (sums[size:] - sums[:-size]) * back[: n - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sub(data: bytes) -> int:
    """Tells texts of one id apart."""
    return xxhash.xxh32_intdigest(data, 3)


def _row(place: int, kind: int, data: bytes) -> tuple:
    return place, kind, data


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8 << 20:
            yield _as_batch(held)
            held, size = [], 0
    if held:
        yield _as_batch(held)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    place, kind, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["place", "kind", "data"])


def _groups(doc: np.ndarray, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = doc.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indexes in their order) of each key."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 65536 else keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(keys[part[0]]), part


def _pack(cells: np.ndarray, hashes: np.ndarray | None) -> bytes:
    parts = [planes(np.ascontiguousarray(cells[c])) for c in ("doc", "sub", "start")]
    if hashes is not None:
        parts.append(planes(hashes)[: 7 * len(hashes)])  # the bucket stands for the highest byte
    return len(cells).to_bytes(8, "little") + b"".join(parts)


def _unpack(data: bytes, hashed: bool) -> tuple[np.ndarray, np.ndarray | None]:
    n = int.from_bytes(data[:8], "little")
    cells = np.empty(n, _PLACE)
    at = 8
    for name, width in (("doc", 8), ("sub", 4), ("start", 4)):
        cells[name] = unplanes(data[at : at + width * n], _PLACE[name].str)
        at += width * n
    return cells, unplanes(data[at:] + bytes(n), "<u8") if hashed else None


def _removals(cells: np.ndarray, groups: int) -> Iterator[tuple]:
    for group, part in _split(_groups(np.ascontiguousarray(cells["doc"]), groups)):
        yield _row(group, 1, _pack(np.sort(cells[part]), None))


def _emit(docs: list[tuple], size: int, buckets: int, groups: int) -> Iterator[tuple]:
    """Packed rows of some documents (id, sub, word codes): hashes by bucket, own repeats by group; empties ``docs``."""
    docs.sort(key=lambda d: d[:2])
    # A repeated row is the same document.
    kept = [d for i, d in enumerate(docs) if not i or d[:2] != docs[i - 1][:2]]
    docs.clear()
    lengths = np.array([len(words) - size + 1 for _, _, words in kept], np.int64)
    ends = np.cumsum(lengths)
    ids = np.empty(len(kept), _PLACE)
    ids["doc"], ids["sub"] = [d[0] for d in kept], [d[1] for d in kept]
    h = np.empty(int(ends[-1]), np.uint64)
    for i, end in enumerate(ends.tolist()):
        words, kept[i] = kept[i][2], None
        h[end - int(lengths[i]) : end] = rolling(words, size)

    def cells(at: np.ndarray) -> np.ndarray:
        """Places of the windows ``at``; for some windows at a time, since they take twice the room of the hashes."""
        own = np.searchsorted(ends, at, side="right")
        out = ids[own]
        out["start"] = at - (ends - lengths)[own]
        return out

    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.sort(order[1:][same])
    del order, same
    left = np.arange(len(h), dtype=np.uint32 if len(h) < 1 << 32 else np.int64)
    if len(again):
        yield from _removals(cells(again), groups)
        left = np.delete(left, again)
    bucket = ((h[left] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    for b, part in _split(bucket):
        part = left[part]
        yield _row(b, 0, _pack(cells(part), h[part]))


def _hash_task(size: int, buckets: int, groups: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        codes, held, count = _Hashes(), [], 0
        for batch in batches:
            for piece in pieces(batch):
                for doc, data in zip(piece.column(0).to_pylist(), text_bytes(piece.column(1))):
                    words = data.split()
                    if len(words) < size:
                        continue
                    held.append((_NULL if doc is None else doc, _sub(data), np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))))
                    count += len(words)
                    if count > _FLUSH:
                        yield from _emit(held, size, buckets, groups)
                        held, count = [], 0
        if held:
            yield from _emit(held, size, buckets, groups)

    return lambda batches: _batches(rows(batches))


def _count_task(groups: int):
    """Of each hash in the bucket, all places but the first; own repeats of tasks are passed on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cells, hashes = [], []
        for batch in batches:
            for place, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    yield _row(place, kind, data)
                else:
                    c, h = _unpack(data, True)
                    cells.append(c)
                    hashes.append(h)
        if not cells:
            return
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        order = order[twice]
        h, cell = h[order], np.concatenate(cells)[order]
        order = np.lexsort((cell["start"], cell["sub"], cell["doc"], h))
        h, cell = h[order], cell[order]
        # A row that is there twice stands at the same place in both tasks: that is one occurrence.
        start = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
        later = cell != cell[start]
        if later.any():
            yield from _removals(cell[later], groups)

    return lambda batches: _batches(rows(batches))


def _text_task(groups: int):
    """Whole rows packed by the group of their id, in compressed Arrow form; column 0 is the id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            doc = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
            for group, part in _split(_groups(doc, groups)):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.take(pa.array(part)))
                yield _row(group, 2, sink.getvalue())

    return lambda batches: _batches(rows(batches))


def cut(data: bytes, starts: np.ndarray, size: int) -> tuple[int, int, bytes | None]:
    """Words, removed words, and what is left of the text (None: nothing is removed)."""
    words = data.split()
    if not len(starts):
        return len(words), 0, None
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    gone = np.cumsum(edge)[:-1] > 0
    left = [words[i] for i in np.flatnonzero(~gone)]
    return len(words), int(gone.sum()), b" ".join(left)


def _cut_task(size: int, names: list[str], order: list[int], text_at: int):
    """All rows of one group of ids: removals and packed documents, in any order of arrival."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, texts = [], []
        for batch in batches:
            for _, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    cells.append(_unpack(data, False)[0])
                else:
                    texts.append(data)
        cell = np.concatenate(cells) if cells else np.empty(0, _PLACE)
        cell = cell[np.lexsort((cell["sub"], cell["doc"]))]
        docs, first = np.unique(cell[["doc", "sub"]], return_index=True)
        ends = np.append(first[1:], len(cell))
        spans = {(int(d), int(s)): (a, b) for (d, s), a, b in zip(docs.tolist(), first.tolist(), ends.tolist())}
        for data in texts:
            for batch in pa.ipc.open_stream(data):
                made = []
                ids = batch.column(0).to_pylist()
                for doc, text in zip(ids, text_bytes(batch.column(text_at))):
                    a, b = spans.get((_NULL if doc is None else doc, _sub(text)), (0, 0)) if spans else (0, 0)
                    n, removed, left = cut(text, cell["start"][a:b].astype(np.int64), size)
                    made.append((n, removed, b" ".join(text.split()) if left is None else left))
                n, removed, left = zip(*made) if made else ((), (), ())
                new = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in order] + new, names=names)

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` and ``n_words``, ``n_removed``, ``kept_text`` (the words left, joined by one space).

    A word is removed if a window of ``size`` words that covers it also starts earlier: in a document
    with a smaller id (null is the smallest; of one id, the texts are ordered by a hash), or before it
    in the same document. Windows are judged on the input. Rows that repeat an id and a text are one
    document and get one result each. A null text has no words. Extra columns go along; columns with
    the names of the new ones are replaced.
    """
    new = T.StructType.fromDDL("n_words long, n_removed long, kept_text string")
    rest = others(docs, new.fieldNames())
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = T.StructType([ids.schema[c] for c in rest] + new.fields)
    groups = partitions(docs)
    buckets = 2 * groups
    # Column 0 is the id in a form of its own, so that it can be found whatever the others are.
    packed = ids.select(F.col("doc_id").alias("_id"), *map(quoted, rest))
    places = (
        ids.select("doc_id", "text").mapInArrow(_hash_task(size, buckets, groups), _PACKED)
        .repartitionById(buckets, F.col("place") % buckets)
        .mapInArrow(_count_task(groups), _PACKED)
    )
    text = packed.mapInArrow(_text_task(groups), _PACKED)
    order = [packed.columns.index(c, 1) for c in rest]
    names = arrow_schema(schema).names
    return (
        union_all([places, text]).repartitionById(groups, F.col("place"))
        .mapInArrow(_cut_task(size, names, order, packed.columns.index("text", 1)), schema)
    )
