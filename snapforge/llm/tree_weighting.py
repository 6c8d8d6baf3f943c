"""Language model scores by context-tree weighting over bytes.

The byte after a context is coded as eight binary decisions, each with a Krichevsky-Trofimov estimate
from the zeros and ones that the training texts hold for it. Contexts are the last 0 to ``DEPTH``
bytes; a node of the tree mixes its own estimate with that of the next longer context by weights
that follow from the whole subtree: P_w = (P_kt + product of the children's P_w) / 2. All contexts of
the training texts are counted in Spark; the weights are found from the longest contexts up. Every
decision is kept: those of two and more bytes stay in the partition of their context's last two bytes,
and the distinct grams of the texts are sent there and their values sent back. Only the decisions of
at most one byte of context, at most 256 * 255 of a length, are sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import fold, partitions, planes, text_bytes, unplanes
from snapforge.session import keep

DEPTH = 5
_STOP = 2  # bytes of the context that decide the partition
_FLUSH_BYTES = 1 << 20  # bytes of texts whose words are packed together
_GROUP_BYTES = 1 << 24  # bytes of texts whose grams are sent together
_GROUP_GRAMS = 1_500_000
_ROWS = 512  # rows of a batch that are unpacked at once
_WORDS = 100_000


def _grams(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all places: context bytes, last one highest, then the byte itself; before a text stand zero bytes."""
    wide = data.astype(np.uint64)
    key = wide.copy()
    for d in range(1, depth + 1):
        back = np.zeros(len(data), np.uint64)
        np.left_shift(wide[:-d], np.uint64(8 * (depth + 1 - d)), out=back[d:])
        # The first d places of a text have no byte that far back; a shorter text's lie in the next one's.
        for k in range(d):
            at = starts + k
            back[at[at < len(data)]] = 0
        key |= back
    return key


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)


def _parts(grams: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """Partition of each key, by a hash of the last ``_STOP`` bytes of its context."""
    with np.errstate(over="ignore"):
        mixed = (grams >> np.uint64(8 * (depth + 1 - _STOP))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32 if parts >> 16 else np.uint16)


def _split(part: np.ndarray) -> list[np.ndarray]:
    """Places of each part, parts ascending, places in their order."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Lists of (other columns, text) of about ``most`` bytes; the text is the last column."""
    held, size = [], 0
    pieces = (batch.slice(at, _ROWS) for batch in batches for at in range(0, batch.num_rows, _ROWS))
    for piece in pieces:
        for *other, text in zip(*(c.to_pylist() for c in piece.columns[:-1]), text_bytes(piece.column(piece.num_columns - 1))):
            if not text:
                held.append((other, text))
                continue
            held.append((other, text))
            size += len(text)
            if size > most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bits(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of sorted distinct context * 256 + byte: node is context * 256 + the 1 and the bits before."""
    nodes, zeros, ones = [], [], []
    context, byte = grams >> np.uint64(8), grams & np.uint64(255)
    for b in range(8):
        prefix = (np.uint64(1) << np.uint64(b)) | (byte >> np.uint64(8 - b))
        bit = (byte >> np.uint64(7 - b)) & np.uint64(1)
        node = (context << np.uint64(8)) | prefix
        found, at = np.unique(node, return_inverse=True)
        nodes.append(found)
        zeros.append(np.bincount(at, weights=n * (bit == 0), minlength=len(found)))
        ones.append(np.bincount(at, weights=n * (bit == 1), minlength=len(found)))
    node = np.concatenate(nodes)
    order = np.argsort(node)
    return node[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def _log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """log Gamma(n + plus) of counts n; from a table where they are small, by Stirling's series elsewhere."""
    x = np.maximum(n, _SMALL) + plus
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, _TABLES[plus][np.minimum(n, _SMALL - 1).astype(np.int64)], far)


_SMALL = 1 << 16
_TABLES = {plus: np.array([math.lgamma(i + plus) for i in range(_SMALL)]) for plus in (0.5, 1.0)}


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of the counts, in any order."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - math.log(math.pi) - _log_gamma(zeros + ones, 1.0)


def _mix(node, zeros, ones, below) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of the nodes and the weight of their own estimate; contexts of ``below`` are one byte longer."""
    alone = kt(zeros, ones)
    if below is None:
        return alone, np.ones(len(node))
    parent = ((below["node"] >> np.uint64(16)) << np.uint64(8)) | (below["node"] & np.uint64(255))
    children = np.zeros(len(node))
    np.add.at(children, np.searchsorted(node, parent), below["value"])
    value = np.logaddexp(alone, children) - math.log(2)
    return value, np.exp(alone - math.log(2) - value)


def _chance(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


class Model:
    """Per depth: sorted decisions, their chance of a one and the weight of the own estimate."""

    def __init__(self, depth: int) -> None:
        self.depth, self.tables = depth, {}

    def add(self, depth: int, node, chance, own) -> None:
        self.tables[depth] = node, chance, own

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each key."""
        total = np.zeros(len(gram))
        byte = gram & np.uint64(255)
        for b in range(8):
            prefix = (np.uint64(1) << np.uint64(b)) | (byte >> np.uint64(8 - b))
            chance, seen = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
            for d in sorted(self.tables, reverse=True):
                nodes, ones, own = self.tables[d]
                if not len(nodes):
                    continue
                context = gram >> np.uint64(8 * (self.depth + 1 - d))
                node = (context << np.uint64(8)) | prefix
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                # A context without counts leaves the decision to the shorter one alone.
                here, ones, own = nodes[at] == node, ones[at], own[at]
                chance = np.where(here, np.where(seen, own * ones + (1 - own) * chance, ones), chance)
                seen |= here
            bit = (byte >> np.uint64(7 - b)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, chance, 1 - chance))
        return total


def _weigh(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[Model, tuple[np.ndarray, ...]]:
    """Decisions of contexts of ``depth`` down to ``_STOP`` bytes, and (node, zeros, ones, log P_w) of the last.

    The keys are distinct and sorted and hold all rows of their ``_STOP``-byte contexts.
    """
    model, below = Model(depth), None
    for d in range(depth, _STOP - 1, -1):
        key = ((gram >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | (gram & np.uint64(255))
        found, at = np.unique(key, return_inverse=True)
        node, zeros, ones = _bits(found, np.bincount(at, weights=n))
        value, own = _mix(node, zeros, ones, below)
        model.add(d, node, _chance(zeros, ones), own)
        below = {"node": node, "value": value}
    return model, (node, zeros, ones, value)


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(part, group, number of keys) of each row, the distinct keys, their counts, and the place of each row's keys."""
    rows, keys, counts = [], [], []
    for batch in batches:
        for part, _, group, data in zip(*(c.to_pylist() for c in batch.columns)):
            steps, n = _unblob(zstandard.decompress(data))
            rows.append((part, group, len(steps)))
            keys.append(np.cumsum(steps.astype(np.uint64), dtype=np.uint64))
            counts.append(n)
    if not rows:
        return rows, *(np.zeros(0, np.uint64) for _ in range(3))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return rows, found, np.bincount(at, weights=np.concatenate(counts)), at


def _sum_task(depth: int):
    """The decisions of one byte of context, with the sum of their children's log P_w, of the keys of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, gram, n, _ = _received(batches)
        gram, n = gram[n > 0], n[n > 0]
        if len(gram):
            _, (node, *sums) = _weigh(gram, n, depth)
            up, at = np.unique(((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)), return_inverse=True)
            columns = [pa.array(up.astype(np.int64)), *(pa.array(np.bincount(at, weights=x)) for x in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "zeros", "ones", "value"])

    return run


def _value_task(shipped, groups: int):
    """Values of the keys of a partition, told to every group of texts that has them (kind 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, gram, n, at = _received(batches)
        if not rows:
            return
        short = shipped.value
        model = _weigh(gram[n > 0], n[n > 0], short.depth)[0] if (n > 0).any() else Model(short.depth)
        model.tables |= short.tables
        values = np.concatenate([model.log10(gram[i : i + (1 << 16)]) for i in range(0, len(gram), 1 << 16)]).astype("<f4")
        end = 0
        for part, group, size in rows:
            yield _packed([(_place(group, groups), 4, group, part.to_bytes(4, "little") + _blob(values[at[end : end + size]]))])
            end += size

    return run


def _shorter(sent: DataFrame, depth: int) -> Model:
    """Decisions of contexts of one and no byte; what comes to the driver is at most 256 * 255 rows."""
    model = Model(depth)
    sums = sent.mapInArrow(_sum_task(depth), "node long, zeros double, ones double, value double")
    rows = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "value"))).toArrow()
    if not rows.num_rows:
        return model
    node, zeros, ones, children = (c.to_numpy() for c in rows.columns)
    order = np.argsort(node)
    node, zeros, ones, children = node[order].astype(np.uint64), zeros[order], ones[order], children[order]
    for d in (1, 0):
        alone = kt(zeros, ones)
        value = np.logaddexp(alone, children) - math.log(2)
        model.add(d, node, _chance(zeros, ones), np.exp(alone - math.log(2) - value))
        up = ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255))
        node, back = np.unique(up, return_inverse=True)
        zeros, ones, children = (np.bincount(back, weights=x) for x in (zeros, ones, value))
    return model


_PACKED = "place int, kind int, flush long, data binary"
_END = b" "  # no word: stands for the end of a text


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 23)
        return value


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    place, kind, flush, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int32()), pa.array(kind, pa.int32()), pa.array(flush, pa.int64()), pa.array(data, pa.binary())],
        names=["place", "kind", "flush", "data"],
    )


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each behind its length and type."""
    return b"".join(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + planes(a) for a in map(np.ascontiguousarray, arrays))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in the smallest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _unblob(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 8], "little"), data[at + 8 : at + 12].decode().strip()
        size = n * np.dtype(kind).itemsize
        out.append(unplanes(data[at + 12 : at + 12 + size], kind))
        at += 12 + size
    return out


def _group(flush: int) -> int:
    return flush >> 16


def _place(group: int, groups: int) -> int:
    """Partition in which the texts of a group are finished."""
    return ((group >> 24) + 7919 * (group & 0xFFFFFF)) % groups


def _words(codes: _Codes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, the distinct words, and the place in these of each token."""
    words = [data.lower().split() + [_END] for data in texts]
    lengths = np.array([len(w) for w in words])
    flat = np.fromiter((codes[w] for ws in words for w in ws), np.uint64, int(lengths.sum()))
    return lengths, *np.unique(flat, return_inverse=True)


def _send_task(depth: int, buckets: int, parts: int, groups: int):
    """Per batch of texts: their words' counts by bucket (kind 0), and the texts (kind 1).

    Per group of batches: their distinct grams with the counts of the training texts, by part (kind 3).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, squeeze, quick = _Codes(), zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=1)
        group, number, size, held = TaskContext.get().partitionId() << 24, 0, 0, []

        def grams() -> Iterator[pa.RecordBatch]:
            keys, counts = _merge(held)
            part = _parts(keys, depth, parts)
            for rows in _split(part):
                steps = np.diff(keys[rows], prepend=np.uint64(0))
                yield _packed([(int(part[rows[0]]), 3, group, quick.compress(_blob(steps.astype("<u8"), _narrow(counts[rows]))))])

        for portion in _portions(batches, _FLUSH_BYTES):
            flush, texts = group << 16 | number, [data for _, data in portion]
            ids, tests = zip(*(o for o, _ in portion))
            lengths, known, word = _words(codes, texts)
            teaches = ~np.repeat(np.array(tests), lengths)
            counts = np.bincount(word[teaches], minlength=len(known))
            own = _blob(
                np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "|u1"), np.array(tests, "|u1"),
                np.array([len(t) for t in texts], "<i8"), np.frombuffer(b"".join(texts), np.uint8),
            )
            yield _packed([(_place(group, groups), 1, flush, squeeze.compress(own))])
            bucket = ((known >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            yield _packed([(b, 0, flush, _blob(known[i:j].astype("<u8"), _narrow(counts[i:j]))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i])
            for test in (False, True):
                some = [t for t, x in zip(texts, tests) if x == test and t]
                if some:
                    keys, n = np.unique(_grams(*_flat(some), depth), return_counts=True)
                    held.append((keys, n * (not test)))
            number, size = number + 1, size + sum(map(len, texts))
            if sum(len(k) for k, _ in held) > 2 * _GROUP_GRAMS:
                held = [_merge(held)]
            if size > _GROUP_BYTES or held and len(held[0][0]) > _GROUP_GRAMS:
                if held:
                    yield from grams()
                group, number, size, held = group + 1, 0, 0, []
        if held:
            yield from grams()

    return run


def _text_scores(texts: list[bytes], keys: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the values of each text's grams; ``keys`` are sorted and hold them all."""
    out, some = np.zeros(len(texts)), np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(some):
        return out
    flat, starts = _flat([texts[i] for i in some])
    grams, doc = _grams(flat, starts, depth), np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(flat))))
    if depth <= 5 and len(some) <= 1 << 16:  # one quick sort of numbers
        both = np.sort(grams << np.uint64(16) | doc.astype(np.uint64))
        grams, doc = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
    else:
        order = np.argsort(grams, kind="stable")
        grams, doc = grams[order], doc[order]
    first = np.append(True, grams[1:] != grams[:-1])
    found = values[np.searchsorted(keys, grams[first])].astype(np.float64)
    out[some] = np.bincount(doc, weights=found[np.cumsum(first) - 1], minlength=len(some))
    return out


def _total_task(groups: int):
    """Total of each word of the bucket, told to every batch of texts that has it (kind 2).

    The bucket's sums come as kind 3: distinct words as ``place``, tokens as ``flush``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(place, flush, *_unblob(data)) for batch in batches for place, _, flush, data in zip(*(c.to_pylist() for c in batch.columns))]
        if not rows:
            return
        words, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([r[3] for r in rows]), minlength=len(words)).astype("<u8")
        yield _packed([(int((total > 0).sum()), 3, int(total.sum()), b"")])
        end = 0
        for place, flush, own, _ in rows:
            yield _packed([(_place(_group(flush), groups), 2, flush, place.to_bytes(4, "little") + _blob(_narrow(total[at[end : end + len(own)]])))])
            end += len(own)

    return run


def _finish_task(all_words: int, distinct: int, depth: int, parts: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    unit = math.log10(all_words + 0.5 * (distinct + 1))

    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        ids, empty, held, sizes, flat = _unblob(zstandard.decompress(data))
        ends, flat = np.cumsum(sizes).tolist(), flat.tobytes()
        return ids, empty.astype(bool), held.astype(bool), [flat[i:j] for i, j in zip([0, *ends], ends)]

    def joined(rows: list[tuple[int, bytes]]) -> np.ndarray:
        return np.concatenate([_unblob(d)[0] for _, d in sorted(rows)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        texts: dict[int, list[tuple[int, bytes]]] = {}
        told: dict[int, dict[int, list[tuple[int, bytes]]]] = {2: {}, 4: {}}
        for batch in batches:
            for _, kind, flush, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    texts.setdefault(_group(flush), []).append((flush, data))
                else:
                    told[kind].setdefault(flush, []).append((int.from_bytes(data[:4], "little"), data[4:]))
        for group, portions in texts.items():
            held = []
            for _, data in portions:
                some = [t for t in unpacked(data)[3] if t]
                if some:
                    held.append(np.unique(_grams(*_flat(some), depth)))
            # The same keys in the same order as they were sent.
            keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            values = np.empty(len(keys), np.float32)
            if held:
                values[np.argsort(_parts(keys, depth, parts), kind="stable")] = joined(told[4].pop(group))
            for flush, data in portions:
                ids, empty, tests, own = unpacked(data)
                lengths, _, word = _words(codes, own)
                c = joined(told[2].pop(flush)).astype(np.float64)[word]
                doc = np.repeat(np.arange(len(ids)), lengths)
                base = np.bincount(doc, weights=np.log10(c + 0.5), minlength=len(ids)) - lengths * unit
                known = np.bincount(doc, weights=c > 0, minlength=len(ids)).astype(np.int64)
                columns = [
                    pa.array(ids, mask=empty), pa.array(tests), pa.array(lengths.astype(np.int64)), pa.array(known),
                    pa.array(np.full(len(ids), all_words, np.int64)), pa.array(base), pa.array(_text_scores(own, keys, values, depth)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score_texts(docs: DataFrame, depth: int = DEPTH, parts: int = 5, part: int = 1) -> DataFrame:
    """Scores of each whole text, learned from the documents whose crc32(doc_id) modulo ``parts`` is not ``part``.

    Columns doc_id, held_out, n_tokens (words and one end), n_known (tokens with a count), train_tokens,
    base_score (smoothed single tokens) and score (context-tree weighting), both log10. A null text is
    empty and scores 0 bytes; a null id teaches. Without training tokens the base falls to its smoothing,
    and every decision of the tree is even. Rows that repeat an id are rows of their own. ``depth`` is
    from 2 to 7.
    """
    if not _STOP <= depth <= 7:
        raise ValueError(f"depth {depth}: a key holds 2 to 7 bytes of context")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), parts, part).alias("held"), "text")
    groups = partitions(docs)
    sent = keep(rows.mapInArrow(_send_task(depth, groups, groups, groups), _PACKED), "sent")
    grams = sent.filter("kind = 3").repartitionById(groups, F.col("place"))
    # Contexts of at most one byte.
    shipped = docs.sparkSession.sparkContext.broadcast(_shorter(grams, depth))
    totals = keep(sent.filter("kind = 0").repartitionById(groups, F.col("place")).mapInArrow(_total_task(groups), _PACKED), "totals")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("flush", "place")]
    words, distinct = totals.filter("kind = 3").agg(*sums).head()  # without the packed column
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = sent.filter("kind = 1").union(totals.filter("kind = 2")).union(grams.mapInArrow(_value_task(shipped, groups), _PACKED))
    finished = told.repartitionById(groups, F.col("place"))
    return finished.mapInArrow(_finish_task(words, distinct, depth, groups), schema)
