"""Benchmark passages in training documents, by suffix arrays of shards of the documents.

A task takes its documents in shards of about ``SHARD`` words and sorts the suffixes of a shard by their
words: first by packed words, then by doubling, in which only suffixes that are still alike are sorted again.
Every suffix of the benchmark is binary-searched in the array of each shard, which gives its longest verbatim
match and where that stands, and for each window of an item the range of places at which it occurs.

The benchmark is the query set. It goes to the tasks in blocks of at most ``BLOCK_BYTES``, each a broadcast of its
own that a task loads when it needs it; a larger benchmark is more blocks, and all of them meet every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import quoted, text_bytes, with_computed

WINDOW = 10
SHARD = 1 << 20
BLOCK_BYTES = 4 << 20
# Lower-cases A-Z; all bytes that are not part of a word become blanks.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_NEW = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_LONGEST = "item_id string, start long, length long, doc_id long, doc_start long"


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text, lower-cased in A-Z; letters, digits and all that is not ASCII make words."""
    return data.translate(_WORDS).split()


class SuffixArray:
    """Places of ``codes`` in the order of their suffixes, each read up to its first zero or to ``depth`` codes.

    Codes are at least 1; a zero ends a suffix and has none of its own.
    """

    def __init__(self, codes: np.ndarray, depth: int, bits: int) -> None:
        self.bits, self.width = bits, max(1, 63 // bits)
        self.packed = self.pack(codes, bits, self.width)
        order = np.flatnonzero(codes)
        order = order[np.argsort(self.packed[order], kind="stable")]
        keys = self.packed[order]
        # rank: group of equal suffixes so far, from 1; a place without a suffix has 0.
        group = np.cumsum(np.concatenate([[1], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        reach = self.width
        # Codes up to the next zero.
        ends = np.where(codes == 0, np.arange(len(codes)), len(codes))
        left = np.minimum.accumulate(ends[::-1])[::-1][order] - order
        rank = np.zeros(len(codes) + 1, np.int64)
        rank[order] = group
        while reach < depth and len(order):
            same = np.concatenate([[False], group[1:] == group[:-1], [False]])
            # A suffix that has ended within the reach is settled; equal ones stay in the order of their places.
            tied = np.flatnonzero((same[1:] | same[:-1]) & (left > reach))
            if not len(tied):
                break
            places = order[tied]
            # Groups stay apart, since the rank so far is the upper half of the key.
            key = group[tied] << 32 | rank[np.minimum(places + reach, len(codes))]
            again = np.argsort(key, kind="stable")
            order[tied], left[tied], key = places[again], left[tied[again]], key[again]
            first = np.ones(len(order), bool)
            first[1:] = group[1:] != group[:-1]
            first[tied[1:]] |= key[1:] != key[:-1]
            group = np.cumsum(first)
            rank[order] = group
            reach *= 2
        self.order = order

    @staticmethod
    def pack(codes: np.ndarray, bits: int, width: int) -> np.ndarray:
        """The next ``width`` codes of every place in one number; nothing counts behind a zero."""
        padded = np.concatenate([codes.astype(np.int64), np.zeros(width, np.int64)])
        out, alive = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
        for j in range(width):
            now = padded[j : j + len(codes)]
            alive &= now > 0
            out = out << bits | np.where(alive, now, 0)
        return out

    def _compare(self, at: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sign of suffix ``at`` against the first ``length`` codes of the packed ``text`` from ``start``."""
        sign = np.zeros(len(at), np.int8)
        live = np.arange(len(at))
        done = 0
        while len(live):
            left = length[live] - done
            cut = np.where(left < self.width, (self.width - left) * self.bits, 0)
            p = np.minimum(at[live] + done, len(self.packed) - 1)
            mine = np.where(at[live] + done < len(self.packed), self.packed[p], 0) >> cut
            other = text[np.minimum(start[live] + done, len(text) - 1)] >> cut
            sign[live] = np.sign(mine - other)
            done += self.width
            live = live[(mine == other) & (length[live] > done)]
        return sign

    def bound(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """Where the piece would be inserted among the suffixes, before or ``after`` those that begin with it."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            sign = self._compare(self.order[mid], text, start[open_], length[open_])
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low


class Benchmark:
    """One block of items: codes of their words, their suffixes, and the distinct windows."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        codes, self.item, self.place = [], [], []
        starts, lengths = [], []
        classes: dict[tuple, int] = {}
        self.items: list[set[str]] = []
        self.names = [name for name, _ in items]
        for n, (name, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
            length = min(size, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                window = tuple(words[i : i + length])
                if window not in classes:
                    classes[window] = len(classes)
                    starts.append(len(codes) + i)
                    lengths.append(length)
                    self.items.append(set())
                if name is not None:
                    self.items[classes[window]].add(name)
            codes += [*words, 0]
            self.item += [n] * (len(words) + 1)
            self.place += range(len(words) + 1)
        self.codes = np.array(codes or [0], np.int64)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.width = max(1, 63 // self.bits)
        self.packed = SuffixArray.pack(self.codes, self.bits, self.width)
        self.starts, self.lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.suffixes = np.flatnonzero(self.codes)
        ends = np.flatnonzero(self.codes == 0)
        self.left = ends[np.searchsorted(ends, self.suffixes)] - self.suffixes if len(ends) else self.suffixes
        self.depth = int(self.left.max()) if len(self.left) else 0

    def windows_in(self, array: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and window classes of all occurrences in a shard."""
        low = array.bound(self.packed, self.starts, self.lengths, False)
        n = array.bound(self.packed, self.starts, self.lengths, True) - low
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return array.order[np.repeat(low, n) + within], np.repeat(self.lengths, n), np.repeat(np.arange(len(n)), n)

    def longest_in(self, array: SuffixArray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per benchmark suffix, place and length of its longest match in a shard, the first such place (length 0: none)."""
        low = array.bound(self.packed, self.suffixes, self.left, False)
        best, at = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for side in (low - 1, low):  # the longest match is a neighbour of the place of insertion
            inside = (side >= 0) & (side < len(array.order))
            places = array.order[np.clip(side, 0, len(array.order) - 1)] if len(array.order) else at
            best = np.maximum(best, self._common(codes, places, inside))
        some = np.flatnonzero(best)
        low = array.bound(self.packed, self.suffixes[some], best[some], False)
        high = array.bound(self.packed, self.suffixes[some], best[some], True)
        at[some] = [array.order[a:b].min() for a, b in zip(low.tolist(), high.tolist())]
        return at, best

    def _common(self, codes: np.ndarray, places: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Words that the suffix at each place has in common with the benchmark suffix."""
        out, alive, k = np.zeros(len(places), np.int64), np.flatnonzero(live), 0
        while len(alive):
            alive = alive[(places[alive] + k < len(codes)) & (self.left[alive] > k)]
            alive = alive[codes[places[alive] + k] == self.codes[self.suffixes[alive] + k]]
            out[alive] += 1
            k += 1
        return out


def _shards(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    held, size, first = [], 0, 0
    for n, data in enumerate(texts):
        held.append(words_of(data))
        size += len(held[-1])
        if size > SHARD:
            yield first, held
            held, size, first = [], 0, n + 1
    if held:
        yield first, held


def _coded(docs: list[list[bytes]], block: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """First place of every document, and all codes; one zero stands behind each, so no match crosses it."""
    lengths = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    codes = np.zeros(int(lengths.sum()) + len(docs), np.int64)
    for s, d in zip(starts.tolist(), docs):
        codes[s : s + len(d)] = np.fromiter(map(block.vocabulary.get, d, repeat(0)), np.int64, len(d))
    return starts, codes


def _match(docs: list[list[bytes]], blocks) -> tuple[list[set], list[list]]:
    """Ids of the items, and intervals [start, end), that each document of a shard has with all blocks."""
    items: list[set[str]] = [set() for _ in docs]
    edges: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in docs]
    for block in blocks:
        starts, codes = _coded(docs, block)
        places, length, window = block.windows_in(SuffixArray(codes, block.depth, block.bits))
        owner = np.searchsorted(starts, places, side="right") - 1
        order = np.argsort(owner, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            if len(part):
                n = owner[part[0]]
                begin = places[part] - starts[n]
                edges[n].append((begin, begin + length[part]))
                items[n].update(*(block.items[w] for w in np.unique(window[part]).tolist()))
    return items, edges


def spans_of(edges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Maximal intervals that the given ones (start, end) cover together."""
    if not edges:
        return []
    start = np.concatenate([e[0] for e in edges])
    end = np.concatenate([e[1] for e in edges])
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return list(zip(start[np.concatenate([[0], cut])].tolist(), reach[np.concatenate([cut - 1, [len(start) - 1]])].tolist()))


def _blocks(benchmark: DataFrame, size: int) -> list:
    """Broadcasts of the items, each of at most ``BLOCK_BYTES`` of text or of one longer item."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null").distinct().orderBy("item_id", "text")
    held, bytes_, out = [], 0, []
    for name, text in rows.toLocalIterator():
        if held and bytes_ + len(text) > BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(Benchmark(held, size)))
            held, bytes_ = [], 0
        held.append((name, text))
        bytes_ += len(text)
    if held:
        out.append(spark.sparkContext.broadcast(Benchmark(held, size)))
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (with ``text``) and what they share word by word with ``benchmark`` (item_id, text).

    New columns: ``n_words``; ``n_hit``, the words inside an occurrence of a window (``size`` consecutive words of
    an item, or all words of a shorter one); ``items``, the ids of items with such windows, sorted as strings; and
    ``spans``, the hit words as maximal intervals [start, end) of word positions from 0.

    A null or empty text has no words; neither has such an item. Rows that repeat are rows of their own in ``docs``
    and one item in the benchmark; an item without an id gives hits but is not listed. Columns of ``docs`` with
    the names of new ones are replaced, all others go along. An empty benchmark gives no hits, an empty table no rows.
    """
    blocks = _blocks(benchmark, size)

    def factory():
        def compute(column: pa.Array) -> list:
            made: list[tuple] = []
            for _, words in _shards(text_bytes(column)):
                for w, items, edges in zip(words, *_match(words, (b.value for b in blocks))):
                    spans = spans_of(edges)
                    made.append((len(w), sum(b - a for a, b in spans), sorted(items), [{"start": a, "end": b} for a, b in spans]))
            return [list(c) for c in zip(*made)] if made else [[] for _ in range(4)]

        return compute

    return with_computed(docs, factory, _NEW)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The longest verbatim match of every benchmark suffix, over all shards of ``docs`` (doc_id, text).

    One row per item and word position in it (``item_id``, ``start``) with at least one word in common with a
    document: ``length`` in words, and where the match stands first (``doc_id``, null first; ``doc_start``). Two items of one
    id that differ in their text share rows, with the longer of both.
    """
    blocks = _blocks(benchmark, WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, docs in _shards(text_bytes(batch.column(1))):
                for block in (b.value for b in blocks):
                    starts, codes = _coded(docs, block)
                    at, length = block.longest_in(SuffixArray(codes, block.depth, block.bits), codes)
                    some = np.flatnonzero(length)
                    owner = np.searchsorted(starts, at[some], side="right") - 1
                    suffix = block.suffixes[some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block.names[block.item[s]] for s in suffix.tolist()], pa.string()),
                        pa.array([block.place[s] for s in suffix.tolist()], pa.int64()),
                        pa.array(length[some], pa.int64()),
                        pa.array([ids[first + n] for n in owner.tolist()], pa.int64()),
                        pa.array(at[some] - starts[owner], pa.int64()),
                    ], names=["item_id", "start", "length", "doc_id", "doc_start"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _LONGEST)
    best = found.groupBy("item_id", "start").agg(F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_start")).alias("b"))
    return best.select("item_id", "start", (-F.col("b.l")).alias("length"), "b.doc_id", "b.doc_start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, with all their own columns, of which no word is inside an occurrence of a benchmark window."""
    # The caller's columns travel as one, so that none of them can clash with a new one.
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted("text").alias("text"))
    clean = find_overlaps(packed, benchmark, size).filter("n_hit = 0")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_overlaps(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
