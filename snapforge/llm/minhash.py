"""MinHash fingerprints of texts and near-duplicates by signature bands.

A text's shingles are hashed from running sums of its word codes; each of ``PERMS`` universal hash
functions a * x + b (modulo 2^64) keeps its smallest value per text, all in vectorised numpy. Near
duplicates meet in Spark when a band of their signatures is equal and are verified by their Jaccard
similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import deal, forest, partitions, text_bytes, with_computed
from snapforge.llm.components import components
from snapforge.llm.windows import rolling
from snapforge.session import keep

SHINGLE = 5
PERMS = 128
BANDS = 32
JACCARD = 0.8
BLOCK = 2000
_WORDS = 400_000
_BATCH = 1 << 20  # words whose shingles are permuted together
_SLICE = 1 << 15  # shingles that stay in the processor's cache
_RNG = np.random.default_rng(6)
_A = _RNG.integers(0, 1 << 64, PERMS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, PERMS, dtype=np.uint64)


class Shingler:
    """Shingle hashes of texts; words are lower-cased (A-Z) and end at ASCII white space."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.codes = size, {}

    def _code(self, word: bytes) -> int:
        code = self.codes.get(word)
        if code is None:
            if len(self.codes) > _WORDS:
                self.codes.clear()
            code = self.codes[word] = xxhash.xxh64_intdigest(word, 17)
        return code

    def hashes(self, data: bytes) -> np.ndarray:
        """One hash per shingle; fewer words than a shingle has make one shingle, no word makes none."""
        words = data.lower().split()
        codes = np.fromiter(map(self._code, words), np.uint64, len(words))
        return rolling(codes, min(self.size, len(codes))) if len(codes) else codes


def signatures(hashes: list[np.ndarray], perms: int = PERMS) -> np.ndarray:
    """Upper 32 bits of each permutation's smallest value, texts x ``perms``; all ones for a text without shingles."""
    out = np.full((len(hashes), perms), 0xFFFFFFFF, np.uint32)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    least = np.full((perms, len(full)), np.iinfo(np.uint64).max, np.uint64)
    flat = np.concatenate([hashes[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(hashes[i]) for i in full])])
    for low in range(0, len(flat), _SLICE):
        part = flat[low : low + _SLICE]
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, low + len(part), side="left"))
        cuts = np.maximum(starts[first:last] - low, 0)
        values = np.empty_like(part)
        with np.errstate(over="ignore"):
            for p in range(perms):
                np.multiply(part, _A[p], out=values)
                np.add(values, _B[p], out=values)
                np.minimum(least[p, first:last], np.minimum.reduceat(values, cuts), out=least[p, first:last])
    out[full] = (least >> np.uint64(32)).astype(np.uint32).T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of two signatures, an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def text_signatures(texts: list[bytes], shingler: Shingler) -> np.ndarray:
    parts, held, size = [], [], 0
    for data in texts:
        held.append(shingler.hashes(data))
        size += len(held[-1])
        if size > _BATCH:
            parts.append(signatures(held))
            held, size = [], 0
    if held or not parts:
        parts.append(signatures(held))
    return np.concatenate(parts)


def with_signature(docs: DataFrame) -> DataFrame:
    """``docs`` and ``signature``: little-endian 32-bit minima of each whole text; equal texts have equal ones."""

    def factory():
        shingler = Shingler()
        return lambda column: [[row.tobytes() for row in text_signatures(text_bytes(column), shingler)]]

    return with_computed(docs, factory, "signature binary")


def _verify(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        shingler = Shingler()
        sets = [np.unique(shingler.hashes(bytes(t))) for t in rows["data"]]
        node = rows["node"].to_numpy()
        m, q = np.flatnonzero(rows["is_member"]), np.flatnonzero(rows["is_query"])
        labels, counts = np.arange(len(rows)), np.array([len(s) for s in sets])
        for i in q:
            near = np.minimum(counts[m], counts[i]) >= least * np.maximum(counts[m], counts[i])
            near &= labels[m] != labels[i]
            for j in m[near]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if i != j and both >= least * (counts[i] + counts[j] - both):
                    labels = forest(len(rows), np.array([i]), np.array([j]), labels)
        told = pd.DataFrame({"u": node, "v": node[labels]})
        return told[told["u"] != told["v"]]

    return run


def near_duplicates(docs: DataFrame, jaccard: float = JACCARD, bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``component_id``: texts with a shingle Jaccard of at least ``jaccard`` are linked.

    Equal texts are one node, so a group of copies costs one row; inside a band, blocks of texts are
    compared and a spanning forest of the verified links goes on. Texts without a word are alike.
    component_id is the smallest doc_id that links reach. With the default bands a pair at exactly the
    bound meets in a band with a probability of 1 - (1 - 0.8^4)^32, above 0.9999999.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    nodes = rows.groupBy("data").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    signed = keep(with_signature(nodes.withColumn("text", F.col("data"))).drop("text"), "signed")
    width = 4 * PERMS // bands
    banded = signed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    banded = banded.withColumn("code", F.xxhash64("band", F.substring(F.col("signature"), 1, 4 * PERMS), F.lit(0)) if bands == 1 else F.xxhash64("band", F.expr(f"substring(signature, band * {width} + 1, {width})")))
    shared = banded.select("band", "code", "node", F.lit(True).alias("member"))
    several = shared.groupBy("band", "code").count().filter("count > 1").drop("count")
    pairs = deal(shared.join(several, ["band", "code"], "left_semi"), ["band", "code"], BLOCK, "node", halves=True)
    full = pairs.join(signed.select("node", "data"), "node")
    links = full.groupBy("band", "code", "_a", "_b").applyInPandas(_verify(jaccard), "u long, v long")
    named = signed.select("node", "data", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("data", "component_id")
    return rows.join(named, "data").select("doc_id", "component_id")


def _edited_task():
    """Rows of one piece in the order of their ids, its last the first of the next piece, which only lends its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(), []

        def finish(rows: list[tuple], following: str) -> pa.RecordBatch:
            texts = [r[1] for r in rows]
            after = texts[1:] + [following]
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after)]
            coded = [e.encode() for e in edited]
            own = text_signatures([t.encode() for t in [*texts, following]], shingler)
            changed = text_signatures(coded, shingler)
            name = lambda row: hashlib.blake2b(row.tobytes(), digest_size=16).hexdigest()
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
                "fingerprint": [row.tobytes().hex() for row in own[:-1]],
                "edited_fingerprint": [row.tobytes().hex() for row in changed],
                "near_edited": likeness(own[:-1], changed),
                "near_next": likeness(own[:-1], own[1:]),
            })

        size = 0
        for batch in batches:
            for doc, text, lent in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                if lent:  # sorted last; only the first such row is next
                    if held:
                        yield finish(held, text)
                        held = []
                    continue
                if size > 4 << 20 and held:
                    yield finish(held, text)
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)
        if held:
            raise RuntimeError(f"no document follows {held[-1][0]} in its range")

    return run


def _piece(cuts: list[int]) -> Column:
    """Number of ``cuts`` up to doc_id; 0 for a null id."""
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= F.col("doc_id"))))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, the last quarter replaced by the start of the next document.

    Columns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next (likeness to the edited text, to the next document). The next document has the
    next doc_id (null first, ties by text); after the last comes the first. A null text is empty; two
    texts without words are alike. Ids are cut into ranges, at ids the table holds, and a range also
    gets the first row of the next one, so each text is shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs)
    # One number per partition comes to the driver.
    least, nulls, marks = rows.agg(
        F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1)), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)
    ).first()
    # The marks are computed in double, so those of large ids need not be ids of the table.
    cuts = [r[0] for r in rows.filter("doc_id is not null").groupBy(_piece(sorted(set(marks or [])))).agg(F.min("doc_id")).select("min(doc_id)").collect()]
    cuts = sorted(set(cuts) - {least})
    pieces, piece = len(cuts) + 1, _piece(cuts)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    here = F.struct(piece.cast("int").alias("piece"), F.lit(False).alias("lent"))
    before = F.struct((piece - 1).cast("int").alias("piece"), F.lit(True).alias("lent"))
    around = F.struct(F.lit(pieces - 1).alias("piece"), F.lit(True).alias("lent"))
    starts = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    sent = F.when(first, F.array(here, around)).when(starts, F.array(here, before)).otherwise(F.array(here))
    dealt = rows.withColumn("_to", F.explode(sent)).select("doc_id", "text", F.col("_to.lent").alias("lent"), F.col("_to.piece").alias("piece"))
    ordered = dealt.repartitionById(pieces, "piece").sortWithinPartitions("lent", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(
        _edited_task(),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
