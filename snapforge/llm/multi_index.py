"""Near-duplicate vectors through an inverted multi-index.

Vectors of one label are scaled to length 1 and cut into two halves; each half has a codebook of its
own, and the pairs of codes are the cells of a grid. A vector visits cells in the order of how far it
would have to move to get there, which is a walk over two sorted lists (multi-sequence), and stops
where a link at the threshold would be less likely than the target recall allows, given how far the
vectors spread along the walls between the cells. Vectors that spread in few directions are walked
to the full length of a link, which loses none. Only cells that hold vectors and come after its own
are visited, so a pair meets once; what meets is verified by its cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.llm.common import deal, forest
from snapforge.llm.components import components
from snapforge.session import keep

COSINE = 0.93
CODES = 16  # of each half
SAMPLE = 20_000  # vectors that the codebooks are fitted to
TARGET_RECALL = 0.9999
BLOCK = 4096  # vectors of a cell that are compared with as many at once
SEED = 1


def valid() -> Column:
    """True for vectors that can link: label and all components there and finite, not all zero."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


class Book(NamedTuple):
    """Codes of both halves for vectors of one length, and the largest part of their variance along two walls at once."""

    centers: tuple[np.ndarray, np.ndarray]
    share: float


def codebooks(distinct: DataFrame, codes: int = CODES, sample: int = SAMPLE) -> dict[int, Book]:
    """Codes per length of the vectors, by Lloyd rounds on at most ``sample`` vectors drawn by a hash."""
    drawn = distinct.orderBy(F.xxhash64("embedding", F.lit(SEED)), "node").limit(sample).select("embedding").toArrow()["embedding"].to_pylist()
    by_length: dict[int, list] = {}
    for x in drawn:
        by_length.setdefault(len(x), []).append(x)
    books = {}
    for length, rows in by_length.items():
        x = _unit(np.array(rows, np.float64))
        centers = tuple(_lloyd(h, codes) for h in np.split(x, [length // 2], axis=1))
        books[length] = Book(centers, _share(x, centers))
    return books


def _share(x: np.ndarray, centers: tuple[np.ndarray, np.ndarray]) -> float:
    """Largest part of the variance of ``x`` in the plane of two wall normals, one of each half; 1 if nothing varies."""
    x = x - x.mean(axis=0)
    total = (x * x).sum() / len(x)
    if not total > 0:
        return 1.0
    along = []
    for half, c in zip(np.split(x, [x.shape[1] // 2], axis=1), centers):
        i, j = np.triu_indices(len(c), 1)
        normals = c[i] - c[j]
        size = np.linalg.norm(normals, axis=1)
        normals = normals[size > 0] / size[size > 0, None]
        # No wall: nothing is walked over in this half.
        along.append(half @ normals.T if len(normals) else np.zeros((len(x), 1)))
    a, b = ((v * v).mean(axis=0) for v in along)
    both = along[0].T @ along[1] / len(x)
    mid, apart = (a[:, None] + b) / 2, (a[:, None] - b) / 2
    return min(1.0, float((mid + np.sqrt(apart * apart + both * both)).max() / total))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lloyd(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(SEED)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, centers).argmin(axis=1)
        for i in range(len(centers)):
            own = x[near == i]
            if len(own):
                centers[i] = own.mean(axis=0)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]


def _moves(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """How far each row is from the cell of each center: its distance to the plane between that and its own."""
    d = _distances(x, centers)
    own = d.argmin(axis=1)
    apart = np.sqrt(np.maximum(_distances(centers, centers), 0))[own]
    return np.where(apart > 0, (d - d[np.arange(len(x)), own][:, None]) / (2 * np.where(apart > 0, apart, 1)), 0.0)


def multi_sequence(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of first[i]^2 + second[j]^2, up to ``most``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] ** 2 + second[b[0]] ** 2, 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > most:
            return
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] ** 2 + second[b[q]] ** 2, p, q))


def _reach(cosine: float, recall: float, share: float) -> float:
    """Largest squared move of a visit.

    A link moves a vector by at most sqrt(2 - 2 cosine), and a wall in between is never farther than that. How much of
    it goes across the walls follows the spread of the vectors, of which ``share`` is the most that two walls see.
    """
    z = NormalDist().inv_cdf(1 - (1 - recall) / 2)
    return (2 - 2 * cosine) * min(1.0, z * z * share) + 1e-9


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length of the vectors, rows of the batch that have it, and their vectors scaled to length 1."""
    vectors = batch.column(batch.schema.get_field_index("embedding"))
    lengths = np.array([len(v) for v in vectors])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, _unit(np.array([vectors[int(i)].as_py() for i in at], np.float64))


def _halves(x: np.ndarray, book: Book | None) -> list[np.ndarray]:
    """Moves of both halves; a length that no sampled vector has is one cell."""
    if book is None:
        return [np.zeros((len(x), 1))] * 2
    return [_moves(h, c) for h, c in zip(np.split(x, [x.shape[1] // 2], axis=1), book.centers)]


def _homes(books: dict[int, Book]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for length, _, x in _by_length(batch):
                if length in books:
                    a, b = _halves(x, books[length])
                    found |= {(length, int(c)) for c in a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)}
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in sorted(found)], pa.int32()) for i in (0, 1)], names=["length", "cell"])

    return run


def _visits(books: dict[int, Book], held: dict[int, set[int]], cosine: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, cells, members = [], [], [], []
            for length, at, x in _by_length(batch):
                book = books.get(length)
                first, second = _halves(x, book)
                most, width, full = _reach(cosine, recall, book.share if book else 1.0), second.shape[1], held.get(length, {0})
                for row, a, b in zip(at, first, second):
                    home = int(a.argmin()) * width + int(b.argmin())
                    there = [i * width + j for i, j in multi_sequence(a, b, most)]
                    there = [home, *(c for c in there if c > home and c in full)]
                    rows += [row] * len(there)
                    lengths += [length] * len(there)
                    cells += there
                    members += [True] + [False] * (len(there) - 1)
            taken = batch.take(pa.array(rows, pa.int64()))
            extra = [pa.array(lengths, pa.int32()), pa.array(cells, pa.int32()), pa.array(members, pa.bool_())]
            yield pa.RecordBatch.from_arrays(taken.columns + extra, names=[*batch.schema.names, "length", "cell", "member"])

    return run


def _compare(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        x = _unit(np.array(rows["embedding"].tolist(), np.float64))
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        member, home = rows["is_member"].to_numpy(), rows["member"].to_numpy()
        m, q = np.flatnonzero(member), np.flatnonzero(rows["is_query"].to_numpy())
        links = np.zeros(len(rows), np.int64)
        labels = np.arange(len(rows))
        step = max(1, (8 << 20) // max(1, len(m)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            near = x[part] @ x[m].T >= cosine
            near &= node[part][:, None] != node[m][None, :]
            links[part] += near @ copies[m]
            guest = ~home[part]
            links[m] += copies[part][guest] @ near[guest]  # members of the cell count each other from both sides
            i, j = np.nonzero(near)
            labels = forest(len(rows), part[i], m[j], labels)
        told = pd.DataFrame({"u": node, "v": node[labels], "links": links})
        return told[(told["links"] > 0) | (told["u"] != told["v"])]

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, codes: int = CODES, sample: int = SAMPLE, recall: float = TARGET_RECALL
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine is at least ``cosine``. n_links counts
    the other vectors, copies included; component_id is the smallest vec_id that links reach, kept
    says whether it is the row's own. A vector that is null, zero, or holds a null or non-finite
    component, or that has no label, links with nothing; vectors of different lengths do not link.
    Rows that repeat an id are vectors of their own. Null ids are passed over where a smaller id is
    sought; a row whose component has none gets null, and kept is then true.
    """
    rows = vectors.select("vec_id", "label", "embedding", valid().alias("_valid"))
    numbered = (
        rows.filter("_valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    distinct = keep(numbered, "vectors")
    books = codebooks(distinct, codes, sample)
    visits = distinct.select("label", "node", "copies", "embedding")
    # At most codes^2 cells for each length of the sampled vectors.
    held: dict[int, set[int]] = {}
    for r in visits.select("embedding").mapInArrow(_homes(books), "length int, cell int").distinct().collect():
        held.setdefault(r["length"], set()).add(r["cell"])
    schema = T.StructType(visits.schema.fields + T.StructType.fromDDL("length int, cell int, member boolean").fields)
    placed = keep(visits.mapInArrow(_visits(books, held, cosine, recall), schema), "visits")
    groups = deal(placed, ["label", "length", "cell"], BLOCK, "node")
    found = keep(
        groups.groupBy("label", "length", "cell", "_a", "_b").applyInPandas(_compare(cosine), "u long, v long, links long"), "links"
    )
    roots = components(found.select("u", "v"))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = distinct.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    same = F.col("_valid") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    joined = rows.join(named, same, "left").withColumn("component_id", F.when(F.col("_valid"), F.col("component_id")).otherwise(F.col("vec_id")))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
