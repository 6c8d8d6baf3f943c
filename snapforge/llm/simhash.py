"""SimHash near-duplicates, found with BK-trees over shards of the fingerprints.

Fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of ``blocks`` bit
blocks, so every choice of ``blocks - radius`` blocks makes a shard key and no link can be missed.
Each shard holds a BK-tree: children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius. A shard tree goes to its queries by a shuffle on the shard
key; the trees grow with the corpus, so they are not broadcast. Large shards are cut into blocks and
each pair of blocks is one tree and its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import deal, forest, text_bytes, with_computed
from snapforge.llm.components import components
from snapforge.session import keep

RADIUS = 3
SHINGLE = 3
BLOCKS = 4
TREE_SIZE = 20_000  # most nodes of one tree; larger shards become several trees
_CHUNK = 1 << 16  # shingles that are hashed at once
_FRONTIER = 1 << 20  # (query, node) pairs that are looked at at once


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 (seed 42) of all word shingles, repeats included.

    A-Z is lower-cased, words end at ASCII white space. Fewer words than a shingle has make one
    shingle of all; no word at all makes fingerprint 0.
    """
    words = data.lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint of each whole text as a signed 64-bit number; a null text counts as empty."""

    def factory():
        def compute(column: pa.Array):
            values = np.array([fingerprint(x, shingle) for x in text_bytes(column)], np.uint64)
            return [pa.array(values.view(np.int64))]

        return compute

    return with_computed(docs, factory, f"{name} long")


class BkForest:
    """BK-trees of many shards at once; the first node of each shard is its root.

    All items walk down together, one level a step. Items of one shard that reach a node at the same
    distance go to one child, which is the first of them: the trees are those of one-by-one insertion.
    """

    def __init__(self, shard: np.ndarray, codes: np.ndarray) -> None:
        self.codes = codes
        shards, first = np.unique(shard, return_index=True)
        self.shards, self.roots = shards, first
        walking = np.setdiff1d(np.arange(len(codes)), first, assume_unique=True)
        at = first[np.searchsorted(shards, shard[walking])]
        keys, nodes = [], []
        while len(walking):
            key = at * 65 + np.bitwise_count(codes[walking] ^ codes[at])
            edge, lead, group = np.unique(key, return_index=True, return_inverse=True)
            child = walking[lead]
            keys.append(edge)
            nodes.append(child)
            stay = np.ones(len(walking), bool)
            stay[lead] = False
            walking, at = walking[stay], child[group][stay]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.children = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def search(self, shard: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in pieces; each query looks at its own shard."""
        at = np.searchsorted(self.shards, shard)
        at = np.minimum(at, max(0, len(self.shards) - 1))
        found = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.zeros(0, np.int64)
        stack = [(found[i : i + 8192], self.roots[at[found[i : i + 8192]]]) for i in range(0, len(found), 8192)]
        while stack:
            query, node = stack.pop()
            if len(query) > _FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(codes[query] ^ self.codes[node]).astype(np.int64)
            near = far <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), side="right")
            count = high - low
            total = int(count.sum())
            if total:
                ends = np.cumsum(count)
                edge = np.arange(total) - np.repeat(ends - count - low, count)
                stack.append((np.repeat(query, count), self.children[edge]))


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        shard = np.unique(
            np.stack([table[c].to_numpy().astype(np.int64) for c in ("band", "code", "_a", "_b")], axis=1), axis=0, return_inverse=True
        )[1].reshape(-1)
        fp = table["fp"].to_numpy()
        values, place = np.unique(fp, return_inverse=True)
        is_node, is_query = (table[c].to_numpy(zero_copy_only=False) for c in ("is_member", "is_query"))
        nodes, queries = np.flatnonzero(is_node), np.flatnonzero(is_query)
        trees = BkForest(shard[nodes], fp[nodes].view(np.uint64))
        labels, held, size = np.arange(len(values)), [], 0
        for q, n in trees.search(shard[queries], fp[queries].view(np.uint64), radius):
            u, v = place[queries[q]], place[nodes[n]]
            held.append((u[u != v], v[u != v]))
            size += len(held[-1][0])
            if size > 4 * _FRONTIER:
                labels = forest(len(values), *map(np.concatenate, zip(*held)), labels)
                held, size = [], 0
        if held:
            labels = forest(len(values), *map(np.concatenate, zip(*held)), labels)
        moved = np.flatnonzero(labels != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[labels[moved]])], names=["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges u, v that join the fingerprints (column ``fp``, distinct) linked at ``radius`` or fewer bits.

    Not every link is returned: of the links a task finds, a spanning forest goes on.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("code")) for i, m in enumerate(signed)))
    rows = fps.select("fp", F.explode(bands).alias("b")).select("fp", "b.band", "b.code", F.lit(True).alias("member"))
    pairs = deal(rows, ["band", "code"], TREE_SIZE, "fp", halves=True)
    return pairs.drop("member").repartition("band", "code", "_a", "_b").mapInArrow(_tree_links(radius), "u long, v long")


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fp``, ``root`` for the fingerprints of ``prints`` that are linked to another one."""
    distinct = keep(prints.select("fp").distinct(), "fingerprints")
    return components(fingerprint_links(distinct, radius, blocks)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of each row of ``docs``.

    component_id is the smallest doc_id that links reach, through equal or near fingerprints; null
    ids are passed over, and a group of null ids only has a null component_id. Rows with one id are
    rows of their own. An empty table gives no rows. Columns besides doc_id and text are not used.
    """
    prints = keep(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "prints")
    roots = fingerprint_groups(prints, radius, blocks)
    grouped = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left")
    grouped = keep(grouped.select("fp", "least", F.coalesce("root", "fp").alias("root")), "groups")
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` of which one stays per group: the one with the smallest doc_id (null last).

    All columns are kept. Of rows with one id, any one stays, and a run keeps to its choice.
    """
    numbered = keep(with_fingerprint(docs, shingle, "_fp").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    prints = numbered.select(F.col("_fp").alias("fp"), F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row").alias("pick"))
    best = prints.groupBy("fp").agg(F.min("pick").alias("pick"))
    best = best.join(fingerprint_groups(prints, radius, blocks), "fp", "left")
    best = best.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("pick").alias("pick"))
    stay = best.select(F.col("pick._row").alias("_row"))
    return numbered.join(stay, "_row", "left_semi").drop("_row", "_fp")
