"""Prefix trie of conversations, with totals of every subtree by the Euler-tour technique.

Conversations that begin with the same turns share the nodes of those turns. Each node has an enter and an exit arc,
and every arc knows its successor from the children, the next sibling and the parent of its node, so all arcs make one
list. The list is ranked in Spark: in each round, blocks of arcs contract the runs of the list they hold, until one
block is left; then the places travel back. Leaves and savings are weights of the enter arcs, and a subtree's total is
the difference of the prefix sums at its exit and its enter arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapforge.llm.common import WORD, partitions
from snapforge.operators.paging import number_rows, running_totals
from snapforge.session import keep

FAMILY = 20  # conversations of one family begin with turns of its first one
HEADS = 4  # with less than so many
BLOCK = 1 << 14  # arcs or turns that one group holds
SIBLINGS = 1 << 9  # ids in whose range siblings are ordered by one group
_PIECE = 1 << 12  # ids in one piece of a digest's text
_KEY = ["depth", "key1", "key2"]
_HALF = 0xFFFFFFFF


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1 in order of the turn, null first), ``code`` (digest of role and text), ``words``.

    Turns of one number are in order of their digests; rows that repeat are turns of their own. A null role or text is
    empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("code"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    ranked = running_totals(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("code").asc()])
    return keep(ranked.select("conv_id", F.col("rank").alias("pos"), "code", "words"), "turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns after every conversation c has got the first h of conversation c - c % 20 in place of its first h.

    h is crc32(c as text) % 4. All turns are taken where the other conversation has fewer, none where it is absent.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    first = turns.filter(F.col("pos") < HEADS)
    counts = first.groupBy("conv_id").agg(F.count("*").alias("there")).withColumnRenamed("conv_id", "base")
    family = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), head.alias("h"))
    given = first.select(F.col("conv_id").alias("base"), "pos", "code", "words")
    heads = family.join(given, "base").filter("pos <= h").select("conv_id", "pos", "code", "words")
    # Where fewer than h turns have come, the own ones move up.
    moved = family.join(counts, "base", "left").withColumn("gap", F.col("h") - F.least("h", F.coalesce("there", F.lit(0))))
    gaps = moved.filter("gap > 0").select("conv_id", "gap")
    own = turns.withColumn("h", head).filter("pos > h").join(gaps, "conv_id", "left")
    return heads.union(own.select("conv_id", F.col("pos") - F.coalesce("gap", F.lit(0)), "code", "words"))


def _prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per conversation and depth: the key of its first ``depth`` turns, that of one turn less, the last words.

    A key is 128 bits: four sums modulo 2^32 of hashes of each turn at its place. So it is a running sum, which a
    very long conversation takes in blocks of turns. Keys are not checked against the turns.
    """
    hashes = [F.xxhash64(F.lit(seed), "pos", "code") for seed in (1, 2)]
    parts = [p for h in hashes for p in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_HALF)))]
    names = [f"x{i}" for i in range(4)]
    cut = turns.withColumns(dict(zip(names, parts))).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({f"s{i}": F.sum(f"x{i}").over(inside) for i in range(4)})
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    before = before.select("conv_id", "block", *[F.sum(n).over(ahead).alias(f"b{i}") for i, n in enumerate(names)]).filter("block > 0")
    whole = local.join(before, ["conv_id", "block"], "left")
    total = [F.col(f"s{i}") + F.coalesce(f"b{i}", F.lit(0)) for i in range(4)]

    def key(sums: list[Column], at: int) -> Column:
        low = [s.bitwiseAND(F.lit(_HALF)) for s in sums[2 * at : 2 * at + 2]]
        return F.shiftleft(low[0], 32).bitwiseOR(low[1])

    less = [t - F.col(n) for t, n in zip(total, names)]
    steps = whole.select(
        "conv_id", F.col("pos").cast("long").alias("depth"), "words",
        key(total, 0).alias("key1"), key(total, 1).alias("key2"), key(less, 0).alias("up1"), key(less, 1).alias("up2"),
    )
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", *[zero.alias(n) for n in ("depth", "words", "key1", "key2", "up1", "up2")])
    return keep(steps.union(roots), "prefixes")


def _contract(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of the list inside one block: for each arc the head of its run and the sums before it, for heads the run."""
    rows = rows.sort_values("id")
    ids, following = rows["id"].to_numpy(), rows["next"].to_numpy()
    weight = rows[["w0", "w1", "w2"]].to_numpy()
    at = np.minimum(np.searchsorted(ids, following), len(ids) - 1)
    tail = ids[at] != following
    up, sums = np.arange(len(ids)), np.zeros_like(weight)
    up[at[~tail]] = np.flatnonzero(~tail)
    sums[at[~tail]] = weight[~tail]
    while True:
        further = up[up]
        if np.array_equal(further, up):
            break
        sums, up = sums + sums[up], further
    out = pd.DataFrame({"id": ids, "head": ids[up], "o0": sums[:, 0], "o1": sums[:, 1], "o2": sums[:, 2]})
    run = np.zeros((len(ids), 4), np.int64)
    run[up[tail], 0] = following[tail]
    run[up[tail], 1:] = sums[tail] + weight[tail]
    return out.assign(next=run[:, 0], w0=run[:, 1], w1=run[:, 2], w2=run[:, 3])


def rank_list(arcs: DataFrame) -> DataFrame:
    """Sums of the weights before every arc (``id``, ``o0``, ``o1``, ``o2``) of a list (``id`` from 0 densely, ``next``, ``w0``, ``w1``, ``w2``).

    ``next`` of the last arc is -1. The first round cuts the arcs by ranges of their ids, which hold long runs where
    neighbours of the list have near ids. In each later round, a coin of each arc sends arcs with 0 to their
    successor with 1, so a quarter of all arcs at least is expected to go, whatever the order is. Blocks have about
    ``BLOCK`` arcs, and rounds go on until one block is left. Every round is a written table.
    """
    levels, now = [], keep(arcs, "arcs")
    n = now.count()
    if not n:
        return now.select("id", *[F.col(f"w{i}").alias(f"o{i}") for i in range(3)])
    while True:
        blocks, turn = -(-n // BLOCK), len(levels)
        if turn == 0:
            block = F.floor(F.col("id") / BLOCK)
        else:
            coin = lambda c: F.xxhash64(c, F.lit(turn)).bitwiseAND(F.lit(1)) == 1
            meet = F.when(~coin(F.col("id")) & coin(F.col("next")), F.col("next")).otherwise(F.col("id"))
            block = F.pmod(F.xxhash64(meet, F.lit(-turn)), F.lit(blocks))
        parted = now.select(block.cast("long").alias("block"), "id", "next", "w0", "w1", "w2").groupBy("block")
        level = parted.applyInPandas(_contract, "id long, head long, o0 long, o1 long, o2 long, next long, w0 long, w1 long, w2 long")
        levels.append(keep(level, "runs"))
        if blocks == 1:
            break
        now = levels[-1].filter("id = head").select("id", "next", "w0", "w1", "w2")
        n = now.count()
    places = levels.pop().select("id", "o0", "o1", "o2")
    for level in reversed(levels):
        heads = places.select(F.col("id").alias("head"), *[F.col(f"o{i}").alias(f"p{i}") for i in range(3)])
        places = keep(level.join(heads, "head").select("id", *[(F.col(f"o{i}") + F.col(f"p{i}")).alias(f"o{i}") for i in range(3)]), "places")
    return places


def _next_siblings(tree: DataFrame) -> DataFrame:
    """``id`` and ``next_sibling`` of nodes that have one; the children of one parent are cut by ranges of ids."""
    nodes = tree.filter("parent is not null").select("parent", "id", F.floor(F.col("id") / SIBLINGS).alias("block"))
    inside = nodes.withColumn("near", F.lead("id").over(Window.partitionBy("parent", "block").orderBy("id")))
    firsts = nodes.groupBy("parent", "block").agg(F.min("id").alias("first"))
    far = firsts.select("parent", "block", F.lead("first").over(Window.partitionBy("parent").orderBy("block")).alias("far")).filter("far is not null")
    found = inside.join(far, ["parent", "block"], "left").select("id", F.coalesce("near", "far").alias("next_sibling"))
    return found.filter("next_sibling is not null")


def euler_tour(tree: DataFrame, kids: DataFrame) -> DataFrame:
    """Arcs of the tour: entering node v is 2 v, leaving it 2 v + 1; weights are steps, leaves and savings of the node."""
    full = tree.join(kids, tree["id"] == kids["of"], "left").join(_next_siblings(tree), "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    back = F.coalesce(F.col("next_sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    leaf = F.when(F.col("first").isNull(), one).otherwise(zero)
    both = F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("first") * 2, leave).alias("next"), one.alias("w0"), leaf.alias("w1"), F.col("saved").alias("w2")),
        F.struct(leave.alias("id"), back.alias("next"), one.alias("w0"), zero.alias("w1"), zero.alias("w2")),
    )
    return full.select(F.inline(both))


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """First rows of the runs of equal keys."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) as rows (key, first id, ids joined by commas)."""
    for batch in batches:
        cells = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        starts = _runs(cells[:3])
        starts = np.unique(np.concatenate([starts, np.arange(0, batch.num_rows, _PIECE)]))
        ends = np.append(starts[1:], batch.num_rows)
        texts = [",".join(map(str, cells[3][a:b].tolist())) for a, b in zip(starts.tolist(), ends.tolist())]
        arrays = [pa.array(c[starts], pa.int64()) for c in cells] + [pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*_KEY, "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key from its pieces in order; only the state of the digest stays in memory."""
    last, digest = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        keys = list(zip(*(r[0] for r in rows))) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, pa.int64()) for k in keys), pa.array([r[1] for r in rows], pa.string())], names=[*_KEY, "ends_sha256"]
        )

    for batch in batches:
        rows = []
        for *key, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if key == last:
                digest.update(b"," + piece.encode())
                continue
            if last is not None:
                rows.append((last, digest.hexdigest()))
            last, digest = key, hashlib.sha256(piece.encode())
        yield made(rows)
    if last is not None:
        yield made([(last, digest.hexdigest())])


def end_digests(prefixes: DataFrame) -> DataFrame:
    """Per node at which conversations end, SHA-256 of their ids in ascending order, joined by commas.

    A digest has to see its bytes in order; before that, the ids of a node are sorted and joined in many tasks, and
    pieces of a few thousand ids reach the task that makes the digest.
    """
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("k"))
    ends = keep(last.select(*[F.col(f"k.{c}").alias(c) for c in _KEY], "conv_id"), "ends")
    n = partitions(ends)
    ordered = ends.repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    key = "depth long, key1 long, key2 long"
    pieces = ordered.mapInArrow(_pieces, f"{key}, first long, piece string")
    return pieces.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, f"{key}, ends_sha256 string")


def build_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, pos from 1 without gaps, code, words); ``ids`` has all of them.

    One row per distinct beginning of conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (the parent's conv_id, null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` and ``saved_tokens`` of
    the subtree, ``ends_sha256``, and ``place``, the arcs of the tour before the node is entered. Conversations without
    turns are members of the root only. Without conversations there are no nodes.
    """
    prefixes = _prefixes(turns, ids)
    nodes = prefixes.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.max("words").alias("words"),
    )
    numbered = keep(number_rows(nodes, ["conv_id", "depth"], name="id", start=0), "nodes")
    above = numbered.select(
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("_d"),
        F.col("key1").alias("_k1"), F.col("key2").alias("_k2"),
    )
    same = (F.col("depth") == F.col("_d")) & (F.col("up1") == F.col("_k1")) & (F.col("up2") == F.col("_k2"))
    tree = keep(
        numbered.join(above, same, "left").select(
            "id", *_KEY, "conv_id", "parent", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "tree",
    )
    kids = keep(tree.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.min("id").alias("first"), F.count("*").alias("n_children")), "children")
    ranked = rank_list(euler_tour(tree, kids))
    # From entering to leaving a node no sum falls, so the two values of a node are its least and its largest.
    span = lambda c: (F.max(c) - F.min(c))
    totals = ranked.groupBy(F.floor(F.col("id") / 2).alias("of")).agg(F.min("o0").alias("place"), span("o1").alias("n_leaves"), span("o2").alias("saved_tokens"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        tree.join(kids.drop("first").withColumnRenamed("of", "id"), "id", "left")
        .join(totals.withColumnRenamed("of", "id"), "id")
        .join(end_digests(prefixes), _KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "place",
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the conversations (conv_id, turn, role, text) as they are."""
    turns = ordered_turns(conversations)
    return build_trie(turns, turns.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations, see ``rebuilt``; those that are left without turns count for the root."""
    turns = ordered_turns(conversations)
    return build_trie(rebuilt(turns), turns.select("conv_id").distinct())
