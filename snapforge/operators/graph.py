"""Order, reachability and cycles of foreign-key edges.

An edge ``src -> ref`` says that src refers to ref, so ref has to exist first. Every round writes
its result to the scratch folder: the plan of a round never grows with the rounds before it. Deep
graphs are contracted first, so that the rounds of their levels grow with the logarithm of the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.functions.names import qualified_name
from snapforge.session import keep, local_frame, scratch_path

# Rounds after which the parts found so far are written as one.
COMPACT = 8
# Most edges whose levels one task finds at once (some 50 MB).
AT_ONCE = 1 << 18
# A round of levels that drops less than this part of the edges is the last one; the rest is contracted.
LEAST_DROP = 64


def catalog_edges(foreign_keys: DataFrame) -> DataFrame:
    """Edges src, ref, constraint between qualified table names."""
    return foreign_keys.select(
        qualified_name(F.col("src_schema"), F.col("src_table")).alias("src"),
        qualified_name(F.col("ref_schema"), F.col("ref_table")).alias("ref"),
        "constraint",
    )


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "ref").distinct()


def _levels_at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Levels of the nodes that have edges, of all edges of a graph; those into or on a cycle are marked, and their level has no meaning.

    An edge (src, ref) stands for ``steps`` levels; with ``ground`` it leads to level 0, whatever its ref. A node is done in
    the round after the last node that it refers to; only its edges are looked at then.
    """
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    edges = pd.concat(frames)
    codes, names = pd.factorize(pd.concat([edges["src"], edges["ref"]], ignore_index=True))
    src, ref, steps, ground = codes[: len(edges)], codes[len(edges) :], edges["steps"].to_numpy(), edges["ground"].to_numpy()
    level = np.zeros(len(names), np.int64)
    np.maximum.at(level, src[ground], steps[ground])
    src, ref, steps = src[~ground], ref[~ground], steps[~ground]
    order = np.argsort(ref, kind="stable")
    starts = np.searchsorted(ref[order], np.arange(len(names) + 1))
    waits = np.bincount(src, minlength=len(names))
    done = np.flatnonzero(waits == 0)
    while len(done):
        n = starts[done + 1] - starts[done]
        into = order[np.repeat(starts[done] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        np.maximum.at(level, src[into], level[ref[into]] + steps[into])
        less, times = np.unique(src[into], return_counts=True)
        waits[less] -= times
        done = less[waits[less] == 0]
    stuck = waits > 0
    level[stuck] = level[~stuck].max(initial=0) + 1
    listed = level > 0
    yield pd.DataFrame({"node": names[listed], "level": level[listed], "stuck": stuck[listed]})


def _found_at_once(edges: DataFrame) -> DataFrame:
    """``node``, ``level``, ``stuck`` of the edges src, ref, steps; a null ref is the ground."""
    kind = edges.schema["src"].dataType.simpleString()
    given = edges.select("src", F.coalesce("ref", "src").alias("ref"), "steps", F.col("ref").isNull().alias("ground"))
    return given.coalesce(1).mapInPandas(_levels_at_once, f"node {kind}, level long, stuck boolean")


def _peel(pairs: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``node``, ``level`` of all nodes, and the edges that never go (those into or on a cycle).

    A graph of at most ``AT_ONCE`` edges is done by one task, however deep it is; a larger one by rounds.
    """
    proper = pairs.filter("src <> ref")
    if proper.count() > AT_ONCE:
        return _peel_by_rounds(pairs, nodes)
    every = pairs.select(F.col("src").alias("node")).union(pairs.select("ref"))
    if nodes is not None:
        every = every.union(nodes.select("node"))
    found = keep(_found_at_once(proper.select("src", "ref", F.lit(1).cast("long").alias("steps"))), "levels")
    levels = every.distinct().join(found.drop("stuck"), "node", "left")
    return levels.select("node", F.coalesce("level", F.lit(0)).cast("int").alias("level")), _stuck_edges(proper, found)


def _stuck_edges(proper: DataFrame, found: DataFrame) -> DataFrame:
    stuck = found.filter("stuck").select("node")
    left = proper.join(stuck, F.col("src") == F.col("node"), "left_semi").join(stuck, F.col("ref") == F.col("node"), "left_semi")
    return left.select("src", "ref")


def _peel_by_rounds(pairs: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``_peel`` of a graph of any size.

    A round drops the edges whose ref has no edge of its own any more. The nodes that still are the
    src of an edge go to a folder of the round, and the level of a node is the last round that lists
    it. All rounds are read as one table, so no plan grows with the depth. When a round drops few
    edges, the rest is deep and goes to ``_levels_by_contraction``.
    """
    spark = pairs.sparkSession
    every = pairs.select(F.col("src").alias("node")).union(pairs.select("ref"))
    if nodes is not None:
        every = every.union(nodes.select("node"))
    path, level = scratch_path(spark, "levels"), 0
    every.distinct().write.parquet(f"{path}/level=0")
    left, deep = pairs.filter("src <> ref"), None
    size = left.count()
    while size:
        level += 1
        left.select(F.col("src").alias("node")).distinct().write.parquet(f"{path}/level={level}")
        waiting = left.select(F.col("src").alias("ref")).distinct()
        rest = keep(left.join(waiting, "ref", "left_semi").select("src", "ref"), "edges")
        before, size, left = size, rest.count(), rest
        if size == before:
            break
        if size and (before - size) * LEAST_DROP < before:
            deep = _levels_by_contraction(left)
            left = _stuck_edges(left, deep)
            break
    listed = spark.read.parquet(path).select("node", F.col("level").cast("long"))
    if deep is not None:  # nodes without edges in the rest have the level of this round, at most
        listed = listed.union(deep.select("node", F.col("level") + level))
    return listed.groupBy("node").agg(F.max("level").cast("int").alias("level")), left


def _levels_by_contraction(pairs: DataFrame) -> DataFrame:
    """``node``, ``level``, ``stuck`` of the nodes that are the src of ``pairs`` (no self references), for graphs that are deep.

    An edge to a node without edges leads to the ground (ref null). A node with a single edge is as many steps above the
    end of that edge as it stands for, so it can be left out: the edges to it go on to that end and stand for more
    steps; of several edges between two nodes the longest counts. A round leaves out those whose coin shows heads, unless the
    coin of the end does so too; so no two neighbours go at once, and a quarter of such nodes goes. The rest, once it has at
    most ``AT_ONCE`` edges, is done by one task, and the nodes left out get their levels in the opposite order. All
    rounds together read and write a few times the edges. A graph that is deep although its nodes have several edges
    each (no chains, at no stage) takes about as many rounds as it is deep.
    """
    spark, kind = pairs.sparkSession, pairs.schema["src"].dataType.simpleString()
    own = pairs.select(F.col("src").alias("ref")).distinct().withColumn("_own", F.lit(True))
    grounded = pairs.join(own, "ref", "left").select("src", F.when(F.col("_own"), F.col("ref")).alias("ref"))
    edges = keep(grounded.distinct().withColumn("steps", F.lit(1).cast("long")), "edges")
    removed: list[DataFrame] = []
    turn = 0
    while True:
        counts = edges.agg(F.count("*").alias("n"), F.count("ref").alias("inner")).head()
        if counts["n"] <= AT_ONCE:
            found = _found_at_once(edges)
            break
        turn += 1
        single = edges.groupBy("src").agg(F.count("*").alias("_n"), F.max("ref").alias("to"), F.max("steps").alias("by"))
        single = single.filter((F.col("_n") == 1) & (F.col("to").isNull() | (F.col("to") != F.col("src"))))
        heads = lambda c: F.xxhash64(F.col(c), F.lit(turn)) % 2 == 0
        out = single.filter(heads("src") & (F.col("to").isNull() | ~heads("to"))).select(F.col("src").alias("node"), "to", "by")
        out = keep(out, "removed")
        if out.isEmpty():
            # Without a way to the ground, or without nodes of one edge, all that is left reaches a cycle.
            if counts["n"] == counts["inner"] or single.isEmpty():
                found = edges.select(F.col("src").alias("node")).distinct().select("node", F.lit(0).cast("long").alias("level"), F.lit(True).alias("stuck"))
                break
            continue
        removed.append(out)
        kept = edges.join(out.select(F.col("node").alias("src")), "src", "left_anti").join(out, F.col("ref") == F.col("node"), "left")
        ref = F.when(F.col("node").isNull(), F.col("ref")).otherwise(F.col("to"))
        moved = kept.select("src", ref.alias("ref"), (F.col("steps") + F.coalesce("by", F.lit(0))).alias("steps"))
        edges = keep(moved.groupBy("src", "ref").agg(F.max("steps").alias("steps")), "edges")
    path, schema = scratch_path(spark, "contracted"), f"node {kind}, level long, stuck boolean"
    found.write.parquet(path)
    while removed:
        known = spark.read.schema(schema).parquet(path).select(F.col("node").alias("to"), "level", "stuck")
        level = F.coalesce("level", F.lit(0)) + F.col("by")
        back = removed.pop().join(known, "to", "left").select("node", level.alias("level"), F.coalesce("stuck", F.lit(False)).alias("stuck"))
        back.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def dependency_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node``, ``level``: 0 without parents, else one more than the highest parent.

    Self references are ignored; any other cycle is an error, see ``load_order``. ``nodes`` adds
    nodes without edges.
    """
    levels, left = _peel(keep(_pairs(edges), "edges"), nodes)
    if not left.isEmpty():
        raise ValueError("the edges contain a cycle; use load_order")
    return levels


def reachability(edges: DataFrame) -> DataFrame:
    """All pairs (src, ref) with a path from src to ref, cycles included.

    Each round extends only the pairs found in the round before. The known pairs are one part per
    round; every ``COMPACT`` rounds they are written together, so that plans stay short.
    """
    step = keep(_pairs(edges), "edges")
    hop = step.select(F.col("src").alias("mid"), F.col("ref").alias("next"))
    known = fresh = step
    rounds = 0
    while True:
        rounds += 1
        longer = (
            fresh.join(hop, fresh["ref"] == hop["mid"]).select("src", F.col("next").alias("ref")).distinct()
        )
        fresh = keep(longer.join(known, ["src", "ref"], "left_anti"), "paths")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if rounds % COMPACT == 0:
            known = keep(known, "paths")


def _trim(pairs: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle, until every node has a way in and a way out."""
    size = pairs.count()
    while size:
        sources = pairs.select(F.col("src").alias("ref")).distinct()
        targets = pairs.select(F.col("ref").alias("src")).distinct()
        pairs = keep(pairs.join(sources, "ref", "left_semi").join(targets, "src", "left_semi").select("src", "ref"), "core")
        left = pairs.count()
        if left == size:
            break
        size = left
    return pairs


def _colors(pairs: DataFrame) -> DataFrame:
    """Highest node that reaches each node (itself included): node, color."""
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("ref")).distinct()
    colors = keep(nodes.withColumn("color", F.col("node")), "colors")
    while True:
        arriving = pairs.join(colors, pairs["src"] == colors["node"]).select(
            F.col("ref").alias("node"), "color", F.lit(None).cast("string").alias("was")
        )
        merged = (
            colors.withColumn("was", F.col("color"))
            .unionByName(arriving)
            .groupBy("node")
            .agg(F.max("color").alias("color"), F.max("was").alias("was"))
        )
        merged = keep(merged, "colors")
        colors = merged.select("node", "color")
        if merged.filter("color <> was").isEmpty():
            return colors


def _spread(start: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node``, ``root``, ``depth`` of breadth-first rounds from ``start`` (node, root).

    ``pairs`` has src, ref and the root they belong to.
    """
    fresh = keep(start.withColumn("depth", F.lit(0)), "spread")
    seen, depth = fresh, 0
    while True:
        depth += 1
        reached = fresh.join(pairs, (fresh["node"] == pairs["src"]) & (fresh["root"] == pairs["color"])).select(
            pairs["ref"].alias("node"), fresh["root"]
        )
        fresh = keep(
            reached.distinct().join(seen, ["node", "root"], "left_anti").withColumn("depth", F.lit(depth)), "spread"
        )
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
        if depth % COMPACT == 0:
            seen = keep(seen, "spread")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of all nodes in the cyclic part; two nodes with one root reach each other.

    Colors every node by the highest node that reaches it; going back from that node inside its
    color gives one component per color and round. Work per round is linear in the edges left,
    no pairs of nodes are built.
    """
    left = _trim(keep(_pairs(edges.select(F.col("src").cast("string"), F.col("ref").cast("string"))), "pairs"))
    found: DataFrame | None = None
    while not left.isEmpty():
        colors = _colors(left)
        back = (
            left.join(colors.select(F.col("node").alias("src"), F.col("color").alias("c1")), "src")
            .join(colors.select(F.col("node").alias("ref"), F.col("color").alias("c2")), "ref")
            .filter("c1 = c2")
            .select(F.col("ref").alias("src"), F.col("src").alias("ref"), F.col("c1").alias("color"))
        )
        roots = colors.filter("node = color").select("node", F.col("color").alias("root"))
        done = _spread(roots, keep(back, "back")).select("node", "root")
        found = done if found is None else found.unionByName(done)
        gone = done.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(
            gone.withColumnRenamed("node", "ref"), "ref", "left_anti"
        )
        left = _trim(keep(rest.select("src", "ref"), "pairs"))
    if found is None:
        return local_frame(edges.sparkSession, [], "node string, root string")
    return found


def _inner_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges whose two ends belong to one component, with its ``root``."""
    a = parts.select(F.col("node").alias("src"), F.col("root"))
    b = parts.select(F.col("node").alias("ref"), F.col("root").alias("_root"))
    return edges.join(a, "src").join(b, "ref").filter("root = _root").drop("_root")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """All edges that lie on a cycle, self references included, with all their columns."""
    return _inner_edges(edges, components(edges)).select(*edges.columns)


def _turn(inner: DataFrame) -> DataFrame:
    """All edges on one side of one node per component (``inner``: src, ref, root).

    The node with the fewest edges on its smaller side is taken, then the one with the most on the
    other side, then the last name. Every cycle through it ends with that side.
    """
    one, none = F.lit(1), F.lit(0)
    ends = inner.select("root", F.col("src").alias("node"), none.alias("_in"), one.alias("_out")).union(
        inner.select("root", "ref", one, none)
    )
    degrees = ends.groupBy("root", "node").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    best = F.struct(
        (-F.least("_in", "_out")).alias("few"), F.greatest("_in", "_out").alias("many"), F.col("node"), (F.col("_in") <= F.col("_out")).alias("arriving")
    )
    chosen = degrees.groupBy("root").agg(F.max(best).alias("_t"))
    side = F.when(F.col("_t.arriving"), F.col("ref")).otherwise(F.col("src"))
    return inner.join(chosen, "root").filter(side == F.col("_t.node")).select("src", "ref")


def break_edges(edges: DataFrame) -> DataFrame:
    """Edges whose removal leaves no cycle.

    Self references go. In every component of the rest one node loses its edges of one side, see
    ``_turn``; then the components of what is left are searched again, until there are none. So an
    edge only goes while it lies on a cycle, and cycles that share an edge can end with that one.
    All components take their turn in the same round.
    """
    pairs = keep(_pairs(edges.select(F.col("src").cast("string"), F.col("ref").cast("string"))), "pairs")
    left, gone = pairs.filter("src <> ref"), [pairs.filter("src = ref")]
    while True:
        inner = keep(_inner_edges(left, keep(components(left), "components")), "inner")
        if inner.isEmpty():
            break
        gone.append(keep(_turn(inner), "turn"))
        left = inner.select("src", "ref").join(gone[-1], ["src", "ref"], "left_anti")
    removed = reduce(DataFrame.union, gone).select(F.col("src").alias("_src"), F.col("ref").alias("_ref"))
    same = (F.col("src").cast("string") == F.col("_src")) & (F.col("ref").cast("string") == F.col("_ref"))
    return edges.join(removed, same, "left_semi")


def load_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``dependency_levels`` without the edges of ``break_edges``; defined for every graph.

    Cycles are only searched, in the edges that are left over, when the first pass does not end.
    """
    pairs = keep(_pairs(edges), "edges")
    levels, left = _peel(pairs, nodes)
    if left.isEmpty():
        return levels
    broken = keep(break_edges(left), "broken")
    every = pairs.select(F.col("src").alias("node")).union(pairs.select("ref"))
    kept = keep(pairs.join(broken, ["src", "ref"], "left_anti"), "edges")
    return _peel(kept, every if nodes is None else every.union(nodes.select("node")))[0]
