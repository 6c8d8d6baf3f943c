"""Foreign-key graphs of the model tests, and larger ones against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from snapforge.catalog import Catalog, Column, ForeignKey, validate_fk_catalog
from snapforge.operators import graph
from snapforge.operators.graph import (
    break_edges,
    catalog_edges,
    components,
    cycle_edges,
    dependency_levels,
    load_order,
    reachability,
)
from snapforge.session import local_frame
from snapforge.sinks.restore import table_levels


def edges(spark, pairs):
    return local_frame(spark, [(a, b, f"fk_{i}") for i, (a, b) in enumerate(pairs)], "src string, ref string, constraint string")


def pairs_of(df):
    return sorted((r["src"], r["ref"]) for r in df.collect())


def levels_of(df):
    return {r["node"]: r["level"] for r in df.collect()}


def catalog(spark, tables, fks):
    return Catalog.of(
        spark,
        columns=[Column("s", t, c, "bigint") for t, cols in tables.items() for c in cols],
        foreign_keys=[
            ForeignKey(f"fk{i}", "s", a, (ac,), "s", b, (bc,)) for i, (a, ac, b, bc) in enumerate(fks)
        ],
    )


def test_tables_without_references(spark):
    c = catalog(spark, {"T1": ["a", "b"], "T2": ["a", "b", "c"]}, [])
    assert table_levels(c) == [["s.T1", "s.T2"]]


def test_one_reference(spark):
    c = catalog(spark, {"T1": ["c1", "c2"], "T2": ["c1", "c2", "c3"]}, [("T2", "c2", "T1", "c1")])
    assert validate_fk_catalog(c).isEmpty()
    assert table_levels(c) == [["s.T1"], ["s.T2"]]


def test_chain(spark):
    c = catalog(
        spark, {"T1": ["c1", "c2"], "T2": ["ac1", "ac2"], "T3": ["bc1", "bc2", "bc3"]},
        [("T2", "ac2", "T1", "c2"), ("T3", "bc2", "T2", "ac2")],
    )
    assert table_levels(c) == [["s.T1"], ["s.T2"], ["s.T3"]]


def test_many_references(spark):
    pairs = [("R3", "R1"), ("F1", "R1"), ("F1", "R2"), ("F2", "F1"), ("F2", "R3")] + [("F3", f"R{i}") for i in range(1, 5)]
    extra = local_frame(spark, [("F4",)], "node string")
    level = levels_of(dependency_levels(edges(spark, pairs), extra))
    assert len(level) == 8
    assert all(level[a] > level[b] for a, b in pairs)
    assert level["F4"] == 0


@pytest.mark.parametrize("pairs", [[("R1", "R2")], [("R1", "R2"), ("R2", "R3")]])
def test_no_cycle(spark, pairs):
    assert cycle_edges(edges(spark, pairs)).isEmpty()
    assert break_edges(edges(spark, pairs)).isEmpty()


# The number of edges to ignore, as the model tests expect it.
CYCLES = {
    "three": ([("R1", "R2"), ("R2", "R3"), ("R3", "R1")], 1),
    "self": ([("R1", "R2"), ("R2", "R3"), ("R3", "R3")], 1),
    "two": (
        [("R1", "F3"), ("F1", "R1"), ("F1", "R2"), ("F2", "F1"), ("F2", "R3"), ("R2", "R4"), ("R3", "R1"), ("F3", "R3"), ("F3", "R2"), ("R4", "F3")],
        2,
    ),
}


@pytest.mark.parametrize("name", CYCLES)
def test_cycles(spark, name):
    pairs, expected = CYCLES[name]
    every = edges(spark, pairs)
    broken = break_edges(every)
    assert broken.columns == every.columns
    assert broken.count() == expected
    gone = set(pairs_of(broken))
    level = levels_of(load_order(every))
    assert all(level[a] > level[b] for a, b in pairs if (a, b) not in gone)


def test_cycle_is_an_error_for_levels(spark):
    with pytest.raises(ValueError, match="cycle"):
        dependency_levels(edges(spark, CYCLES["three"][0]))


def test_self_reference_is_ignored_in_levels(spark):
    assert levels_of(dependency_levels(edges(spark, CYCLES["self"][0]))) == {"R1": 2, "R2": 1, "R3": 0}


def closure(pairs):
    found = set(pairs)
    while True:
        more = {(a, d) for a, b in found for c, d in pairs if b == c} - found
        if not more:
            return found
        found |= more


@pytest.mark.parametrize("seed", [3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)})
    every = edges(spark, pairs)
    reach = closure(pairs)
    assert set(pairs_of(reachability(every))) == reach
    on_cycle = [(a, b) for a, b in pairs if (b, a) in reach or a == b]
    assert pairs_of(cycle_edges(every)) == on_cycle
    root = {r["node"]: r["root"] for r in components(every).collect()}
    for a in root:
        for b in root:
            assert (root[a] == root[b]) == (a == b or ((a, b) in reach and (b, a) in reach))
    broken = set(pairs_of(break_edges(every)))
    left = [p for p in pairs if p not in broken]
    assert not any(a == b for a, b in closure(left))
    level = levels_of(load_order(every))
    assert all(level[a] > level[b] for a, b in left)


def test_hot_parent(spark):
    # One parent holds almost all edges; no pairs of its children are built.
    star = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("src"), F.lit("hub").alias("ref"))
    back = local_frame(spark, [("hub", "c7")], "src string, ref string")
    every = star.unionByName(back)
    assert pairs_of(cycle_edges(every)) == [("c7", "hub"), ("hub", "c7")]
    level = levels_of(load_order(every))
    assert len(level) == 3001 and max(level.values()) == 2 - (level["c7"] > level["hub"])


def test_catalog_edges_are_qualified(spark):
    c = catalog(spark, {"a": ["x"], "b": ["x"]}, [("b", "x", "a", "x")])
    assert pairs_of(catalog_edges(c.foreign_keys)) == [("s.b", "s.a")]


def test_unknown_names_in_foreign_keys(spark):
    c = catalog(spark, {"a": ["x"], "b": ["x"]}, [("b", "x", "a", "nope"), ("b", "x", "gone", "x"), ("lost", "x", "a", "x")])
    rows = {(r["constraint"], r["problem"]) for r in validate_fk_catalog(c).collect()}
    assert rows == {
        ("fk0", "unknown referenced column"), ("fk1", "unknown referenced table"), ("fk2", "unknown source table"),
    }


@pytest.mark.parametrize("seed", range(3))
def test_levels_at_once_and_by_rounds_agree(spark, monkeypatch, seed):
    """Graphs with and without cycles, with isolated nodes, self references and repeated edges."""
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    frame = local_frame(spark, [p for p in pairs if seed or p[0] > p[1]] + [("n1", "n1")], "src string, ref string").distinct()
    nodes = local_frame(spark, [("alone",), ("n1",)], "node string")
    levels, left = graph._peel(frame, nodes)
    slow, slow_left = graph._peel_by_rounds(frame, nodes)
    cyclic = {r["src"] for r in slow_left.collect()}  # their levels have no meaning
    assert sorted(tuple(r) for r in levels.collect() if r["node"] not in cyclic) == sorted(tuple(r) for r in slow.collect() if r["node"] not in cyclic)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, slow_left.collect()))
    monkeypatch.setattr(graph, "AT_ONCE", 3)
    if not seed:
        assert sorted(map(tuple, dependency_levels(frame, nodes).collect())) == sorted(map(tuple, slow.collect()))


def test_a_deep_chain(spark):
    edges = spark.range(1, 5_000).selectExpr("id AS src", "id - 1 AS ref")
    assert dependency_levels(edges).filter("node = level").count() == 5_000


def test_deep_graphs_beyond_one_task(spark, monkeypatch):
    """Chains, a tree of chains, and a chain into a cycle, with more edges than one task takes: in a few rounds, not one a level."""
    monkeypatch.setattr(graph, "AT_ONCE", 100)
    rounds = []
    monkeypatch.setattr(graph, "keep", lambda df, label, keep=graph.keep: (rounds.append(label), keep(df, label))[1])
    chain = [(f"a{i}", f"a{i - 1}") for i in range(1, 1_500)]
    tree = [(f"b{i}", f"b{i - 1 if i % 100 else i // 4}") for i in range(1, 1_000)] + [("b999", "a7"), ("b1", "a1400")]
    want = {"a0": 0} | {f"a{i}": i for i in range(1, 1_500)} | {"alone": 0}
    for i in range(1_000):
        want[f"b{i}"] = max([want[r] + 1 for s, r in tree if s == f"b{i}"], default=0)
    frame = local_frame(spark, chain + tree, "src string, ref string")
    nodes = local_frame(spark, [("alone",)], "node string")
    assert levels_of(dependency_levels(frame, nodes)) == want
    assert len(rounds) < 100
    ring = [(f"c{i}", f"c{(i + 1) % 300}") for i in range(300)] + [(f"d{i}", f"d{i - 1}" if i else "c0") for i in range(300)]
    mixed = local_frame(spark, chain + ring + [("c5", "a3"), ("a0", "a-1")], "src string, ref string")
    levels, left = graph._peel(mixed)
    assert pairs_of(left) == sorted(ring)
    found = levels_of(levels)
    assert [found[f"a{i}"] for i in range(-1, 1_500)] == list(range(1_501))
    with pytest.raises(ValueError, match="cycle"):
        dependency_levels(mixed)


def test_levels_by_contraction_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 10)
    rng = random.Random(5)
    pairs = sorted({(f"n{a:03}", f"n{rng.randrange(max(0, a - 9), a):03}") for a in range(1, 300) for _ in range(rng.choice((1, 1, 1, 2)))})
    level = {"n000": 0}
    for a, b in pairs:
        level[a] = max(level.get(a, 0), level[b] + 1)
    found = graph._levels_by_contraction(local_frame(spark, pairs, "src string, ref string"))
    assert {r["node"]: r["level"] for r in found.collect()} == {k: v for k, v in level.items() if v}
    assert found.filter("stuck").isEmpty()


def test_foreign_keys_are_checked_by_distinct_names(spark, root):
    """Names that many foreign keys share meet the catalog once; repeated and null names are listed as often as they come."""
    fks = spark.range(2_000).selectExpr(
        "concat('fk', id) AS constraint", "'s' AS src_schema", "if(id < 3, 'gone', 'a') AS src_table", "array('x') AS src_columns", "'s' AS ref_schema",
        "if(id % 1000 = 7, 'lost', 'a') AS ref_table", "if(id % 1000 = 9, array('x', null, 'y', 'y'), array('x')) AS ref_columns",
    )
    fks.write.parquet(root)
    c = Catalog.of(spark, columns=[Column("s", "a", "x", "bigint")], foreign_keys=spark.read.parquet(root))
    found = validate_fk_catalog(c)
    assert sorted((r["constraint"], r["problem"].split()[-1], r["problem"].split()[1], r["qname"], str(r["column"])) for r in found.collect()) == sorted(
        [(f"fk{i}", "table", "source", "s.gone", "None") for i in range(3)]
        + [(f"fk{i}", "table", "referenced", "s.lost", "None") for i in (7, 1007)]
        + [(f"fk{i}", "column", "referenced", "s.a", x) for i in (9, 1009) for x in ("None", "y", "y")]
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 3 and "LeftAnti" not in plan  # only unknown names, written before, meet the foreign keys
