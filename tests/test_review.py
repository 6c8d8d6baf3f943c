"""Cases of the review: overlapping cycles, vendor check texts, defaults, failed and cleared versions, numbering of joined inputs."""

import pytest
from pyspark.sql import functions as F

from snapforge.catalog import Catalog, Column, ForeignKey
from snapforge.operators.evolve import ColumnOp, evolve_table
from snapforge.operators.graph import break_edges, load_order
from snapforge.operators.integrity import check_predicate, check_violations, violation_report
from snapforge.operators.paging import page_number, row_sequence
from snapforge.session import local_frame, range_partitions, reads_files_only
from snapforge.sinks.restore import JdbcTarget, clear_tables, restore_all
from snapforge.sinks.snapshots import Storage, clear_version, write_catalog, write_snapshot
from snapforge.sources.tables import JdbcSource
from snapforge.sources.vendor_catalogs import standard_constraints
from snapforge.sources.snapshots import read_manifest, read_stored_catalog, version_path


@pytest.mark.parametrize("names", ["rab", "bra", "abr"])
def test_shared_edge_of_two_cycles(spark, names):
    r, a, b = names
    pairs = [(r, a), (r, b), (b, a), (a, r)]
    edges = local_frame(spark, pairs, "src string, ref string")
    assert [tuple(x) for x in break_edges(edges).collect()] == [(a, r)]
    level = {x["node"]: x["level"] for x in load_order(edges).collect()}
    assert level == {a: 0, b: 1, r: 2}


def kept(spark, condef, values):
    df = local_frame(spark, [(v,) for v in values], "s string")
    broken = {x["s"] for x in check_violations(df, check_predicate(condef)).collect()}
    return [v for v in values if v not in broken]


@pytest.mark.parametrize(
    ("condef", "fits"),
    [
        ("CHECK ((s = ANY (ARRAY['a'::text, 'x::y'::text])))", ["a", "x::y", None]),
        ("CHECK (((s)::text = ANY ((ARRAY['a'::character varying, 'b'::character varying])::text[])))", ["a", None]),
        ("CHECK (s <> ALL (ARRAY['a'::text]))", ["x", "x::y", "it's", "a\\b", None]),
        ("CHECK (s <> 'x::y')", ["a", "x", "it's", "a\\b", None]),
        ("CHECK (s = 'it''s')", ["it's", None]),
        ("CHECK (s = 'a\\b')", ["a\\b", None]),
        ('CHECK ("s" = \'a\')', ["a", None]),
        ("([s]='a')", ["a", None]),
    ],
)
def test_check_texts(spark, condef, fits):
    assert kept(spark, condef, ["a", "x", "x::y", "it's", "a\\b", None]) == fits


def test_number_in_brackets(spark):
    df = local_frame(spark, [(1,), (-1,), (None,)], "n int")
    assert [x["n"] for x in check_violations(df, check_predicate("([n]>=(0))")).collect()] == [-1]


def test_check_that_is_not_translated_is_reported(spark):
    df = local_frame(spark, [(1,), (-1,)], "n int")
    catalog = Catalog.of(
        spark, columns=[Column("s", "t", "n", "int")], checks=[("s", "t", "good", "CHECK (n > 0)"), ("s", "t", "odd", "CHECK (n @> '{1}'::jsonb)")]
    )
    got = {(x["rule"], x["constraint"], x["violations"]) for x in violation_report({"s.t": df}, catalog).collect()}
    assert got == {("check", "good", 1), ("check not translated", "odd", None)}


@pytest.mark.parametrize(
    ("kind", "default", "want"),
    [
        ("text", "'10::20'::text", "10::20"),
        ("varchar", "('abc')", "abc"),
        ("varchar", "(N'it''s')", "it's"),
        ("int", "((7))", 7),
        ("int", "'7'::integer", 7),
        ("int", "NULL::integer", None),
        ("varchar", "abc", "abc"),
    ],
)
def test_defaults(spark, kind, default, want):
    out, results = evolve_table(local_frame(spark, [(1,)], "id int"), [ColumnOp("CREATE", "c", kind, default=default)])
    assert results[0].ok and out.head()["c"] == want


@pytest.mark.parametrize("default", ["CURRENT_TIMESTAMP", "CURRENT_TIMESTAMP(6)", "(getdate())", "now()"])
def test_clock_defaults(spark, default):
    out, results = evolve_table(local_frame(spark, [(1,)], "id int"), [ColumnOp("CREATE", "c", "timestamp", default=default)])
    assert results[0].ok and out.head()["c"] is not None


@pytest.mark.parametrize(("kind", "default"), [("int", "nextval('s'::regclass)"), ("int", "'abc'"), ("int", "abc")])
def test_defaults_that_fail_are_outcomes(spark, kind, default):
    df = local_frame(spark, [(1,)], "id int")
    out, results = evolve_table(df, [ColumnOp("CREATE", "c", kind, default=default), ColumnOp("CREATE", "d", "int", default="1")])
    assert [r.ok for r in results] == [False, True]
    assert out.collect() == [(1, 1)]


def test_failed_version_leaves_nothing(spark, root):
    import os

    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    storage = Storage("disk", root)
    with pytest.raises(Exception, match="no"):
        write_snapshot({"good": spark.range(3), "bad": bad}, storage, "d", 1)
    assert not os.path.exists(version_path(root, "d", 1))
    assert write_snapshot({"good": spark.range(3)}, storage, "d", 1).count() == 1
    with pytest.raises(FileExistsError):
        write_snapshot({"good": spark.range(3)}, storage, "d", 1)
    assert read_manifest(spark, root).count() == 1


def test_cleared_version_has_catalog_and_tags(spark, root):
    storage = Storage("disk", root)
    write_snapshot({"s.t": spark.range(3)}, storage, "d", 1, tags={"env": "test"})
    write_catalog(Catalog.of(spark, columns=[Column("s", "t", "id", "bigint")]), storage, "d", 1)
    rows = clear_version(spark, storage, "d", 1).collect()
    assert [r["tags"] for r in rows] == [{"env": "test"}]
    assert read_stored_catalog(spark, root, "d", 2).columns.count() == 1


def test_capacity_without_manifest(spark, root):
    storage = Storage("disk", root, record=False, capacity=6_000)
    with pytest.raises(ValueError, match="capacity"):
        for version in range(10):
            write_snapshot({"t": spark.range(100)}, storage, "d", version)


def test_joined_and_python_inputs_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(2_000).mapInPandas(count, "id long")
    assert not reads_files_only(df)
    assert page_number(df, ["id"], size=100).agg(F.max("page_num")).head()[0] == 19
    assert seen.value == 2_000
    joined = spark.range(500).join(spark.range(500).withColumnRenamed("id", "k"), F.col("id") == F.col("k"))
    assert not reads_files_only(joined)
    assert row_sequence(joined).agg(F.max("row_key")).head()[0] == 500
    rdd = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(300)], 3), "x int")
    assert not reads_files_only(rdd) and range_partitions(spark.range(10)) is None


def test_database_targets_refuse_before_the_first_change(spark):
    """No connection is opened: the address has no driver."""
    columns = [Column("s", "child", "id", "int", identity=True), Column("s", "parent", "id", "int")]
    keys = [ForeignKey("fk", "s", "child", ("id",), "s", "parent", ("id",))]
    catalog = Catalog.of(spark, columns=columns, foreign_keys=keys)
    target = JdbcTarget(JdbcSource("jdbc:none", "SQLSERVER"))
    with pytest.raises(ValueError, match="s.parent"):
        clear_tables(target, catalog)
    with pytest.raises(ValueError, match="identity values.*s.child"):
        restore_all({}, catalog, target)


def test_standard_views_without_targets_are_an_error(spark):
    usage = local_frame(spark, [("s", "s", "t", "fk", "a", 1)], "constraint_schema string, table_schema string, table_name string, constraint_name string, column_name string, ordinal_position int")
    kinds = local_frame(spark, [("s", "s", "t", "fk", "FOREIGN KEY")], "constraint_schema string, table_schema string, table_name string, constraint_name string, constraint_type string")
    with pytest.raises(ValueError, match="do not say"):
        standard_constraints(kinds, usage, None)
