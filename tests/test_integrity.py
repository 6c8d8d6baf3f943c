"""Violation checks on small tables, with nulls, hot keys and vendor predicates."""

import pytest
from pyspark.sql import functions as F

from snapforge.catalog import Catalog, Column
from snapforge.operators import integrity
from snapforge.operators.integrity import (
    check_predicate,
    check_violations,
    fk_violations,
    length_violations,
    not_null_violations,
    null_rows,
    orphan_keys,
    pk_violations,
    unique_violations,
    unique_violations_wide,
)
from snapforge.session import local_frame


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_primary_key(spark):
    df = local_frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None)], "k int, v string")
    assert rows(pk_violations(df, ["k", "v"])) == [(1, "a", 2, "duplicate"), (None, "a", 1, "null"), (None, None, 1, "null")]


def test_unique_with_nulls(spark):
    df = local_frame(spark, [("x", 1), ("x", 1), (None, 1), (None, 1), ("y", None), ("y", None)], "a string, b int")
    assert rows(unique_violations(df, ["a", "b"])) == [("x", 1, 2)]
    assert rows(unique_violations_wide(df, ["a", "b"])) == [("x", 1, 2)]


def test_wide_unique_with_hot_text(spark):
    long = "x" * 5_000
    df = spark.range(3_000).select(
        F.when(F.col("id") < 1_000, long).when(F.col("id") < 1_010, long + "!").otherwise(F.concat(F.lit(long), "id")).alias("t")
    )
    got = {(len(r["t"]), r["row_count"]) for r in unique_violations_wide(df, ["t"]).collect()}
    assert got == {(5_000, 1_000), (5_001, 10)}


def test_foreign_key(spark):
    child = local_frame(spark, [(1, 1, "a"), (1, 2, "b"), (None, 9, "c"), (3, None, "d"), (3, 3, "e"), (3, 3, "f")], "a int, b int, v string")
    parent = local_frame(spark, [(1, 1), (2, 2)], "x int, y int")
    assert rows(orphan_keys(child, parent, ["a", "b"], ["x", "y"])) == [(1, 2, 1), (3, 3, 2)]
    assert sorted(r["v"] for r in fk_violations(child, parent, ["a", "b"], ["x", "y"]).collect()) == ["b", "e", "f"]


def test_foreign_key_to_itself(spark):
    df = local_frame(spark, [(1, None), (2, 1), (3, 8)], "id int, parent int")
    assert rows(fk_violations(df, df, ["parent"], ["id"])) == [(3, 8)]


def test_few_orphan_keys_do_not_shuffle_the_child(spark):
    child = spark.range(100_000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    parent = spark.range(90).withColumnRenamed("id", "k")
    found = fk_violations(child, parent, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert found.count() == 10_000


def test_keys_are_combined_before_the_shuffle(spark, folder):
    line = spark.read.parquet(f"{folder}/lineitem.parquet")
    plan = pk_violations(line, ["l_orderkey", "l_linenumber"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("hashpartitioning") > plan.index("functions=[count(1)]")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_check(spark):
    df = local_frame(spark, [(1,), (-1,), (None,)], "a int")
    assert rows(check_violations(df, "a > 0")) == [(-1,)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("CHECK ((amount > 0))", "(amount > 0)"),
        ("check (a > 0) NOT VALID", "a > 0"),
        ("((status)::text = 'new'::text)", "((status) = 'new')"),
        ("regexp_like(`code`,_utf8mb4\\'^[A-Z]+$\\')", "regexp_like(`code`,'^[A-Z]+$')"),
        ("(kind = ANY (ARRAY['a'::character varying]))", "(kind IN ('a'))"),
        ("price > 0", "price > 0"),
    ],
)
def test_check_predicate(text, want):
    assert check_predicate(text) == want


def test_vendor_check_runs(spark):
    df = local_frame(spark, [("AB",), ("x1",)], "code string")
    assert rows(check_violations(df, check_predicate("regexp_like(`code`,_utf8mb4\\'^[A-Z]+$\\')"))) == [("x1",)]


def test_not_null(spark):
    df = local_frame(spark, [(1, None), (None, None), (3, 3)], "a int, b int")
    assert rows(not_null_violations(df, ["a", "b"])) == [("a", 1), ("b", 2)]
    assert rows(null_rows(df, ["a"])) == [(None, None)]


def test_length(spark):
    df = local_frame(spark, [(1, "abcd", b"12345", 99.99), (2, "abc", b"1", 100.0), (3, None, None, None)], "id int, t string, b binary, n double")
    catalog = Catalog.of(
        spark,
        columns=[
            Column("s", "t", "t", "varchar", max_length=3), Column("s", "t", "b", "varbinary", max_length=4),
            Column("s", "t", "n", "numeric", num_precision=4, num_scale=2), Column("s", "t", "absent", "varchar", max_length=1),
        ],
    )
    got = {(r["id"], tuple(r["violations"])) for r in length_violations(df, catalog.columns).collect()}
    assert got == {(1, ("t", "b")), (2, ("n",))}


def test_all_keys_of_a_table_in_one_scan(spark):
    """Keys that share columns, one with a dotted name, nulls and repeated values; counts equal those of the single checks."""
    df = local_frame(spark, [(i % 5 if i % 4 else None, i % 3, "x" if i < 6 else None) for i in range(20)], "a int, b int, `c.d` string")
    keys = [("primary key", "pk", ["b", "a"]), ("unique", "u1", ["a"]), ("unique", "u2", ["c.d"]), ("unique", "u3", ["a", "b"]), ("primary key", "p2", ["a", "b"])]
    report = integrity._key_rules(df, "t", keys)
    single = {"primary key": pk_violations, "unique": unique_violations}
    assert {(r.constraint, r.violations) for r in report.collect()} == {(n, single[rule](df, cols).count()) for rule, n, cols in keys}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    assert {r.violations for r in integrity._key_rules(df.limit(0), "t", keys).collect()} == {0}
