"""Masks: properties, errors, and what stays untouched."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snapforge.catalog import Catalog, Column
from snapforge.functions.masks import mask_fixed, mask_original, mask_random
from snapforge.operators.masking import Mask, MaskTarget, mask_columns, mask_table

texts = st.lists(st.one_of(st.none(), st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\0"), min_size=1, max_size=30)), max_size=20)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts, limit=st.one_of(st.none(), st.integers(1, 150)), seed=st.integers(0, 2**40))
def test_random_bounds(spark, values, limit, seed):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    masked = df.withColumn("m", mask_random(F.col("v"), "#", limit, [F.col("k")], seed))
    first, second = masked.orderBy("k").collect(), masked.orderBy("k").collect()
    assert first == second
    for row, value in zip(first, values):
        assert row["v"] == value
        if value is None:
            assert row["m"] is None
        else:
            assert set(row["m"]) == {"#"} and 1 <= len(row["m"]) <= min(100, limit or 100)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=texts)
def test_original_keeps_length_in_characters(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    got = [r["m"] for r in df.withColumn("m", mask_original(F.col("v"), "x")).orderBy("k").collect()]
    assert got == [None if v is None else "x" * len(v) for v in values]


def test_random_is_spread_evenly_and_ignores_the_value(spark):
    df = spark.range(40_000).withColumn("v", F.lit("same"))
    counts = df.select(F.length(mask_random(F.col("v"), "*", 10, [F.col("id")], 5)).alias("n")).groupBy("n").count().collect()
    assert {r["n"] for r in counts} == set(range(1, 11))
    assert all(3_600 < r["count"] < 4_400 for r in counts)


def test_random_without_key_is_in_bounds(spark):
    df = spark.range(2_000).select(F.length(mask_random(F.col("id"), "*", None)).alias("n"))
    low, high = df.agg(F.min("n"), F.max("n")).head()
    assert low >= 1 and high <= 100


def test_multi_character_mask(spark):
    assert spark.range(1).select(mask_fixed(F.col("id"), "ab", 3, 2)).head()[0] == "abab"


@pytest.mark.parametrize("length, limit", [(0, None), (5, 0), (-1, 10)])
def test_invalid_length(length, limit):
    with pytest.raises(ValueError, match="invalid mask length"):
        mask_fixed(F.lit("a"), "*", length, limit)


def test_empty_text_under_original(spark):
    df = spark.createDataFrame([("",), (None,), ("ab",)], "v string")
    with pytest.raises(PySparkException, match="invalid mask length"):
        df.select(mask_original(F.col("v"), "*")).collect()
    kept = df.select(mask_original(F.col("v"), "*", "keep")).collect()
    assert [r[0] for r in kept] == ["", None, "**"]


def test_mask_arguments():
    with pytest.raises(ValueError):
        Mask("SHUFFLE")
    with pytest.raises(ValueError):
        Mask("FIXED", "")


def people(spark):
    df = spark.createDataFrame([(1, "Ann", 10), (2, None, 20)], "id int, name string, score int")
    catalog = Catalog.of(
        spark,
        columns=[Column("hr", "people", "id", "int"), Column("hr", "people", "name", "varchar", max_length=3), Column("hr", "people", "score", "int"), Column("hr", "other", "x", "int")],
        keys=[("hr", "people", "pk", ["id"])],
    )
    return {"hr.people": df, "hr.other": spark.range(3).withColumnRenamed("id", "x")}, catalog


def test_mask_columns_touches_only_its_targets(spark):
    dfs, catalog = people(spark)
    out = mask_columns(dfs, catalog, [MaskTarget("hr", "people", "name"), MaskTarget("hr", "people", "score")], Mask("FIXED", "*", 9))
    assert out["hr.other"] is dfs["hr.other"]
    assert out["hr.people"].columns == ["id", "name", "score"]
    # The declared length of name bounds its mask, score has none; a masked number is text.
    assert [tuple(r) for r in out["hr.people"].orderBy("id").collect()] == [(1, "***", "*" * 9), (2, None, "*" * 9)]


@pytest.mark.parametrize(
    "target, error",
    [(MaskTarget("hr", "gone", "x"), "table not found"), (MaskTarget("hr", "people", "Name"), "column not found"), (MaskTarget("HR", "people", "name"), "table not found")],
)
def test_unknown_target_stops_before_any_work(spark, target, error):
    dfs, catalog = people(spark)
    with pytest.raises(ValueError, match=error):
        mask_columns(dfs, catalog, [MaskTarget("hr", "people", "name"), target], Mask("ORIGINAL"))


def test_masked_key_column_keeps_random_masks_repeatable(spark):
    df = spark.range(50).withColumn("name", F.lit("x"))
    masked = mask_table(df, {"id": None, "name": None}, Mask("RANDOM", "*", seed=1), ["id"])
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, masked.collect()))
    assert masked.select("name").distinct().count() > 5


def test_random_masks_without_key_differ_between_columns(spark):
    a, b = (mask_random(F.lit("x"), "*", 50, seed=3, salt=name) for name in ("a", "b"))
    rows = spark.range(200).select(F.length(a).alias("a"), F.length(b).alias("b")).collect()
    assert sum(r.a == r.b for r in rows) < 30
    assert {r.a for r in rows} | {r.b for r in rows} <= set(range(1, 51))
