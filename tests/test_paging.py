"""Row numbers, pages and running totals, also with hot keys and exact copies."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from snapforge.operators import paging
from snapforge.operators.paging import (
    number_rows,
    page_number,
    page_size,
    partition_offsets,
    rank_range,
    read_page,
    row_sequence,
    running_totals,
    snapshot_totals,
    with_position,
    sort_order,
    POSITION,
    part_of,
)
from snapforge.session import local_frame


@pytest.mark.parametrize("rows, size", [(0, 1000), (999, 1000), (10_000, 1000), (10_001, 1001), (60_000, 6000), (999_999, 100_000), (10**12, 100_000)])
def test_page_size(spark, rows, size):
    assert spark.range(1).select(page_size(F.lit(rows))).head()[0] == size


@pytest.mark.parametrize("rows, pages", [(0, 1), (999, 1), (1000, 2), (1500, 2), (10_000, 11)])
def test_total_pages_count_the_last_empty_page(spark, rows, pages):
    assert snapshot_totals({"t": spark.range(rows)}).head()["total_pages"] == pages


def numbers(df, column="row_num"):
    return sorted(r[0] for r in df.select(column).collect())


def test_numbers_are_complete_with_a_hot_key_and_copies(spark):
    # A third of the rows are exact copies, another third shares the key.
    df = spark.range(9_000).select(
        F.when(F.col("id") < 3_000, 5).when(F.col("id") < 6_000, 7).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 3_000, "copy").otherwise(F.concat(F.lit("v"), "id")).alias("v"),
    )
    out = number_rows(df, ["k"])
    assert numbers(out) == list(range(1, 9_001))
    wrong = out.select("k", F.lag("k").over(Window.orderBy("row_num")).alias("before")).filter("before > k")
    assert wrong.isEmpty()
    assert out.groupBy("k", "v").count().exceptAll(df.groupBy("k", "v").count()).isEmpty()


def test_hot_key_and_copies_fill_several_partitions(spark):
    hot = spark.range(8_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    copies = spark.range(8_000).select(F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("v"))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # these partitions are so small that they would be merged
    try:
        for df in (hot, copies):
            spread = with_position(df, sort_order(df, ["k"])).groupBy(part_of(F.col(POSITION))).count()
            assert spread.count() > 3
            assert spread.agg(F.max("count")).head()[0] < 4_000
    finally:
        spark.conf.unset(merge)


def test_empty_table(spark):
    assert page_number(spark.range(0)).count() == 0
    assert read_page(spark.range(0), 0, 10).count() == 0
    assert partition_offsets(with_position(spark.range(0), [F.col("id").asc()])).count() == 0


def test_pages_cover_the_table_once(spark):
    df = spark.range(1_234).select((F.col("id") * 7 % 1_234).alias("id"))
    seen = []
    for page in range(4):
        rows = [r["id"] for r in read_page(df, page, 400, ["id"]).orderBy("row_num").collect()]
        assert rows == list(range(page * 400, min(1_234, (page + 1) * 400)))
        seen += rows
    assert len(seen) == 1_234
    assert read_page(df, 4, 400, ["id"]).count() == 0


def test_page_numbers_follow_the_size(spark):
    out = page_number(spark.range(2_500), ["id"])
    assert {(r["page_num"], r["count"]) for r in out.groupBy("page_num").count().collect()} == {(0, 1000), (1, 1000), (2, 500)}


def test_nulls(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "k int")
    last = [r["k"] for r in number_rows(df, ["k"]).orderBy("row_num").collect()]
    first = [r["k"] for r in number_rows(df, ["k"], "first").orderBy("row_num").collect()]
    assert last == [1, 2, None] and first == [None, 1, 2]
    with pytest.raises(ValueError):
        number_rows(df, ["k"], "middle")


def test_unorderable_columns(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 2})], "k int, m map<string,int>")
    assert numbers(row_sequence(df), "row_key") == [1, 2]


def test_running_totals_with_a_hot_group(spark):
    df = spark.range(6_000).select(
        F.when(F.col("id") < 4_000, "hot").when(F.col("id") < 4_500, None).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.col("id"), (F.col("id") % 13).alias("v"),
    )
    out = running_totals(df, ["g"], [F.desc("id")], "v")
    w = Window.partitionBy("g").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "id", "v", F.row_number().over(w).cast("bigint").alias("rank"), F.sum("v").over(w).alias("running"))
    assert out.exceptAll(want).isEmpty() and out.count() == 6_000


def test_numbering_has_no_global_window_over_rows(spark):
    plan = number_rows(spark.range(100))._jdf.queryExecution().executedPlan().toString()
    # The only single-partition exchange carries the counts per partition.
    assert plan.count("SinglePartition") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sample_of_wide_keys_is_bounded(spark, monkeypatch):
    """A budget for a few keys leaves fewer partitions and samples; the numbering is the same."""
    import snapforge.operators.paging as paging

    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    df = spark.range(0, 500, 1, 8).select(F.format_string("%0500d", F.col("id") * 7 % 500).alias("k"), F.lit(None).cast("string").alias("v"))
    seen = []

    def write(rows):
        seen.append((spark.conf.get(key), rows.rdd.getNumPartitions()))
        return paging.keep(rows, "seen")

    for budget in (3 * 516 * 4, 3 * 516 * 40, 1 << 30):
        monkeypatch.setattr(paging, "SAMPLE_BYTES", budget)
        kept = paging.write_ranged(df, sort_order(df, None), df.columns, write)
        numbers = [r[0] for r in paging.number_positioned(kept).orderBy("k").select("row_num").collect()]
        assert numbers == list(range(1, 501))
    assert [s for s, _ in seen] == ["1", "5", "100"]
    assert seen[0][1] == 4
    assert spark.conf.get(key) == "100"


@pytest.mark.parametrize("nulls", ["last", "first"])
def test_page_selection(spark, monkeypatch, nulls):
    """Pages found by counting, on keys with ties, nulls, texts and rows that repeat, equal the slice of the sorted table."""
    monkeypatch.setattr(paging, "SPLITTERS", 4)
    rows = [(i * 37 % 50 if i % 4 else None, f"v{i % 7}", i) for i in range(400)] + [(7, "same", 1)] * 150
    df = local_frame(spark, rows, "k int, v string, n int")

    def place(r):
        absent = (r[0] is None) if nulls == "last" else (r[0] is not None)
        return (absent, r[0] or 0, r[1])

    ranked = sorted(rows, key=place)
    for page, size in ((0, 30), (5, 40), (13, 40), (99, 10)):
        got = sorted(read_page(df, page, size, ["k", "v"], nulls, most=20).collect(), key=lambda r: r.row_num)
        want = ranked[page * size : (page + 1) * size]
        assert [place(r) for r in got] == [place(r) for r in want] and [r.row_num for r in got] == list(range(page * size + 1, page * size + len(want) + 1))
    held, before = rank_range(df, 100, 110, ["k", "v"], nulls, most=20)
    assert held.count() < 300 and before <= 100
    assert "RepartitionByExpression" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert read_page(df.limit(0), 0, 5, ["k"]).count() == 0
