"""Numbering rows in key order, pages, and running totals, without a global window.

Rows are range partitioned by the sort key and written once, each with a position number that is
unique and ordered. Counting the positions per partition and adding the counts of the partitions
before gives the global row number. The only data that leaves the partitioned form is one count
per range partition.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from snapforge.session import SAMPLE_BYTES, SHUFFLE_KEY, keep, local_frame, range_partitions, range_samples, reads_files_only

Result = TypeVar("Result")

# Paging limits.
PAGES_PER_TABLE = 10
MAX_ROWS_PER_PAGE = 100_000
DEFAULT_BATCH = 1_000
# Rows that are sorted to read a page, besides its own, and cuts of a range in one round of the selection.
SELECT_ROWS = 200_000
SPLITTERS = 32

POSITION = "_seq"
# monotonically_increasing_id puts the partition above bit 33 and the row position below.
_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def page_size(rows: Column, batch: int = DEFAULT_BATCH) -> Column:
    """Rows per page: a tenth of the table, at least ``batch``, at most 100,000."""
    tenth = F.ceil(rows / F.lit(float(PAGES_PER_TABLE)))
    return F.least(F.lit(MAX_ROWS_PER_PAGE), F.greatest(F.lit(batch), tenth)).cast("bigint")


def snapshot_totals(dfs: dict[str, DataFrame], batch: int = DEFAULT_BATCH) -> DataFrame:
    """Rows, page size and pages per table.

    Paging stops after a page that is not full, and that page counts even when it is empty, so
    there are floor(rows / size) + 1 pages.
    """
    if not dfs:
        raise ValueError("no tables")
    spark = next(iter(dfs.values())).sparkSession
    # All tables are counted in one stage; the zero keeps tables without rows in the result.
    ones = local_frame(spark, [(t, 0) for t in dfs], "table string, n bigint")
    for table, df in dfs.items():
        ones = ones.unionByName(df.select(F.lit(table).alias("table"), F.lit(1).cast("bigint").alias("n")))
    totals = ones.groupBy("table").agg(F.sum("n").alias("total_records"))
    sized = totals.withColumn("page_size", page_size(F.col("total_records"), batch))
    return sized.withColumn("total_pages", F.expr("total_records div page_size") + 1)


def _sort_key(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    # Maps and variants have no order of their own.
    return F.to_json(col) if isinstance(field.dataType, (T.MapType, T.VariantType)) else col


def sort_order(df: DataFrame, order: list[str] | None, nulls: str = "last") -> list[Column]:
    """Sort columns: the key, or all columns in declared order; ``nulls`` is 'last' or 'first'."""
    if nulls not in ("last", "first"):
        raise ValueError("nulls must be 'last' or 'first'")
    keys = [_sort_key(df.schema[name]) for name in order or df.columns]
    return [k.asc_nulls_last() if nulls == "last" else k.asc_nulls_first() for k in keys]


def _ranged_input(df: DataFrame) -> DataFrame:
    """``df``, written once where it is more than a scan of files.

    A range shuffle reads its input twice, the first time for a sample. So a join, a database table,
    an RDD or Python code is written once, unordered, to the scratch folder; from there the second
    read is cheap and the size is known.
    """
    return df if reads_files_only(df) else keep(df, "input")


def _key_bytes(df: DataFrame, names: list[str]) -> int:
    """Mean bytes of the columns ``names`` and the two spreading numbers in one row.

    Runs a job over the columns of variable length only, and none if there are none.
    """
    width, parts = 16, []
    for name in names:
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(col))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            parts.append(F.octet_length(F.to_json(col)))
        else:
            width += kind.precision // 2 + 1 if isinstance(kind, T.DecimalType) else 8
    if parts:
        total = parts[0] * 0
        for part in parts:
            total = total + F.coalesce(part, F.lit(0))
        width += int(df.agg(F.avg(F.coalesce(total, F.lit(0)))).head()[0] or 0)
    return width


def with_position(df: DataFrame, sort: list[Column], n: int | None = None) -> DataFrame:
    """Range partition and sort ``df`` and add the position column; ``n`` partitions, or the session's number.

    Rows with equal keys are spread by a hash of the whole row and exact copies by a random
    number, so that a key or a row that makes up a large part of the table fills many partitions
    and not one. The random number is seeded per partition: over files a repeated task draws the
    same numbers; over an input without fixed order the session's shuffle checksums make readers
    of a repeated task run again (see ``build_session``).
    """
    columns = [_sort_key(f) for f in df.schema.fields]
    by = [*sort, F.col("_tie"), F.col("_copy")]
    return (
        df.withColumn("_tie", F.xxhash64(*columns))
        .withColumn("_copy", F.rand(17))
        .repartitionByRange(*([n, *by] if n else by))
        .sortWithinPartitions(*sort, F.col("_tie"))
        .drop("_tie", "_copy")
        .withColumn(POSITION, F.monotonically_increasing_id())
    )


def write_ranged(df: DataFrame, sort: list[Column], names: list[str], write: Callable[[DataFrame], Result]) -> Result:
    """Hand the positioned rows to ``write``, which has to run them; ``names`` are the key's columns.

    The sample that a range shuffle sends to the driver is kept within ``SAMPLE_BYTES``: wide keys
    get fewer samples per partition, and when one is too many, fewer and longer partitions, which
    the sort spills. All rows go on whatever the sample is.
    """
    df = _ranged_input(df)
    n = range_partitions(df)
    now = n or int(df.sparkSession.conf.get(SHUFFLE_KEY))
    # The planner samples three rows for each one asked for.
    most = max(1, SAMPLE_BYTES // (3 * _key_bytes(df, names)))
    if most < now:
        n = now = most
    with range_samples(df.sparkSession, most // now):
        return write(with_position(df, sort, n))


def _keep_positioned(df: DataFrame, sort: list[Column], names: list[str] | None, label: str) -> DataFrame:
    return write_ranged(df, sort, names or df.columns, lambda rows: keep(rows, label))


def part_of(position: Column) -> Column:
    return F.shiftright(position, _POSITION_BITS)


def partition_offsets(positioned: DataFrame) -> DataFrame:
    """Rows before each range partition: ``_part``, ``_rows``, ``_before``.

    One row per range partition, so the unpartitioned window below runs over a handful of rows
    whatever the size of the table.
    """
    counts = positioned.groupBy(part_of(F.col(POSITION)).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def number_positioned(
    positioned: DataFrame, name: str = "row_num", start: int = 1, offsets: DataFrame | None = None
) -> DataFrame:
    """Replace the position column by the global row number.

    The broadcast side has one row per range partition, of which there are ``MAX_PARTITIONS`` at
    most (or the session's number of shuffle partitions).
    """
    offsets = partition_offsets(positioned) if offsets is None else offsets
    position = F.col(POSITION)
    return (
        positioned.withColumn("_part", part_of(position))
        .join(F.broadcast(offsets.select("_part", "_before")), "_part")
        .withColumn(name, position.bitwiseAND(F.lit(_POSITION_MASK)) + F.col("_before") + F.lit(start))
        .drop("_part", "_before", POSITION)
    )


def number_rows(
    df: DataFrame, order: list[str] | None = None, nulls: str = "last", name: str = "row_num", start: int = 1
) -> DataFrame:
    """Consecutive row numbers in sort order."""
    return number_positioned(_keep_positioned(df, sort_order(df, order, nulls), order, "numbered"), name, start)


def row_sequence(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Running key 1..n for a table without primary key, in the order of all its columns."""
    return number_rows(df, None, name=name)


def page_number(
    df: DataFrame,
    order: list[str] | None = None,
    size: int | None = None,
    nulls: str = "last",
    batch: int = DEFAULT_BATCH,
) -> DataFrame:
    """Add ``page_num`` from 0, and ``row_num``; ``size`` defaults to ``page_size`` of the table."""
    positioned = _keep_positioned(df, sort_order(df, order, nulls), order, "paged")
    if size is None:
        size = positioned.agg(page_size(F.count(F.lit(1)), batch)).head()[0]
    numbered = number_positioned(positioned)
    return numbered.withColumn("page_num", F.expr(f"(row_num - 1) div {int(size)}L"))


def _ordered_key(df: DataFrame, order: list[str] | None, nulls: str) -> Column:
    """The place of a row in key order as one value: the keys with their null placement, then a hash of the row."""
    fields: list[Column] = []
    for i, name in enumerate(order or df.columns):
        key = _sort_key(df.schema[name])
        fields += [(key.isNull() if nulls == "last" else key.isNotNull()).alias(f"n{i}"), key.alias(f"k{i}")]
    return F.struct(*fields, F.xxhash64(*[_sort_key(f) for f in df.schema.fields]).alias("tie"))


def _first_key_between(df: DataFrame, name: str, low, high) -> Column:
    """A condition on the first key alone, which a scan can use to skip files and row groups."""
    if not isinstance(df.schema[name].dataType, (T.IntegralType, T.StringType, T.DecimalType, T.DateType)):
        return F.lit(True)
    col, inside = F.col(f"`{name}`"), F.lit(True)
    if low is not None:
        inside = inside & (col >= F.lit(low))
    return inside & (col <= F.lit(high)) if high is not None else inside


def rank_range(
    df: DataFrame, first: int, last: int, order: list[str] | None = None, nulls: str = "last", most: int = SELECT_ROWS
) -> tuple[DataFrame, int]:
    """Rows of ``df`` that hold all with a rank from ``first`` to ``last`` (from 0) in key order, and the rank of the first of them.

    No row is shuffled: each round takes a sample of the keys in the range so far, ``SPLITTERS`` of them cut it, the rows
    between two neighbours are counted, and the parts that the ranks lie in are the next range. It ends when a range has
    at most ``most`` rows besides those asked for, or is made of equal keys that nothing can cut (equal rows).
    """
    if nulls not in ("last", "first"):
        raise ValueError("nulls must be 'last' or 'first'")
    key = _ordered_key(df, order, nulls)
    head = (order or df.columns)[0]
    held, before, rows, low, high = df, 0, df.count(), None, None
    goal = max(most, last - first + 1)
    while rows > goal + most and first < before + rows:
        share = min(1.0, 40 * SPLITTERS / rows)
        keys = held.select(key.alias("key")).sample(share, 23)
        places = F.transform(F.sequence(F.lit(1), F.lit(SPLITTERS)), lambda i: F.floor(i * F.size("keys") / (SPLITTERS + 1)).cast("int"))
        cut = F.array_distinct(F.transform(F.filter(places, lambda p: p < F.size("keys")), lambda p: F.get("keys", p)))
        cuts = keep(keys.agg(F.sort_array(F.collect_list("key")).alias("keys")).select(cut.alias("cuts")), "splitters")
        beside = held.select(key.alias("key"), cuts.scalar().alias("cuts"))
        part = F.size(F.filter("cuts", lambda c: c <= F.col("key"))).alias("part")
        counts = {r["part"]: r["n"] for r in beside.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
        ahead, chosen = before, []
        for p in sorted(counts):
            if ahead <= last and ahead + counts[p] > first:
                chosen.append((p, ahead, counts[p]))
            ahead += counts[p]
        if not chosen or sum(c[2] for c in chosen) == rows:
            break
        before, rows = chosen[0][1], sum(c[2] for c in chosen)
        # Part p holds the keys from cut p on (counted from 1) and before cut p + 1.
        ends = cuts.select(F.get("cuts", F.lit(chosen[0][0] - 1)).alias("low"), F.get("cuts", F.lit(chosen[-1][0])).alias("high"))
        edge = ends.select(F.col("low.k0").alias("low"), F.col("high.k0").alias("high"), F.col("high").isNotNull().alias("cut")).head()
        if chosen[0][0]:
            held, low = held.filter(key >= ends.select("low").scalar()), edge["low"]
        if edge["cut"]:
            held, high = held.filter(key < ends.select("high").scalar()), edge["high"]
        # Where the end that nulls stand at has a value, there are no nulls in the range.
        if (high if nulls == "last" else low) is not None:
            held = held.filter(_first_key_between(df, head, low, high))
    return held, before


def read_page(
    df: DataFrame, page: int, size: int, order: list[str] | None = None, nulls: str = "last", most: int = SELECT_ROWS
) -> DataFrame:
    """Rows of one page in key order, with their ``row_num``.

    The table is not sorted: ``rank_range`` finds the part of it that holds the page, and only that is numbered. The
    passes that find it run when this is called; each reads the key columns (all columns, for the hash that settles ties)
    and returns a few counts.
    """
    first, last = page * size, (page + 1) * size - 1
    held, before = rank_range(df, first, last, order, nulls, most)
    return number_rows(held, order, nulls, start=before + 1).filter(F.col("row_num").between(first + 1, last + 1))


def page_of(positioned: DataFrame, page: int, size: int, offsets: DataFrame | None = None) -> DataFrame:
    """Rows of one page of a positioned table.

    The first and last position of the page are looked up in the partition offsets (two numbers
    reach the driver), and the read is a range filter on a sorted column, which skips all row
    groups outside the page.
    """
    first, last = page * size, (page + 1) * size - 1
    offsets = partition_offsets(positioned) if offsets is None else offsets
    touched = offsets.filter((F.col("_before") <= last) & (F.col("_before") + F.col("_rows") > first))
    part = F.shiftleft(F.col("_part"), _POSITION_BITS)
    bounds = touched.agg(
        F.min(part + F.greatest(F.lit(first) - F.col("_before"), F.lit(0))).alias("low"),
        F.max(part + F.least(F.lit(last) - F.col("_before"), F.col("_rows") - 1)).alias("high"),
    ).head()
    inside = F.lit(False) if bounds["low"] is None else F.col(POSITION).between(bounds["low"], bounds["high"])
    return number_positioned(positioned.filter(inside), offsets=offsets)


def running_totals(
    df: DataFrame, group: list[str], order: list[Column], value: str | None = None
) -> DataFrame:
    """Position ``rank`` of each row in its group and, with ``value``, the ``running`` sum.

    A group larger than one range partition is cut into several pieces: totals are taken inside
    each piece, and the totals of the pieces before are added.
    """
    sort = [F.col(g).asc_nulls_last() for g in group] + list(order)
    # The order is made of expressions over any columns, so all of them count as the key.
    positioned = _keep_positioned(df, sort, None, "running").withColumn("_part", part_of(F.col(POSITION)))
    pieces = ["_part", *group]
    inside = Window.partitionBy(*pieces).orderBy(POSITION)
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(value) if value else F.lit(0)
    local = positioned.withColumn("_rank", F.row_number().over(inside))
    if value:
        local = local.withColumn("_running", F.coalesce(F.sum(value).over(until), F.lit(0)))
    sums = positioned.groupBy(*pieces).agg(
        F.count(F.lit(1)).alias("_n"), *([F.coalesce(total, F.lit(0)).alias("_v")] if value else [])
    )
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(p).alias(f"_k{i}") for i, p in enumerate(pieces)],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_v0")] if value else []),
    )
    same = None
    for i, p in enumerate(pieces):
        eq = F.col(p).eqNullSafe(F.col(f"_k{i}"))
        same = eq if same is None else same & eq
    joined = local.join(sums, same).withColumn("rank", F.col("_rank") + F.col("_n0"))
    if value:
        joined = joined.withColumn("running", F.col("_running") + F.col("_v0"))
    return joined.select(*df.columns, "rank", *(["running"] if value else []))


def write_positioned(
    df: DataFrame,
    path: str,
    offsets_path: str,
    order: list[str] | None = None,
    nulls: str = "last",
    compression: str | None = None,
    ordered: bool = True,
) -> None:
    """Store a table with its position column, and beside it the partition offsets.

    Rows are stored in key order, or with ``ordered`` off as they come, without any shuffle.
    """

    def write(positioned: DataFrame) -> None:
        writer = positioned.write.mode("errorifexists")
        if compression:
            writer = writer.option("compression", compression)
        writer.parquet(path)

    if ordered:
        write_ranged(df, sort_order(df, order, nulls), order or df.columns, write)
    else:
        write(df.withColumn(POSITION, F.monotonically_increasing_id()))
    partition_offsets(df.sparkSession.read.parquet(path)).write.mode("errorifexists").parquet(offsets_path)


__all__ = [
    "DEFAULT_BATCH",
    "MAX_ROWS_PER_PAGE",
    "PAGES_PER_TABLE",
    "number_rows",
    "page_number",
    "page_of",
    "page_size",
    "rank_range",
    "read_page",
    "row_count",
    "row_sequence",
    "running_totals",
    "snapshot_totals",
    "write_positioned",
]
