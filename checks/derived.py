"""Large catalogs, made from the rows of the test tables.

Every row stands for one catalog object, so the work of a comparison grows with the tables. The
expressions are plain SQL that both engines read; there is a wanted and a current state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import table
from snapforge.catalog import Catalog

Exprs = list[tuple[str, str]]

COLUMNS_WANTED: Exprs = [
    ("schema", "o_orderstatus"),
    ("table", "concat('c', o_custkey)"),
    ("name", "concat('o', o_orderkey)"),
    ("ordinal", "cast(o_orderkey as int)"),
    ("data_type", "o_orderpriority"),
    ("column_type", "o_orderpriority"),
    ("max_length", "cast(month(o_orderdate) as int)"),
    ("num_precision", "cast(year(o_orderdate) as int)"),
    ("num_scale", "cast(null as int)"),
    ("column_key", "case when o_orderpriority = '1-URGENT' then 'PRI' end"),
    ("column_default", "case when o_orderstatus = 'P' then o_orderpriority end"),
    ("default_constraint", "cast(null as varchar(10))"),
    ("nullable", "o_totalprice > 250000"),
    ("identity", "o_totalprice > 400000"),
]
_CHANGED = {
    "schema": "case when o_totalprice < 20000 then 'OLD' else o_orderstatus end",
    "ordinal": "cast(0 as int)",
    "data_type": "case when o_orderpriority = '5-LOW' and o_orderdate < '1996-01-01' then '4-NOT SPECIFIED' else o_orderpriority end",
    "max_length": "case when month(o_orderdate) < 12 then cast(month(o_orderdate) as int) end",
    "column_default": "case when o_orderstatus = 'P' and o_totalprice > 100000 then o_orderpriority end",
    "nullable": "o_totalprice > 240000",
}
COLUMNS_CURRENT: Exprs = [(name, _CHANGED.get(name, expr)) for name, expr in COLUMNS_WANTED]
CURRENT_FILTER = "o_orderdate < '2000-01-01'"

# Objects of the parts: schema is the brand, table the type.
PART_TABLE: Exprs = [("schema", "p_brand"), ("table", "p_type")]
CHECKS_WANTED: Exprs = [*PART_TABLE, ("constraint", "concat('ck_', p_partkey)"), ("condef", "concat('size > ', p_size)")]
CHECKS_CURRENT: Exprs = [
    *PART_TABLE,
    ("constraint", "case when p_retailprice < 950 then concat('old_', p_partkey) else concat('ck_', p_partkey) end"),
    ("condef", "case when p_size > 40 then concat('size >= ', p_size) else concat('size > ', p_size) end"),
]
INDEXES_WANTED: Exprs = [
    *PART_TABLE, ("name", "concat('ix_', p_partkey)"), ("unique", "p_size > 25"), ("type", "p_name"),
    ("columns", "array[p_brand, p_type]"), ("extra_columns", "array[p_name]"),
]
INDEXES_CURRENT: Exprs = [
    *PART_TABLE, ("name", "case when p_retailprice < 950 then concat('old_', p_partkey) else concat('ix_', p_partkey) end"),
    ("unique", "p_size > 20"), ("type", "p_name"),
    ("columns", "case when p_size > 45 then array[p_type, p_brand] else array[p_brand, p_type] end"),
    ("extra_columns", "array[p_name]"),
]
UNIQUES_WANTED: Exprs = [*PART_TABLE, ("constraint", "concat('uk_', p_partkey)"), ("columns", "array[p_name, p_brand]")]
UNIQUES_CURRENT: Exprs = [
    *PART_TABLE,
    ("constraint", "case when p_retailprice < 950 then concat('old_', p_partkey) else concat('uk_', p_partkey) end"),
    ("columns", "case when p_size > 45 then array[p_brand, p_name] else array[p_name, p_brand] end"),
]
PARTS_CURRENT_FILTER = "p_size < 50"

# Foreign keys of the line items; (order, line) repeats, and then one of the rows counts.
FKS_WANTED: Exprs = [
    ("constraint", "concat('fk_', l_linenumber)"), ("src_schema", "'shop'"), ("src_table", "concat('o', l_orderkey)"),
    ("src_columns", "array[l_returnflag, l_linestatus]"), ("ref_schema", "'shop'"), ("ref_table", "concat('p', l_partkey)"),
    ("ref_columns", "array[concat('s', l_suppkey), 'k']"),
]
_FK_CHANGED = {
    "src_table": "case when l_quantity > 48 then concat('old', l_orderkey) else concat('o', l_orderkey) end",
    "src_columns": "array[l_linestatus, l_returnflag]",
    "ref_columns": "case when l_discount > 0.08 then array['k', 'other'] else array['k', concat('s', l_suppkey)] end",
}
FKS_CURRENT: Exprs = [(name, _FK_CHANGED.get(name, expr)) for name, expr in FKS_WANTED]

SEQUENCES_WANTED: Exprs = [
    ("schema", "c_mktsegment"), ("name", "concat('seq_', c_custkey)"), ("start_value", "cast(1 as bigint)"),
    ("min_value", "cast(1 as bigint)"), ("max_value", "cast(c_nationkey as bigint) + 1000"), ("increment_by", "cast(1 as bigint)"),
    ("cycle", "c_acctbal < 0"), ("cache_size", "cast(1 as bigint)"), ("last_value", "c_custkey"),
]
_SEQ_CHANGED = {
    "name": "case when c_acctbal > 9000 then concat('old_', c_custkey) else concat('seq_', c_custkey) end",
    "max_value": "case when c_nationkey = 7 then cast(null as bigint) else cast(c_nationkey as bigint) + 1000 end",
    "last_value": "case when c_acctbal < 1000 then c_custkey + 1 else c_custkey end",
}
SEQUENCES_CURRENT: Exprs = [(name, _SEQ_CHANGED.get(name, expr)) for name, expr in SEQUENCES_WANTED]


def spark_rows(df: DataFrame, exprs: Exprs, where: str | None = None) -> DataFrame:
    rows = df.filter(where) if where else df
    return rows.selectExpr(*[f"{expr.replace('array[', 'array(').replace(']', ')')} as `{name}`" for name, expr in exprs])


def sql_rows(source: str, exprs: Exprs, where: str | None = None) -> str:
    fields = ", ".join(f'{expr} AS "{name}"' for name, expr in exprs)
    return f"SELECT {fields} FROM {source}" + (f" WHERE {where}" if where else "")


def wanted_columns_sql() -> str:
    return sql_rows("orders", COLUMNS_WANTED)


def current_columns_sql() -> str:
    return sql_rows("orders", COLUMNS_CURRENT, CURRENT_FILTER)


def catalog_pair(spark: SparkSession, d: str) -> tuple[Catalog, Catalog]:
    """Catalogs (wanted, current) with the columns and tables of the orders."""
    orders = table(spark, d, "orders")
    wanted = Catalog.of(spark, columns=spark_rows(orders, COLUMNS_WANTED), schemas=[])
    current = Catalog.of(spark, columns=spark_rows(orders, COLUMNS_CURRENT, CURRENT_FILTER), schemas=[])
    return wanted, current


def full_catalog_pair(spark: SparkSession, d: str) -> tuple[Catalog, Catalog]:
    """Catalogs (wanted, current) with objects of every kind.

    Tables come from the orders, the parts and the line items; the other objects refer to them.
    """
    wanted, current = catalog_pair(spark, d)
    part, line, customer = (table(spark, d, t) for t in ("part", "lineitem", "customer"))

    def with_objects(c: Catalog, fks: Exprs, uniques: Exprs, checks: Exprs, indexes: Exprs, sequences: Exprs, parts: DataFrame) -> Catalog:
        foreign = spark_rows(line, fks)
        tables = (
            c.tables.unionByName(spark_rows(parts, PART_TABLE).distinct())
            .unionByName(foreign.select(F.col("src_schema").alias("schema"), F.col("src_table").alias("table")).distinct())
        )
        return c.with_frames(
            tables=tables,
            foreign_keys=foreign,
            uniques=spark_rows(parts, uniques),
            checks=spark_rows(parts, checks),
            indexes=spark_rows(parts, indexes),
            sequences=spark_rows(customer, sequences),
        )

    parts_now = part.filter(PARTS_CURRENT_FILTER)
    return (
        with_objects(wanted, FKS_WANTED, UNIQUES_WANTED, CHECKS_WANTED, INDEXES_WANTED, SEQUENCES_WANTED, part),
        with_objects(current, FKS_CURRENT, UNIQUES_CURRENT, CHECKS_CURRENT, INDEXES_CURRENT, SEQUENCES_CURRENT, parts_now),
    )
