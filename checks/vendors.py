"""Catalog views of the three vendors, made from the conversations, and the catalog they fold to.

Every conversation is two tables: ``child_n`` with a column per turn, a foreign key, a check and an
index, and ``parent_n`` with the key that it refers to. Names of constraints repeat between tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Registry, table
from snapforge.sources.vendor_catalogs import vendor_catalog

_SQL = """
SELECT 'foreign key' AS kind, concat('child_', conv_id) AS "table", 'fk' AS name, string_agg(concat('c', turn), ',' ORDER BY turn) AS columns,
       concat('parent_', conv_id, ':', string_agg(concat('p', turn), ',' ORDER BY turn)) AS detail FROM conversations GROUP BY conv_id
UNION ALL SELECT 'key', concat('parent_', conv_id), 'PRIMARY', string_agg(concat('p', turn), ',' ORDER BY turn DESC), NULL FROM conversations GROUP BY conv_id
UNION ALL SELECT 'check', concat('child_', conv_id), 'ck', NULL, concat('c0 < ', sum(length(text))) FROM conversations GROUP BY conv_id
UNION ALL SELECT 'index', concat('child_', conv_id), 'ix',
       coalesce(string_agg(concat('c', turn), ',' ORDER BY turn) FILTER (WHERE {key}), ''),
       concat('false:', coalesce(string_agg(concat('c', turn), ',' ORDER BY turn) FILTER (WHERE NOT ({key})), '')) FROM conversations GROUP BY conv_id
UNION ALL SELECT 'column', concat('child_', conv_id), concat('c', turn), 'int', CASE WHEN {identity} THEN 'identity' ELSE '' END FROM conversations
UNION ALL SELECT 'column', concat('parent_', conv_id), concat('p', turn), 'int', '' FROM conversations
UNION ALL SELECT 'sequence', NULL, concat('sq_', conv_id), NULL, count(*)::VARCHAR FROM conversations WHERE {sequences} GROUP BY conv_id"""
# MySQL has neither included columns nor sequences.
_INCLUDED = {"key": "turn < 2", "identity": "turn = 0", "sequences": "true"}
_PLAIN = {"key": "true", "identity": "turn = 0", "sequences": "false"}


def _text(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _turns(spark, d: str) -> DataFrame:
    """One row per table and column; the parent lists its key columns backwards."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    child = turns.select("*", F.lit("child").alias("side"), _text("child_", "conv_id").alias("table_name"), _text("c", "turn").alias("column_name"))
    parent = turns.select("*", F.lit("parent").alias("side"), _text("parent_", "conv_id").alias("table_name"), _text("p", "turn").alias("column_name"))
    both = child.unionByName(parent)
    return both.withColumns(
        {
            "oid": F.col("conv_id") * 2 + (F.col("side") == "parent").cast("int"),
            "target": F.col("conv_id") * 2 + 1,
            "num": (F.col("turn") + 1).cast("int"),
            "table_schema": F.lit("s"),
        }
    )


def _tables(cols: DataFrame) -> DataFrame:
    return cols.select("oid", "conv_id", "side", "table_schema", "table_name").distinct()


def _columns(cols: DataFrame) -> DataFrame:
    return cols.select("table_schema", "table_name", "column_name", F.col("num").alias("ordinal_position"), F.lit("int").alias("data_type"), F.lit("YES").alias("is_nullable"))


def _checks(cols: DataFrame) -> DataFrame:
    sums = cols.filter("side = 'child'").groupBy("oid", "conv_id", "table_schema", "table_name").agg(F.sum("chars").alias("n"))
    return sums.withColumn("condef", F.concat(F.lit("c0 < "), F.col("n").cast("string")))


def mysql_views(cols: DataFrame) -> Callable[[str], DataFrame]:
    child, parent = cols.filter("side = 'child'"), cols.filter("side = 'parent'")
    named = [F.col("table_schema").alias("constraint_schema"), "table_schema", "table_name"]
    none = F.lit(None).cast("string")
    usage = child.select(
        *named, F.lit("fk").alias("constraint_name"), "column_name", F.col("num").alias("ordinal_position"),
        F.lit("s").alias("referenced_table_schema"), _text("parent_", "conv_id").alias("referenced_table_name"), _text("p", "turn").alias("referenced_column_name"),
    ).unionByName(
        parent.select(
            *named, F.lit("PRIMARY").alias("constraint_name"), "column_name", (-F.col("num")).alias("ordinal_position"),
            none.alias("referenced_table_schema"), none.alias("referenced_table_name"), none.alias("referenced_column_name"),
        )
    )
    # Check constraints have unique names in a schema here, so the table is part of the name.
    checks = _checks(cols).withColumn("constraint_name", F.concat(F.lit("ck:"), "table_name"))
    kinds = usage.select(*named, "constraint_name", F.when(F.col("constraint_name") == "fk", "FOREIGN KEY").otherwise("PRIMARY KEY").alias("constraint_type")).distinct()
    statistic = [F.col("num").alias("seq_in_index"), "column_name", F.lit("BTREE").alias("index_type")]
    frames = {
        "columns": _columns(cols).withColumn("extra", F.when((F.col("ordinal_position") == 1) & F.col("table_name").startswith("child"), "auto_increment").otherwise("")),
        "tables": _tables(cols).withColumn("table_type", F.lit("BASE TABLE")),
        "key_column_usage": usage,
        "table_constraints": kinds.unionByName(checks.select(*named, "constraint_name", F.lit("CHECK").alias("constraint_type"))),
        "check_constraints": checks.select(F.col("table_schema").alias("constraint_schema"), "constraint_name", F.col("condef").alias("check_clause")),
        "statistics": child.select("table_schema", "table_name", F.lit("ix").alias("index_name"), F.lit(1).alias("non_unique"), *statistic)
        .unionByName(parent.select("table_schema", "table_name", F.lit("PRIMARY").alias("index_name"), F.lit(0).alias("non_unique"), *statistic)),
    }
    return frames.__getitem__


def postgres_views(cols: DataFrame) -> Callable[[str], DataFrame]:
    tables = _tables(cols)
    spark = cols.sparkSession
    nums = F.array_sort(F.collect_list("num"))
    empty = F.lit(None).cast("array<int>")
    of_child = cols.filter("side = 'child'").groupBy("oid", "target").agg(nums.alias("nums"), F.sum("chars").alias("n"))
    of_parent = cols.filter("side = 'parent'").groupBy("oid").agg(F.reverse(nums).alias("nums"))
    constraints = (
        of_child.select(F.lit("fk").alias("conname"), F.lit("f").alias("contype"), F.col("oid").alias("conrelid"), F.col("target").alias("confrelid"),
                        F.col("nums").alias("conkey"), F.col("nums").alias("confkey"), F.lit("").alias("condef"))
        .unionByName(of_parent.select(F.lit("PRIMARY").alias("conname"), F.lit("p").alias("contype"), F.col("oid").alias("conrelid"), F.lit(0).cast("long").alias("confrelid"),
                                      F.col("nums").alias("conkey"), empty.alias("confkey"), F.lit("").alias("condef")))
        .unionByName(of_child.select(F.lit("ck").alias("conname"), F.lit("c").alias("contype"), F.col("oid").alias("conrelid"), F.lit(0).cast("long").alias("confrelid"),
                                     F.array(F.lit(1)).alias("conkey"), empty.alias("confkey"), F.concat(F.lit("c0 < "), F.col("n").cast("string")).alias("condef")))
    )
    index = tables.withColumn("name", F.when(F.col("side") == "child", "ix").otherwise("PRIMARY")).withColumn("index_oid", -F.col("oid") - 1)
    listed = cols.groupBy("oid").agg(F.concat_ws(" ", F.transform(nums, lambda n: n.cast("string"))).alias("indkey"))
    frames = {
        "columns": _columns(cols).withColumn("udt_name", F.col("data_type")).withColumn(
            "is_identity", F.when((F.col("ordinal_position") == 1) & F.col("table_name").startswith("child"), "YES").otherwise("NO")
        ),
        "pg_namespace": spark.range(1).select(F.col("id").alias("oid"), F.lit("s").alias("nspname")),
        "pg_class": tables.select("oid", F.col("table_name").alias("relname"), F.lit(0).alias("relnamespace"), F.lit("r").alias("relkind"), F.lit(0).alias("relam"))
        .unionByName(index.select(F.col("index_oid").alias("oid"), F.col("name").alias("relname"), F.lit(0).alias("relnamespace"), F.lit("i").alias("relkind"), F.lit(7).alias("relam"))),
        "pg_attribute": cols.select(F.col("oid").alias("attrelid"), F.col("num").alias("attnum"), F.col("column_name").alias("attname")),
        "pg_am": spark.range(7, 8).select(F.col("id").alias("oid"), F.lit("btree").alias("amname")),
        "pg_constraint": constraints,
        "pg_index": index.join(listed, "oid").select(F.col("index_oid").alias("indexrelid"), F.col("oid").alias("indrelid"), F.lit(False).alias("indisunique"), F.lit(2).alias("indnkeyatts"), "indkey"),
        "sequences": _sequences(cols).select(F.lit("s").alias("schemaname"), F.col("name").alias("sequencename"), *_sequence_facts()),
    }
    return frames.__getitem__


def _sequences(cols: DataFrame) -> DataFrame:
    return cols.filter("side = 'child'").groupBy(_text("sq_", "conv_id").alias("name")).agg(F.count("*").alias("last_value"))


def _sequence_facts() -> list:
    return [F.lit(1).alias("start_value"), F.lit(1).alias("min_value"), F.lit(9).alias("max_value"), F.lit(1).alias("increment_by"), F.lit(False).alias("cycle"), F.lit(1).alias("cache_size"), "last_value"]


def sqlserver_views(cols: DataFrame) -> Callable[[str], DataFrame]:
    tables = _tables(cols)
    child = cols.filter("side = 'child'")
    is_child = F.col("side") == "child"
    name = F.when(is_child, "ix").otherwise("PRIMARY")
    frames = {
        "columns": _columns(cols),
        "schemas": cols.sparkSession.range(1).select(F.col("id").alias("schema_id"), F.lit("s").alias("name")),
        "tables": tables.select(F.col("oid").alias("object_id"), F.lit(0).alias("schema_id"), F.col("table_name").alias("name")),
        "columns_sys": cols.select(F.col("oid").alias("object_id"), F.col("num").alias("column_id"), F.col("column_name").alias("name"), (is_child & (F.col("num") == 1)).alias("is_identity")),
        "foreign_keys": tables.filter(is_child).select((-F.col("oid") - 1).alias("object_id"), F.lit("fk").alias("name")),
        "foreign_key_columns": child.select(
            (-F.col("oid") - 1).alias("constraint_object_id"), F.col("num").alias("constraint_column_id"), F.col("oid").alias("parent_object_id"),
            F.col("num").alias("parent_column_id"), F.col("target").alias("referenced_object_id"), F.col("num").alias("referenced_column_id"),
        ),
        "indexes": tables.select(F.col("oid").alias("object_id"), F.lit(1).alias("index_id"), name.alias("name"), (~is_child).alias("is_unique"), F.lit("CLUSTERED").alias("type_desc"),
                                 (~is_child).alias("is_primary_key"), F.lit(False).alias("is_unique_constraint")),
        "index_columns": cols.select(
            F.col("oid").alias("object_id"), F.lit(1).alias("index_id"), F.col("num").alias("column_id"), F.col("num").alias("index_column_id"),
            F.when(is_child & (F.col("num") > 2), 0).when(is_child, F.col("num")).otherwise(1000 - F.col("num")).alias("key_ordinal"), (is_child & (F.col("num") > 2)).alias("is_included_column"),
        ),
        "check_constraints": _checks(cols).select(F.col("oid").alias("parent_object_id"), F.lit("ck").alias("name"), F.col("condef").alias("definition")),
        "default_constraints": tables.limit(0).select(F.col("oid").alias("parent_object_id"), F.lit(1).alias("parent_column_id"), F.lit("").alias("name")),
        "sequences": _sequences(cols).select(F.lit(0).alias("schema_id"), "name", *_sequence_facts()),
    }
    return frames.__getitem__


def _listing(catalog) -> DataFrame:
    joined = lambda c: F.concat_ws(",", c)
    none = F.lit(None).cast("string")
    shape = ["kind", "table", "name", "columns", "detail"]
    parts = [
        catalog.foreign_keys.select(
            F.lit("foreign key"), "src_table", "constraint", joined("src_columns"), F.concat("ref_table", F.lit(":"), joined("ref_columns"))
        ),
        catalog.keys.select(F.lit("key"), "table", "constraint", joined("columns"), none),
        catalog.checks.select(F.lit("check"), "table", F.substring_index("constraint", ":", 1), none, "condef"),
        catalog.indexes.select(F.lit("index"), "table", "name", joined("columns"), F.concat(F.col("unique").cast("string"), F.lit(":"), joined("extra_columns"))),
        catalog.columns.select(F.lit("column"), "table", "name", "data_type", F.when(F.col("identity"), "identity").otherwise("")),
        catalog.sequences.select(F.lit("sequence"), none, "name", none, F.col("last_value").cast("string")),
    ]
    out = parts[0].toDF(*shape)
    for part in parts[1:]:
        out = out.union(part.toDF(*shape))
    return out


def register(r: Registry) -> None:
    @r.add(_SQL.format(**_PLAIN))
    def catalog_views_mysql(spark, d):
        return _listing(vendor_catalog(spark, "MYSQL", mysql_views(_turns(spark, d)), ["s"]))

    @r.add(_SQL.format(**_INCLUDED))
    def catalog_views_postgres(spark, d):
        return _listing(vendor_catalog(spark, "POSTGRES", postgres_views(_turns(spark, d)), ["s"]))

    @r.add(_SQL.format(**_INCLUDED))
    def catalog_views_sqlserver(spark, d):
        return _listing(vendor_catalog(spark, "SQLSERVER", sqlserver_views(_turns(spark, d)), ["s"]))
