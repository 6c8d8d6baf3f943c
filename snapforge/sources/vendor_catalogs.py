"""Catalogs of databases, folded in Spark from the system views of each vendor.

The views come as frames by name: ``read_catalog`` reads them over JDBC, a test makes them from
rows. They have one row per catalog object, so all joins here are as large as a catalog.
Every foreign key is resolved through the object it names and never through the constraint name
alone, because names of constraints repeat between tables (and in MySQL every primary key has one).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.catalog import Catalog, catalog_constraints, catalog_indexes

Views = Callable[[str], DataFrame]

# The statements that are sent where a view has columns that JDBC cannot read as they are.
QUERIES = {
    "POSTGRES": {
        "pg_constraint": "select conname, contype::text as contype, conrelid, confrelid, conkey, confkey, "
        "pg_get_constraintdef(oid) as condef from pg_catalog.pg_constraint where conrelid <> 0",
        "pg_index": "select indexrelid, indrelid, indisunique, indnkeyatts, indkey::text as indkey from pg_catalog.pg_index",
        "pg_class": "select oid, relname, relnamespace, relkind::text as relkind, relam from pg_catalog.pg_class",
        "pg_namespace": "select oid, nspname from pg_catalog.pg_namespace",
        "pg_attribute": "select attrelid, attnum, attname from pg_catalog.pg_attribute where attnum > 0",
        "pg_am": "select oid, amname from pg_catalog.pg_am",
        "sequences": "select schemaname, sequencename, start_value, min_value, max_value, increment_by, cycle, cache_size, last_value "
        "from pg_catalog.pg_sequences",
    },
    "SQLSERVER": {
        "schemas": "select schema_id, name from sys.schemas",
        "tables": "select object_id, schema_id, name from sys.tables",
        "columns_sys": "select object_id, column_id, name, is_identity from sys.columns",
        "foreign_keys": "select object_id, name from sys.foreign_keys",
        "foreign_key_columns": "select constraint_object_id, constraint_column_id, parent_object_id, parent_column_id, "
        "referenced_object_id, referenced_column_id from sys.foreign_key_columns",
        "indexes": "select object_id, index_id, name, is_unique, type_desc, is_primary_key, is_unique_constraint from sys.indexes",
        "index_columns": "select object_id, index_id, column_id, index_column_id, key_ordinal, is_included_column from sys.index_columns",
        "check_constraints": "select parent_object_id, name, definition from sys.check_constraints",
        "default_constraints": "select parent_object_id, parent_column_id, name from sys.default_constraints",
        "sequences": "select schema_id, name, cast(start_value as bigint) as start_value, cast(minimum_value as bigint) as min_value, "
        "cast(maximum_value as bigint) as max_value, cast(increment as bigint) as increment_by, is_cycling as cycle, "
        "cast(cache_size as bigint) as cache_size, cast(last_used_value as bigint) as last_value from sys.sequences",
    },
    "MYSQL": {},
}


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def column_rows(columns: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Catalog rows of ``information_schema.columns``.

    ``marked``, where a vendor has these facts elsewhere: schema, table, name, identity, default_constraint.
    """
    length = _optional(columns, "character_maximum_length", "bigint")
    # A length of -1 marks an unbounded type, and lengths past the int range mean the same.
    bounded = F.when(length.between(0, 2**31 - 1), length.cast("int"))
    flagged = F.upper(_optional(columns, "is_identity", "string")) == "YES"
    counting = F.lower(_optional(columns, "extra", "string")).contains("auto_increment")
    udt = _optional(columns, "udt_name", "string")
    rows = columns.select(
        F.col("table_schema").alias("schema"),
        F.col("table_name").alias("table"),
        F.col("column_name").alias("name"),
        F.col("ordinal_position").cast("int").alias("ordinal"),
        F.coalesce(udt, F.col("data_type")).alias("data_type"),
        F.coalesce(_optional(columns, "column_type", "string"), udt, F.col("data_type")).alias("column_type"),
        bounded.alias("max_length"),
        _optional(columns, "numeric_precision", "int").alias("num_precision"),
        _optional(columns, "numeric_scale", "int").alias("num_scale"),
        _optional(columns, "column_key", "string").alias("column_key"),
        _optional(columns, "column_default", "string").alias("column_default"),
        F.lit(None).cast("string").alias("default_constraint"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        (F.coalesce(flagged, F.lit(False)) | F.coalesce(counting, F.lit(False))).alias("identity"),
    )
    if marked is None:
        return rows
    facts = marked.select("schema", "table", "name", F.col("identity").alias("_i"), F.col("default_constraint").alias("_d"))
    return rows.join(facts, ["schema", "table", "name"], "left").select(
        *[
            F.coalesce("_i", "identity").alias(c) if c == "identity" else F.coalesce("_d", c).alias(c) if c == "default_constraint" else F.col(c)
            for c in rows.columns
        ]
    )


def standard_constraints(table_constraints: DataFrame, key_usage: DataFrame, referential: DataFrame | None) -> DataFrame:
    """Rows for ``catalog_constraints`` from the information schema.

    A ``key_usage`` that names the referenced columns itself is taken at its word. Otherwise the
    target is found by ``position_in_unique_constraint``; without that column too, foreign keys
    cannot be told and that is an error.
    """
    on = ["constraint_schema", "table_schema", "table_name", "constraint_name"]
    kinds = table_constraints.select(*on, F.col("constraint_type").alias("kind"))
    used = key_usage.join(kinds, on)
    own = [
        F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("constraint_name").alias("constraint"),
        "kind", F.col("ordinal_position").cast("int").alias("ord"), F.col("column_name").alias("column"),
    ]
    if "referenced_table_name" in key_usage.columns:
        return used.select(
            *own,
            F.col("referenced_table_schema").alias("ref_schema"),
            F.col("referenced_table_name").alias("ref_table"),
            F.col("referenced_column_name").alias("ref_column"),
        )
    if referential is None or "position_in_unique_constraint" not in key_usage.columns:
        raise ValueError("these views do not say which columns a foreign key refers to")
    target = key_usage.select(
        F.col("constraint_schema").alias("unique_constraint_schema"),
        F.col("constraint_name").alias("unique_constraint_name"),
        F.col("ordinal_position").cast("int").alias("_pos"),
        F.col("table_schema").alias("ref_schema"),
        F.col("table_name").alias("ref_table"),
        F.col("column_name").alias("ref_column"),
    )
    links = referential.select("constraint_schema", "constraint_name", "unique_constraint_schema", "unique_constraint_name")
    return (
        used.withColumn("_pos", F.col("position_in_unique_constraint").cast("int"))
        .join(links, ["constraint_schema", "constraint_name"], "left")
        .join(target, ["unique_constraint_schema", "unique_constraint_name", "_pos"], "left")
        .select(*own, "ref_schema", "ref_table", "ref_column")
    )


def catalog_from_views(
    spark: SparkSession,
    columns: DataFrame,
    table_constraints: DataFrame,
    key_usage: DataFrame,
    referential: DataFrame | None = None,
    source_type: str | None = None,
    schemas: Iterable[str] | None = None,
) -> Catalog:
    """Catalog from frames shaped like the standard information schema views.

    Those views link a foreign key to its target by name, so names of keys have to be unique in a
    schema; ``vendor_catalog`` does not need that.
    """
    rows = standard_constraints(table_constraints, key_usage, referential)
    return Catalog.of(spark, columns=column_rows(columns), source_type=source_type, schemas=schemas, **catalog_constraints(rows))


def _mysql(views: Views) -> dict[str, DataFrame]:
    constraints = views("table_constraints")
    tables = views("tables").filter("table_type = 'BASE TABLE'").select("table_schema", "table_name")
    own = constraints.select(
        "table_schema", "table_name", F.col("constraint_name").alias("index_name"), F.lit(True).alias("_key")
    ).distinct()
    indexes = (
        views("statistics").join(own, ["table_schema", "table_name", "index_name"], "left_anti")
        .select(
            F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("index_name").alias("name"),
            (F.col("non_unique") == 0).alias("unique"), F.col("index_type").alias("type"), F.col("seq_in_index").cast("int").alias("ord"),
            F.col("column_name").alias("column"), F.lit(False).alias("is_included"),
        )
    )
    checks = (
        views("check_constraints").select("constraint_schema", "constraint_name", "check_clause")
        .join(constraints.filter("constraint_type = 'CHECK'"), ["constraint_schema", "constraint_name"])
        .select(
            F.col("table_schema").alias("schema"), F.col("table_name").alias("table"),
            F.col("constraint_name").alias("constraint"), F.col("check_clause").alias("condef"),
        )
    )
    return {
        "columns": column_rows(views("columns").join(tables, ["table_schema", "table_name"], "left_semi")),
        "indexes": catalog_indexes(indexes),
        "checks": checks,
        **catalog_constraints(standard_constraints(constraints, views("key_column_usage"), None)),
    }


def _postgres(views: Views) -> dict[str, DataFrame]:
    spaces = views("pg_namespace").select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema"))
    classes = views("pg_class")
    tables = classes.filter("relkind in ('r', 'p')").join(spaces, "relnamespace").select("oid", "schema", F.col("relname").alias("table"))
    names = views("pg_attribute").select(F.col("attrelid").alias("oid"), F.col("attnum").cast("int").alias("_num"), F.col("attname").alias("column"))

    def at(side: str) -> tuple[DataFrame, DataFrame]:
        """Tables and columns under names of one side."""
        return (
            tables.select(F.col("oid").alias(f"{side}oid"), F.col("schema").alias(f"{side}schema"), F.col("table").alias(f"{side}table")),
            names.select(F.col("oid").alias(f"{side}oid"), F.col("_num").alias(f"{side}num"), F.col("column").alias(f"{side}column")),
        )

    (own, own_names), (ref, ref_names) = at(""), at("ref_")
    found = views("pg_constraint")
    kind = F.expr("case contype when 'p' then 'PRIMARY KEY' when 'u' then 'UNIQUE' when 'f' then 'FOREIGN KEY' end")
    pairs = (
        found.withColumn("kind", kind).filter("kind is not null")
        .select(
            F.col("conname").alias("constraint"), "kind", F.col("conrelid").alias("oid"), F.col("confrelid").alias("ref_oid"), "confkey",
            F.posexplode("conkey").alias("ord", "num"),
        )
        .withColumn("ref_num", F.expr("try_element_at(confkey, ord + 1)").cast("int"))
        .withColumn("num", F.col("num").cast("int"))
        .drop("confkey")
    )
    rows = (
        pairs.join(own, "oid").join(own_names, ["oid", "num"])
        .join(ref, "ref_oid", "left").join(ref_names, ["ref_oid", "ref_num"], "left")
        .select("schema", "table", "constraint", "kind", (F.col("ord") + 1).alias("ord"), "column", "ref_schema", "ref_table", "ref_column")
    )
    checks = found.filter("contype = 'c'").join(tables, found["conrelid"] == tables["oid"]).select(
        "schema", "table", F.col("conname").alias("constraint"), "condef"
    )
    methods = views("pg_am").select(F.col("oid").alias("relam"), F.col("amname").alias("type"))
    named = classes.join(methods, "relam").select(F.col("oid").alias("indexrelid"), F.col("relname").alias("name"), "type")
    keys = found.select(F.col("conrelid").alias("oid"), F.col("conname").alias("name"))
    indexes = (
        views("pg_index").select(
            F.col("indrelid").alias("oid"), "indexrelid", F.col("indisunique").alias("unique"), "indnkeyatts",
            F.posexplode(F.split("indkey", " ")).alias("ord", "num"),
        )
        .withColumn("num", F.col("num").cast("int"))
        .join(own, "oid").join(named, "indexrelid").join(keys, ["oid", "name"], "left_anti")
        .join(own_names, ["oid", "num"], "left")  # an expression has the number 0 and no column
        .select("schema", "table", "name", "unique", "type", "ord", "column", (F.col("ord") >= F.col("indnkeyatts")).alias("is_included"))
    )
    based = tables.select(F.col("schema").alias("table_schema"), F.col("table").alias("table_name"))
    sequences = views("sequences").withColumnsRenamed({"schemaname": "schema", "sequencename": "name"})
    return {
        "columns": column_rows(views("columns").join(based, ["table_schema", "table_name"], "left_semi")),
        "indexes": catalog_indexes(indexes), "checks": checks, "sequences": sequences, **catalog_constraints(rows),
    }


def _sqlserver(views: Views) -> dict[str, DataFrame]:
    spaces = views("schemas").select("schema_id", F.col("name").alias("schema"))
    tables = views("tables").join(spaces, "schema_id").select("object_id", "schema", F.col("name").alias("table"))
    columns = views("columns_sys")
    names = columns.select("object_id", "column_id", F.col("name").alias("column"))

    def joined(df: DataFrame, object_id: str, column_id: str, prefix: str = "") -> DataFrame:
        """``df`` with schema, table and column of the object and column it names."""
        t = tables.select(F.col("object_id").alias("_o"), F.col("schema").alias(f"{prefix}schema"), F.col("table").alias(f"{prefix}table"))
        c = names.select(F.col("object_id").alias("_o"), F.col("column_id").alias("_c"), F.col("column").alias(f"{prefix}column"))
        return df.withColumn("_o", F.col(object_id)).withColumn("_c", F.col(column_id)).join(t, "_o").join(c, ["_o", "_c"]).drop("_o", "_c")

    none = F.lit(None).cast("string")
    foreign = views("foreign_key_columns").join(
        views("foreign_keys").select(F.col("object_id").alias("constraint_object_id"), F.col("name").alias("constraint")), "constraint_object_id"
    )
    foreign = joined(joined(foreign, "parent_object_id", "parent_column_id"), "referenced_object_id", "referenced_column_id", "ref_")
    shape = ["schema", "table", "constraint", "kind", "ord", "column", "ref_schema", "ref_table", "ref_column"]
    foreign = foreign.withColumns({"kind": F.lit("FOREIGN KEY"), "ord": F.col("constraint_column_id").cast("int")}).select(*shape)
    parts = joined(views("index_columns").join(views("indexes").filter("name is not null"), ["object_id", "index_id"]), "object_id", "column_id")
    keys = parts.filter("(is_primary_key or is_unique_constraint) and key_ordinal > 0").withColumns(
        {
            "constraint": F.col("name"), "kind": F.when(F.col("is_primary_key"), "PRIMARY KEY").otherwise("UNIQUE"),
            "ord": F.col("key_ordinal").cast("int"), "ref_schema": none, "ref_table": none, "ref_column": none,
        }
    )
    indexes = parts.filter("not is_primary_key and not is_unique_constraint").select(
        "schema", "table", "name", F.col("is_unique").alias("unique"), F.col("type_desc").alias("type"),
        F.when(F.col("is_included_column"), F.col("index_column_id")).otherwise(F.col("key_ordinal")).cast("int").alias("ord"),
        "column", F.col("is_included_column").alias("is_included"),
    )
    checks = views("check_constraints").join(tables, F.col("parent_object_id") == tables["object_id"]).select(
        "schema", "table", F.col("name").alias("constraint"), F.col("definition").alias("condef")
    )
    defaults = views("default_constraints").select(
        F.col("parent_object_id").alias("object_id"), F.col("parent_column_id").alias("column_id"), F.col("name").alias("default_constraint")
    )
    marked = columns.join(tables, "object_id").join(defaults, ["object_id", "column_id"], "left").select(
        "schema", "table", "name", F.col("is_identity").alias("identity"), "default_constraint"
    )
    based = tables.select(F.col("schema").alias("table_schema"), F.col("table").alias("table_name"))
    sequences = views("sequences").join(spaces, "schema_id").drop("schema_id")
    return {
        "columns": column_rows(views("columns").join(based, ["table_schema", "table_name"], "left_semi"), marked),
        "indexes": catalog_indexes(indexes), "checks": checks, "sequences": sequences,
        **catalog_constraints(foreign.unionByName(keys.select(*shape))),
    }


def vendor_catalog(spark: SparkSession, source_type: str, views: Views, schemas: Iterable[str]) -> Catalog:
    """Tables, columns, keys, foreign keys, checks, indexes and sequences of ``schemas``.

    ``views`` gives a frame with lower-case column names for each name: those of ``QUERIES`` for the
    vendor, else a view of the information schema. Indexes behind a key or unique constraint are not
    listed; views are not tables. Columns that an index only carries are its extra columns.
    """
    build = {"MYSQL": _mysql, "POSTGRES": _postgres, "SQLSERVER": _sqlserver}[source_type]
    wanted = list(schemas)
    frames = build(views)
    frames = {n: df.filter(F.col("src_schema" if n == "foreign_keys" else "schema").isin(wanted)) for n, df in frames.items()}
    if "sequences" in frames:
        kinds = {c: "bigint" for c in ("start_value", "min_value", "max_value", "increment_by", "cache_size", "last_value")}
        order = ["schema", "name", "start_value", "min_value", "max_value", "increment_by", "cycle", "cache_size", "last_value"]
        frames["sequences"] = frames["sequences"].select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in order])
    return Catalog.of(spark, source_type=source_type, schemas=wanted, **frames)
