"""Differences of two catalogs. The source is the wanted state, the target the current one.

CREATE: only in the source. DROP: only in the target. MODIFY: in both, with a field that differs
(compared null-safe). ``old`` is the target's row, ``new`` the source's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.catalog import Catalog
from snapforge.functions.names import qualified_name
from snapforge.session import keep

# Order of entities and operations in a full diff.
ENTITIES = ("table", "column", "foreign_key", "unique", "check", "index", "sequence")
OPERATIONS = ("CREATE", "DROP", "MODIFY")

# Fields that make two rows differ. Ordinal position and the name of a default constraint do not.
COLUMN_FIELDS = [
    "data_type", "max_length", "column_type", "num_precision", "num_scale", "column_key",
    "column_default", "nullable", "identity",
]
FOREIGN_KEY_FIELDS = ["src_columns", "ref_schema", "ref_table", "ref_columns"]
UNIQUE_FIELDS = ["columns"]
CHECK_FIELDS = ["condef"]
INDEX_FIELDS = ["unique", "type", "columns", "extra_columns"]
SEQUENCE_FIELDS = [
    "start_value", "min_value", "max_value", "increment_by", "cycle", "cache_size", "last_value",
]


def names_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.subtract(right)


def names_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return left.intersect(right)


def _first_per_key(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key with the fields in a struct; of duplicates the smallest row is taken."""
    # A schema may be null, and null names the same schema as the empty text.
    named = [F.coalesce(k, F.lit("")).alias(k) for k in keys]
    return df.groupBy(*named).agg(F.min(F.struct(*fields)).alias("row"))


def _compare(src: DataFrame, tgt: DataFrame, keys: list[str], fields: list[str], sets: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on the key: key columns, op, changed_fields, old, new."""
    s = _first_per_key(src, keys, fields).withColumnRenamed("row", "new")
    t = _first_per_key(tgt, keys, fields).withColumnRenamed("row", "old")

    def value(side: str, field: str) -> Column:
        col = F.col(f"{side}.{field}")
        return F.array_sort(col) if field in sets else col

    changed = F.array_compact(
        F.array(*[F.when(~value("old", f).eqNullSafe(value("new", f)), F.lit(f)) for f in fields])
    )
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    op = (
        F.when(F.col("old").isNull(), F.lit("CREATE"))
        .when(F.col("new").isNull(), F.lit("DROP"))
        .when(F.size("changed_fields") > 0, F.lit("MODIFY"))
    )
    return (
        s.join(t, keys, "full_outer")
        .withColumn("changed_fields", F.when(both, changed).otherwise(F.array().cast("array<string>")))
        .withColumn("op", op)
        .filter("op is not null")
        .select(*keys, "op", "changed_fields", "old", "new")
    )


def _table_keys(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("schema", F.lit("")).alias("schema"), "table").distinct()


def diff_tables(src: Catalog, tgt: Catalog) -> DataFrame:
    """Tables to create and to drop: schema, table, op."""
    s = _table_keys(src.tables).withColumn("_new", F.lit(True))
    t = _table_keys(tgt.tables).withColumn("_old", F.lit(True))
    op = F.when(F.col("_old").isNull(), F.lit("CREATE")).when(F.col("_new").isNull(), F.lit("DROP"))
    return s.join(t, ["schema", "table"], "full_outer").withColumn("op", op).filter("op is not null").select("schema", "table", "op")


def _without(diff: DataFrame, gone: DataFrame, schema: str = "schema", table: str = "table") -> DataFrame:
    """Drop changes of tables that are themselves created or dropped."""
    skip = gone.select(F.col("schema").alias(schema), F.col("table").alias(table))
    return diff.join(skip, [schema, table], "left_anti").select(*diff.columns)


# The ``gone`` argument below takes the result of ``diff_tables`` when it is already at hand.


def diff_columns(src: Catalog, tgt: Catalog, gone: DataFrame | None = None) -> DataFrame:
    """Columns to create, drop and modify in the tables that both catalogs have."""
    diff = _compare(src.columns, tgt.columns, ["schema", "table", "name"], COLUMN_FIELDS)
    return _without(diff, diff_tables(src, tgt) if gone is None else gone)


def diff_foreign_keys(src: Catalog, tgt: Catalog, gone: DataFrame | None = None) -> DataFrame:
    """Foreign keys by source table and constraint. The column lists compare as sets."""
    keys = ["src_schema", "src_table", "constraint"]
    diff = _compare(src.foreign_keys, tgt.foreign_keys, keys, FOREIGN_KEY_FIELDS, ("src_columns", "ref_columns"))
    return _without(diff, diff_tables(src, tgt) if gone is None else gone, "src_schema", "src_table")


def diff_uniques(src: Catalog, tgt: Catalog, gone: DataFrame | None = None) -> DataFrame:
    """Unique constraints by table and constraint."""
    diff = _compare(src.uniques, tgt.uniques, ["schema", "table", "constraint"], UNIQUE_FIELDS)
    return _without(diff, diff_tables(src, tgt) if gone is None else gone)


def diff_checks(src: Catalog, tgt: Catalog, gone: DataFrame | None = None) -> DataFrame:
    """Check constraints by table and constraint; their texts are compared."""
    diff = _compare(src.checks, tgt.checks, ["schema", "table", "constraint"], CHECK_FIELDS)
    return _without(diff, diff_tables(src, tgt) if gone is None else gone)


def diff_indexes(src: Catalog, tgt: Catalog, gone: DataFrame | None = None) -> DataFrame:
    """Indexes by table and index name."""
    diff = _compare(src.indexes, tgt.indexes, ["schema", "table", "name"], INDEX_FIELDS)
    return _without(diff, diff_tables(src, tgt) if gone is None else gone)


def diff_sequences(src: Catalog, tgt: Catalog) -> DataFrame:
    """Sequences by qualified name; not tied to a table, so never skipped."""
    return _compare(src.sequences, tgt.sequences, ["schema", "name"], SEQUENCE_FIELDS)


def _rank(col: Column, values: tuple[str, ...]) -> Column:
    out = F.lit(len(values))
    for i, v in enumerate(values):
        out = F.when(col == v, F.lit(i)).otherwise(out)
    return out


def _unified(diff: DataFrame, entity: str) -> DataFrame:
    """Common shape: entity, op, qualified_name, table, changed_fields, old, new (as JSON)."""
    schema = F.col("src_schema" if entity == "foreign_key" else "schema")
    if entity == "sequence":
        table, name = F.lit(None).cast("string"), qualified_name(schema, F.col("name"))
    elif entity == "table":
        table = name = qualified_name(schema, F.col("table"))
    else:
        table = qualified_name(schema, F.col("src_table" if entity == "foreign_key" else "table"))
        last = F.col("name" if entity in ("column", "index") else "constraint")
        name = F.concat_ws(".", table, last) if entity == "column" else qualified_name(schema, last)
    if entity == "table":
        changed, old, new = F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string")
    else:
        changed, old, new = F.col("changed_fields"), F.to_json("old"), F.to_json("new")
    return diff.select(
        F.lit(entity).alias("entity"), "op", name.alias("qualified_name"), table.alias("table"),
        changed.alias("changed_fields"), old.alias("old"), new.alias("new"),
    )


def diff_catalog(src: Catalog, tgt: Catalog, skip_sequences: bool = False) -> DataFrame:
    """All differences, in the order in which they would be applied.

    The table changes are needed by every other comparison, so they are written once, and so are the
    differences before the final sort, which reads its input twice.
    """
    gone = keep(diff_tables(src, tgt), "tables")
    parts = {
        "table": gone,
        "column": diff_columns(src, tgt, gone),
        "foreign_key": diff_foreign_keys(src, tgt, gone),
        "unique": diff_uniques(src, tgt, gone),
        "check": diff_checks(src, tgt, gone),
        "index": diff_indexes(src, tgt, gone),
    }
    if not skip_sequences:
        parts["sequence"] = diff_sequences(src, tgt)
    out = None
    for entity, diff in parts.items():
        one = _unified(diff, entity)
        out = one if out is None else out.unionByName(one)
    by_table = F.when(F.col("entity") == "column", F.col("table"))
    return keep(out, "changes").orderBy(_rank(F.col("entity"), ENTITIES), by_table, _rank(F.col("op"), OPERATIONS), "qualified_name", "table")


def dry_run(src: Catalog, tgt: Catalog, skip_sequences: bool = False) -> DataFrame:
    """Report of the planned changes: what would be applied, per entity and operation."""
    return (
        diff_catalog(src, tgt, skip_sequences)
        .groupBy("entity", "op")
        .agg(F.count(F.lit(1)).alias("changes"))
        .orderBy(_rank(F.col("entity"), ENTITIES), _rank(F.col("op"), OPERATIONS))
    )
