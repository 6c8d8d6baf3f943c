"""The catalog bundle: small DataFrames that describe tables, keys and sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.functions.names import qualified_name
from snapforge.functions.types import type_facts
from snapforge.session import keep, local_frame

SCHEMAS = {
    "tables": "schema string, table string",
    "columns": (
        "schema string, table string, name string, ordinal int, data_type string, column_type string, "
        "max_length int, num_precision int, num_scale int, column_key string, column_default string, "
        "default_constraint string, nullable boolean, identity boolean"
    ),
    "keys": "schema string, table string, constraint string, columns array<string>",
    "foreign_keys": (
        "constraint string, src_schema string, src_table string, src_columns array<string>, "
        "ref_schema string, ref_table string, ref_columns array<string>"
    ),
    "uniques": "schema string, table string, constraint string, columns array<string>",
    "checks": "schema string, table string, constraint string, condef string",
    "indexes": (
        "schema string, table string, name string, unique boolean, type string, "
        "columns array<string>, extra_columns array<string>"
    ),
    "sequences": (
        "schema string, name string, start_value bigint, min_value bigint, max_value bigint, "
        "increment_by bigint, cycle boolean, cache_size bigint, last_value bigint"
    ),
}
FRAMES = tuple(SCHEMAS)


@dataclass(frozen=True)
class Column:
    """One column of a table, for catalogs written by hand."""

    schema: str | None
    table: str
    name: str
    data_type: str
    ordinal: int | None = None
    column_type: str | None = None
    max_length: int | None = None
    num_precision: int | None = None
    num_scale: int | None = None
    column_key: str | None = None
    column_default: str | None = None
    default_constraint: str | None = None
    nullable: bool = True
    identity: bool = False


@dataclass(frozen=True)
class ForeignKey:
    """One foreign key, for catalogs written by hand. Column pairs keep their order."""

    constraint: str
    src_schema: str | None
    src_table: str
    src_columns: tuple[str, ...]
    ref_schema: str | None
    ref_table: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class Catalog:
    """Frames by the names of ``SCHEMAS``; ``source_type`` is the kind of database it came from."""

    tables: DataFrame
    columns: DataFrame
    keys: DataFrame
    foreign_keys: DataFrame
    uniques: DataFrame
    checks: DataFrame
    indexes: DataFrame
    sequences: DataFrame
    source_type: str | None = None
    schemas: tuple[str, ...] | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def of(
        cls,
        spark: SparkSession,
        *,
        source_type: str | None = None,
        schemas: Iterable[str] | None = None,
        **frames: DataFrame | list,
    ) -> Catalog:
        """A catalog from DataFrames or lists of rows; frames left out are empty.

        ``tables`` defaults to the tables named by ``columns``.
        """
        unknown = set(frames) - set(FRAMES)
        if unknown:
            raise ValueError(f"unknown catalog frames {sorted(unknown)}")
        built: dict[str, DataFrame] = {}
        for name in FRAMES:
            given = frames.get(name)
            if isinstance(given, DataFrame):
                built[name] = given
            else:
                built[name] = local_frame(spark, [_as_row(r, SCHEMAS[name]) for r in given or []], SCHEMAS[name])
        if "tables" not in frames:
            built["tables"] = built["columns"].select("schema", "table").distinct()
        if schemas is None:
            schemas = _schema_names(built["tables"]) if "tables" in frames or "columns" in frames else ()
        return cls(**built, source_type=source_type, schemas=tuple(schemas))

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in FRAMES}

    def with_frames(self, **frames) -> Catalog:
        return replace(self, **frames)

    def primary_key(self, schema: str | None, table: str) -> list[str]:
        """Ordered key columns of one table, empty when it has none."""
        rows = self.keys.filter(F.col("schema").eqNullSafe(schema) & (F.col("table") == table)).select("columns").take(1)
        return list(rows[0][0]) if rows else []


CatalogHook = Callable[[Catalog], Catalog]


def _as_row(row, ddl: str) -> tuple:
    names = [part.strip().split(" ")[0] for part in ddl.split(",")]
    if isinstance(row, (Column, ForeignKey)):
        return tuple(list(v) if isinstance(v, tuple) else v for v in (getattr(row, n) for n in names))
    if isinstance(row, dict):
        return tuple(row.get(n) for n in names)
    return tuple(row)


def _schema_names(tables: DataFrame) -> list[str]:
    """Schema names of a catalog: one row per schema of a database."""
    return [r[0] for r in tables.select("schema").filter("schema is not null").distinct().collect()]


def catalog_columns(
    spark: SparkSession,
    dfs: dict[str, DataFrame],
    schema: str | None = None,
    max_lengths: dict[tuple[str, str], int] | None = None,
    identity: Iterable[tuple[str, str]] = (),
    pks: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per column of ``dfs``, read from their Spark schemas without touching data.

    Spark types carry no text length and no identity flag, so both are given beside.
    """
    lengths, ident, pks = max_lengths or {}, set(identity), pks or {}
    rows = []
    for table, df in dfs.items():
        for i, f in enumerate(df.schema.fields, start=1):
            name, precision, scale = type_facts(f.dataType)
            rows.append(
                (
                    schema, table, f.name, i, name, name, lengths.get((table, f.name)), precision, scale,
                    "PRI" if f.name in pks.get(table, []) else None, None, None, f.nullable, (table, f.name) in ident,
                )
            )
    return local_frame(spark, rows, SCHEMAS["columns"])


def catalog_constraints(rows: DataFrame) -> dict[str, DataFrame]:
    """Fold one-row-per-column constraint rows into primary keys, uniques and foreign keys.

    ``rows``: schema, table, constraint, kind ('PRIMARY KEY' | 'UNIQUE' | 'FOREIGN KEY'), ord,
    column, and for foreign keys ref_schema, ref_table, ref_column. Grouping is by schema, table
    and constraint, so equal constraint names in two schemas stay apart, and every column pair is
    kept in order. A group has no more rows than a table has columns.
    """
    by = ["schema", "table", "constraint"]
    ordered = F.array_sort(F.collect_list(F.struct("ord", "column", "ref_column")))
    folded = rows.groupBy(*by, "kind", "ref_schema", "ref_table").agg(ordered.alias("parts"))
    names = F.col("parts")["column"]
    plain = folded.select(*by, "kind", names.alias("columns"))
    return {
        "keys": plain.filter("kind = 'PRIMARY KEY'").drop("kind"),
        "uniques": plain.filter("kind = 'UNIQUE'").drop("kind"),
        "foreign_keys": folded.filter("kind = 'FOREIGN KEY'").select(
            "constraint",
            F.col("schema").alias("src_schema"),
            F.col("table").alias("src_table"),
            names.alias("src_columns"),
            "ref_schema",
            "ref_table",
            F.col("parts")["ref_column"].alias("ref_columns"),
        ),
    }


def catalog_indexes(rows: DataFrame) -> DataFrame:
    """Fold one-row-per-column index rows into key columns and included columns.

    ``rows``: schema, table, name, unique, type, ord, column, is_included.
    """

    def part(included: bool):
        wanted = F.when(F.col("is_included") == included, F.struct("ord", "column"))
        return F.array_sort(F.collect_list(wanted))["column"]

    return rows.groupBy("schema", "table", "name").agg(
        F.max("unique").alias("unique"),
        F.max("type").alias("type"),
        part(False).alias("columns"),
        part(True).alias("extra_columns"),
    )


def filter_schemas(catalog: Catalog, schemas: Iterable[str]) -> Catalog:
    """Catalog rows of the listed schemas; foreign keys go by their source schema."""
    wanted = list(schemas)
    frames = {
        name: df.filter(F.col("src_schema" if name == "foreign_keys" else "schema").isin(wanted))
        for name, df in catalog.frames().items()
    }
    return catalog.with_frames(**frames, schemas=tuple(s for s in catalog.schemas or () if s in wanted))


def _unlike(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct ``rows`` that no row of ``known`` equals; a null equals nothing."""
    both = rows.withColumn("_known", F.lit(0)).unionByName(known.dropna().withColumn("_known", F.lit(1)))
    return both.groupBy(*rows.columns).agg(F.max("_known").alias("_known")).filter("_known = 0").drop("_known")


def validate_fk_catalog(catalog: Catalog) -> DataFrame:
    """Foreign keys that name an unknown table, or an unknown referenced column.

    Distinct names are looked up, not foreign keys, so a table that many of them name is one row; the names that are
    not known are written (when this is called), and the foreign keys are only read for those.
    """
    fks = catalog.foreign_keys
    tables = catalog.tables.select(qualified_name(F.col("schema"), F.col("table")).alias("qname"))
    known = catalog.columns.select(
        qualified_name(F.col("schema"), F.col("table")).alias("qname"), F.col("name").alias("column")
    )
    src = fks.select("constraint", qualified_name(F.col("src_schema"), F.col("src_table")).alias("qname"))
    ref = fks.select("constraint", qualified_name(F.col("ref_schema"), F.col("ref_table")).alias("qname"), "ref_columns")
    pairs = ref.select("constraint", "qname", F.explode("ref_columns").alias("column"))
    # Aggregates hold each name once, where joins would sort every row of both sides.
    lost = keep(_unlike(ref.select("qname"), tables), "unknown")
    missing = keep(_unlike(pairs.select("qname", "column"), known), "unknown").join(lost, "qname", "left_anti")

    def of(rows: DataFrame, names: DataFrame, label: str) -> DataFrame:
        """``rows`` whose names are in ``names``, nulls included."""
        renamed = names.select(*[F.col(c).alias(f"_{c}") for c in names.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names.columns]
        found = rows.join(renamed, same, "left_semi")
        column = F.col("column") if "column" in names.columns else F.lit(None).cast("string").alias("column")
        return found.select("constraint", F.lit(label).alias("problem"), "qname", column)

    return (
        of(src, keep(_unlike(src.select("qname"), tables), "unknown"), "unknown source table")
        .unionByName(of(ref, lost, "unknown referenced table"))
        .unionByName(of(pairs, keep(missing, "unknown"), "unknown referenced column"))
    )
