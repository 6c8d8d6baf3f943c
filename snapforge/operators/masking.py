"""Masking of listed columns over a set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.catalog import Catalog
from snapforge.functions.masks import mask_fixed, mask_original, mask_random
from snapforge.functions.names import qualify
from snapforge.session import local_frame

MASK_TYPES = ("ORIGINAL", "FIXED", "RANDOM")


@dataclass(frozen=True)
class Mask:
    """Kind of mask, mask character, and the length of a FIXED mask."""

    type: str
    char: str = "*"
    length: int = 0
    seed: int = 0
    on_empty: str = "error"

    def __post_init__(self):
        if self.type not in MASK_TYPES:
            raise ValueError(f"unknown mask type {self.type!r}")
        if not self.char:
            raise ValueError("the mask character is empty")


@dataclass(frozen=True)
class MaskTarget:
    schema: str | None
    table: str
    column: str


def targets_frame(spark: SparkSession, targets: list[MaskTarget]) -> DataFrame:
    rows = [(t.schema, t.table, t.column) for t in targets]
    return local_frame(spark, rows, "schema string, table string, column string")


def validate_mask_config(catalog: Catalog, config: DataFrame) -> DataFrame:
    """Config rows (schema, table, column) that name an unknown table or column, with the reason.

    Names are compared exactly; a null and an empty schema are the same.
    """

    def key(df: DataFrame) -> DataFrame:
        return df.withColumn("_schema", F.coalesce("schema", F.lit("")))

    tables = key(catalog.tables).select("_schema", "table").distinct()
    columns = key(catalog.columns).select("_schema", "table", F.col("name").alias("column"))
    asked = key(config)
    no_table = asked.join(tables, ["_schema", "table"], "left_anti").withColumn("error", F.lit("table not found"))
    no_column = (
        asked.join(tables, ["_schema", "table"], "left_semi")
        .join(columns, ["_schema", "table", "column"], "left_anti")
        .withColumn("error", F.lit("column not found"))
    )
    out = ["schema", "table", "column", "error"]
    return no_table.select(*out).unionByName(no_column.select(*out))


def mask_table(
    df: DataFrame,
    columns: dict[str, int | None],
    mask: Mask,
    pk: list[str] | None = None,
    salt: str = "",
) -> DataFrame:
    """Mask the columns of one table; ``columns`` maps each name to its declared length or None.

    Masked columns become text, all others and the column order stay as they are. RANDOM lengths
    come from a hash of the key columns, so a masked key column is hashed before it is masked.
    """
    keys = [F.col(f"`{c}`") for c in pk or []]
    masked = {}
    for name, length in columns.items():
        col = F.col(f"`{name}`")
        if mask.type == "FIXED":
            masked[name] = mask_fixed(col, mask.char, mask.length, length)
        elif mask.type == "ORIGINAL":
            masked[name] = mask_original(col, mask.char, mask.on_empty)
        else:
            masked[name] = mask_random(col, mask.char, length, keys, mask.seed, f"{salt}.{name}")
    return df.withColumns(masked)


def mask_columns(
    dfs: dict[str, DataFrame], catalog: Catalog, targets: list[MaskTarget], mask: Mask
) -> dict[str, DataFrame]:
    """Apply one mask to the listed columns of ``dfs``; other tables pass through untouched.

    The config is checked against the catalog before any work.
    """
    facts = _target_facts(catalog, targets)
    errors = [f"{name}.{column}: {fact['error']}" for (name, column), fact in facts.items() if fact["error"]]
    errors += [f"{name}: no data" for name in sorted({n for n, _ in facts} - set(dfs))]
    if errors:
        raise ValueError("; ".join(errors))
    out = dict(dfs)
    for name in {n for n, _ in facts}:
        lengths = {column: fact["max_length"] for (table, column), fact in facts.items() if table == name}
        pk = next(fact["pk"] for (table, _), fact in facts.items() if table == name)
        out[name] = mask_table(dfs[name], lengths, mask, pk, name)
    return out


def _target_facts(catalog: Catalog, targets: list[MaskTarget]) -> dict[tuple[str, str], dict]:
    """Per (table, column) asked for: the error or None, the declared length, the key columns.

    One job; its result has one row per target.
    """
    table_key = [F.coalesce("schema", F.lit("")).alias("_schema"), F.col("table").alias("_table")]
    config = targets_frame(catalog.columns.sparkSession, targets).select(*table_key, "column")
    known = catalog.tables.select(*table_key, F.lit(True).alias("_known")).distinct()
    columns = catalog.columns.select(*table_key, F.col("name").alias("column"), "max_length", F.lit(True).alias("_found"))
    keys = catalog.keys.select(*table_key, F.col("columns").alias("pk"))
    error = F.when(F.col("_known").isNull(), "table not found").when(F.col("_found").isNull(), "column not found")
    rows = (
        config.join(known, ["_schema", "_table"], "left")
        .join(columns, ["_schema", "_table", "column"], "left")
        .join(keys, ["_schema", "_table"], "left")
        .withColumn("error", error)
        .collect()
    )
    return {(qualify(r["_schema"], r["_table"]), r["column"]): r.asDict() for r in rows}
