"""Write a whole backup in the JSON interchange form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.catalog import Catalog
from snapforge.functions.names import CATALOG_FILE, qualified_name, qualify
from snapforge.session import local_frame
from snapforge.sources.interchange import data_path
from snapforge.sources.page_json import write_page_json


def _listed(df: DataFrame, **names: str):
    """One-row frame with all rows of a catalog frame as an array of structs."""
    return df.agg(F.collect_list(F.struct(*[F.col(column).alias(field) for field, column in names.items()])).alias("v"))


def catalog_document(catalog: Catalog) -> DataFrame:
    """The catalog as one JSON document (column ``value``). Its size is that of the schema."""
    table = qualified_name(F.col("schema"), F.col("table"))
    column = F.struct(
        "name", F.col("data_type").alias("dataType"), F.col("ordinal").alias("ordinalPosition"), F.col("max_length").alias("maxLength"),
        F.col("column_type").alias("columnType"), F.col("num_precision").alias("numPrecision"), F.col("num_scale").alias("numScale"),
        F.col("column_key").alias("columnKey"), F.col("column_default").alias("columnDefault"),
        F.col("default_constraint").alias("defaultConstraintName"), "nullable", "identity",
    )
    columns = catalog.columns.groupBy(table.alias("q")).agg(F.map_from_entries(F.collect_list(F.struct("name", column))).alias("columns"))
    keys = catalog.keys.select(table.alias("q"), F.col("constraint").alias("pkConstraintName"), F.col("columns").alias("pkColumnNames"))
    tables = (
        catalog.tables.select(table.alias("q"), "schema", F.col("table").alias("name")).join(keys, "q", "left").join(columns, "q", "left")
    )
    body = F.struct("schema", "name", F.coalesce("pkColumnNames", F.array()).alias("pkColumnNames"), "pkConstraintName", "columns")
    by_index = catalog.indexes.groupBy(table.alias("q")).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "name",
                    F.struct(
                        F.col("schema").alias("schemaName"), F.col("table").alias("tableName"), F.col("name").alias("indexName"), "unique",
                        F.col("type").alias("indexType"), "columns", F.col("extra_columns").alias("extraColumns"),
                    ),
                )
            )
        ).alias("m")
    )
    parts = {
        "tables": tables.agg(F.map_from_entries(F.collect_list(F.struct("q", body))).alias("v")),
        "referenceInfos": _listed(
            catalog.foreign_keys, constraintName="constraint", srcSchema="src_schema", srcTableName="src_table", srcColumnNames="src_columns",
            refSchema="ref_schema", refTableName="ref_table", refColumnNames="ref_columns",
        ),
        "contraintInfos": _listed(catalog.uniques, constraintName="constraint", schema="schema", tableName="table", columnNames="columns"),
        "checkConstraints": _listed(catalog.checks, schema="schema", tableName="table", constraintName="constraint", condef="condef"),
        "indexes": by_index.agg(F.map_from_entries(F.collect_list(F.struct("q", "m"))).alias("v")),
        "sequences": _listed(
            catalog.sequences, schema="schema", name="name", startValue="start_value", minValue="min_value", maxValue="max_value",
            incrementBy="increment_by", cycle="cycle", cacheSize="cache_size", lastValue="last_value",
        ),
    }
    facts = local_frame(
        catalog.tables.sparkSession, [(catalog.source_type, list(catalog.schemas or ()))], "sourceType string, schemas array<string>"
    )
    # One row "name": value per property; they make up the document.
    properties = facts.select(F.concat(F.lit('"schemas":'), F.to_json("schemas")).alias("p"))
    if catalog.source_type:
        properties = properties.union(facts.select(F.concat(F.lit('"sourceType":"'), "sourceType", F.lit('"'))))
    for name, one in parts.items():
        properties = properties.union(one.select(F.concat(F.lit(f'"{name}":'), F.to_json("v"))))
    return properties.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("p")), ","), F.lit("}")).alias("value"))


def write_backup(dfs: dict[str, DataFrame], catalog: Catalog, folder: str, compression: str | None = None) -> None:
    """Catalog document and one data file per table, each a folder of JSON lines."""
    keys = {qualify(r["schema"], r["table"]): list(r["columns"]) for r in catalog.keys.collect()}  # one row per table
    for table, df in dfs.items():
        write_page_json(df, data_path(folder, table), table, keys.get(table), compression)
    catalog_document(catalog).coalesce(1).write.mode("errorifexists").text(f"{folder}/{CATALOG_FILE}")
