"""A whole backup in the JSON interchange form: one catalog document and one file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.catalog import Catalog
from snapforge.functions.names import CATALOG_FILE, DATA_FILE_PREFIX, DATA_FILE_SUFFIX, qualify
from snapforge.functions.types import spark_type
from snapforge.sources.page_json import read_page_json

# Fixed value: shape of the catalog document.
CATALOG_DOCUMENT = """
    format string, sourceType string, schemas array<string>,
    tables map<string, struct<schema: string, name: string, pkColumnNames: array<string>, pkConstraintName: string,
      columns: map<string, struct<name: string, dataType: string, ordinalPosition: int, maxLength: bigint, columnType: string,
        numPrecision: int, numScale: int, columnKey: string, columnDefault: string, defaultConstraintName: string,
        nullable: boolean, identity: boolean>>>>,
    referenceInfos array<struct<constraintName: string, srcSchema: string, srcTableName: string, srcColumnNames: array<string>,
      refSchema: string, refTableName: string, refColumnNames: array<string>>>,
    contraintInfos array<struct<constraintName: string, schema: string, tableName: string, columnNames: array<string>>>,
    checkConstraints array<struct<schema: string, tableName: string, constraintName: string, condef: string>>,
    indexes map<string, map<string, struct<schemaName: string, tableName: string, indexName: string, unique: boolean,
      indexType: string, columns: array<string>, extraColumns: array<string>>>>,
    sequences array<struct<schema: string, name: string, startValue: bigint, minValue: bigint, maxValue: bigint,
      incrementBy: bigint, cycle: boolean, cacheSize: bigint, lastValue: bigint>>
"""
# The source that gives lengths in bytes, and its two-byte text types.
BYTE_LENGTH_SOURCE = "SQLSERVER"
TWO_BYTE_TYPES = ("nchar", "nvarchar")


def read_catalog_json(spark: SparkSession, path: str) -> Catalog:
    """The catalog of a ``db-model.json`` document.

    Lengths become characters: a negative one is no limit, and two-byte texts count half.
    """
    doc = spark.read.schema(CATALOG_DOCUMENT).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    facts = doc.select("sourceType", "schemas").head()
    if facts is None:
        raise ValueError(f"{path} is empty")
    tables = doc.select(F.explode(F.map_values("tables")).alias("t"))
    columns = tables.select(F.col("t.schema").alias("schema"), F.col("t.name").alias("table"), F.explode(F.map_values("t.columns")).alias("c"))
    length = F.when(F.col("c.maxLength").between(0, 2**31 - 1), F.col("c.maxLength"))
    if facts["sourceType"] == BYTE_LENGTH_SOURCE:
        length = F.when(F.lower("c.dataType").isin(*TWO_BYTE_TYPES), F.expr("c.maxLength div 2")).otherwise(length)
        length = F.when(F.col("c.maxLength") >= 0, length)

    def rows(source: str, **names: str) -> DataFrame:
        items = doc.select(F.explode(source).alias("i"))
        return items.select(*[F.col(f"i.{field}").alias(name) for name, field in names.items()])

    indexes = doc.select(F.explode(F.map_values("indexes")).alias("m")).select(F.explode(F.map_values("m")).alias("i"))
    return Catalog.of(
        spark,
        source_type=facts["sourceType"],
        schemas=facts["schemas"] or (),
        tables=tables.select("t.schema", F.col("t.name").alias("table")),
        columns=columns.select(
            "schema",
            "table",
            "c.name",
            F.col("c.ordinalPosition").alias("ordinal"),
            F.col("c.dataType").alias("data_type"),
            F.col("c.columnType").alias("column_type"),
            length.cast("int").alias("max_length"),
            F.col("c.numPrecision").alias("num_precision"),
            F.col("c.numScale").alias("num_scale"),
            F.col("c.columnKey").alias("column_key"),
            F.col("c.columnDefault").alias("column_default"),
            F.col("c.defaultConstraintName").alias("default_constraint"),
            "c.nullable",
            "c.identity",
        ),
        keys=tables.filter(F.size("t.pkColumnNames") > 0).select(
            "t.schema", F.col("t.name").alias("table"), F.col("t.pkConstraintName").alias("constraint"), F.col("t.pkColumnNames").alias("columns")
        ),
        foreign_keys=rows(
            "referenceInfos", constraint="constraintName", src_schema="srcSchema", src_table="srcTableName",
            src_columns="srcColumnNames", ref_schema="refSchema", ref_table="refTableName", ref_columns="refColumnNames",
        ),
        uniques=rows("contraintInfos", schema="schema", table="tableName", constraint="constraintName", columns="columnNames"),
        checks=rows("checkConstraints", schema="schema", table="tableName", constraint="constraintName", condef="condef"),
        indexes=indexes.select(
            F.col("i.schemaName").alias("schema"), F.col("i.tableName").alias("table"), F.col("i.indexName").alias("name"), "i.unique",
            F.col("i.indexType").alias("type"), "i.columns", F.col("i.extraColumns").alias("extra_columns"),
        ),
        sequences=rows(
            "sequences", schema="schema", name="name", start_value="startValue", min_value="minValue", max_value="maxValue",
            increment_by="incrementBy", cycle="cycle", cache_size="cacheSize", last_value="lastValue",
        ),
    )


def table_schemas(catalog: Catalog) -> dict[str, T.StructType]:
    """Spark schema per qualified table name, columns in ordinal order; as large as the catalog."""
    rows = catalog.columns.select("schema", "table", "name", "ordinal", "data_type", "num_precision", "num_scale").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["ordinal"] is None, r["ordinal"], r["name"])):
        kind = spark_type(r["data_type"], r["num_precision"], r["num_scale"])
        out.setdefault(qualify(r["schema"], r["table"]), []).append((r["name"], kind))
    return {t: T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in cols)) for t, cols in out.items()}


def data_path(folder: str, table: str) -> str:
    return f"{folder}/{DATA_FILE_PREFIX}{table}{DATA_FILE_SUFFIX}"


def read_backup(spark: SparkSession, folder: str, multi_line: bool = False) -> tuple[Catalog, dict[str, DataFrame]]:
    """Catalog and tables of a backup folder; ``multi_line`` for documents that span lines."""
    catalog = read_catalog_json(spark, f"{folder}/{CATALOG_FILE}")
    tables = {
        t: read_page_json(spark, data_path(folder, t), schema, multi_line=multi_line) for t, schema in table_schemas(catalog).items()
    }
    return catalog, tables
