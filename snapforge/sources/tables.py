"""Full table reads from Parquet folders and JDBC sources."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.catalog import Catalog
from snapforge.functions.names import qualify
from snapforge.sources.vendor_catalogs import QUERIES, catalog_from_views, vendor_catalog

# Connection limit of one source, rows fetched per round trip.
MAX_CONNECTIONS = 20
FETCH_SIZE = 1000

# Types whose values the predicates of a keyset can name exactly.
KEY_TYPES = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)

# Per vendor, a whole-row hash that splits a table without a usable key.
_ROW_HASH = {
    "POSTGRES": "abs(hashtext(t::text)::bigint)",
    "MYSQL": "crc32(concat_ws('|-|', {columns}))",
    "SQLSERVER": "abs(cast(binary_checksum(*) as bigint))",
}
_OWN_SCHEMA = {"POSTGRES": "current_schema()", "MYSQL": "database()", "SQLSERVER": "schema_name()"}
_QUOTES = {"POSTGRES": '"{}"', "MYSQL": "`{}`", "SQLSERVER": "[{}]"}


@dataclass(frozen=True)
class JdbcSource:
    """Connection settings of one database; ``source_type`` is POSTGRES, MYSQL or SQLSERVER."""

    url: str
    source_type: str
    properties: dict = field(default_factory=dict)
    read_only: bool = False
    connections: int = MAX_CONNECTIONS

    def quote(self, name: str) -> str:
        return _QUOTES[self.source_type].format(name)

    def quote_table(self, table: str) -> str:
        return ".".join(self.quote(part) for part in table.split("."))

    def reader(self, spark: SparkSession):
        options = {"url": self.url, "fetchsize": str(FETCH_SIZE), **self.properties}
        return spark.read.format("jdbc").options(**options)


def split_options(dtype: T.DataType, low, high, partitions: int, column: str) -> dict[str, str]:
    """Options of a strided JDBC read over a numeric, date or timestamp column."""
    if not isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType)):
        raise ValueError(f"cannot stride over {dtype.simpleString()}")
    return {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def hash_predicates(source_type: str, columns: list[str], partitions: int) -> list[str]:
    """Disjoint predicates that cover a whole table by a row hash, for tables without a key."""
    quoted = ", ".join(_QUOTES[source_type].format(c) for c in columns)
    row_hash = _ROW_HASH[source_type].format(columns=quoted)
    return [f"{row_hash} % {partitions} = {i}" for i in range(partitions)]


def _literal(source_type: str, value) -> str:
    """A key value as the vendor's SQL writes it."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} is no key value")
    if isinstance(value, (int, Decimal)):
        return str(value)
    text = str(value)
    if source_type == "MYSQL":
        text = text.replace("\\", "\\\\")
    prefix = "N" if source_type == "SQLSERVER" and isinstance(value, str) else ""
    return prefix + "'" + text.replace("'", "''") + "'"


def keyset_query(source: JdbcSource, table: str, pk: list[str], partitions: int) -> str:
    """Query for the first key of every part but the first, when the rows in key order are cut into parts of equal size.

    The database orders and compares the keys, so its own collation holds. It reads the index of the key.
    """
    keys = ", ".join(source.quote(c) for c in pk)
    numbered = f"select {keys}, row_number() over (order by {keys}) - 1 as snap_row, count(*) over () as snap_rows from {source.quote_table(table)}"
    # In whole numbers, row r of n is in part r * partitions div n; a part begins where that changes.
    part = f"(snap_row * {partitions} - (snap_row * {partitions}) % snap_rows) / snap_rows"
    last = f"((snap_row - 1) * {partitions} - ((snap_row - 1) * {partitions}) % snap_rows) / snap_rows"
    return f"select snap_row, {keys} from ({numbered}) q where snap_row > 0 and {part} <> {last}"


def keyset_predicates(source: JdbcSource, pk: list[str], bounds: list[tuple]) -> list[str]:
    """Disjoint predicates that cover a table with the key ``pk`` (without nulls), cut before each of the sorted ``bounds``.

    They are written without row values, which not all vendors compare: (a > 1 or (a = 1 and b >= 2)).
    """
    columns = [source.quote(c) for c in pk]

    def beyond(bound: tuple, op: str) -> str:
        values = [_literal(source.source_type, v) for v in bound]
        text = f"{columns[-1]} {op} {values[-1]}"
        for column, value in list(zip(columns, values))[-2::-1]:
            text = f"({column} {op[0]} {value} or ({column} = {value} and {text}))"
        return text

    parts = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        sides = ([beyond(low, ">=")] if low is not None else []) + ([beyond(high, "<")] if high is not None else [])
        parts.append(" and ".join(sides) or "1 = 1")
    return parts


def aggregate_query(source: JdbcSource, table: str, **columns: str) -> str:
    """Query that computes one aggregate per output column inside the database."""
    fields = ", ".join(f"{expr} as {source.quote(name)}" for name, expr in columns.items())
    return f"select {fields} from {source.quote_table(table)}"


def table_row_count(spark: SparkSession, source: JdbcSource, table: str) -> int:
    """COUNT(*) of a database table, computed there."""
    query = aggregate_query(source, table, row_count="count(*)")
    return int(source.reader(spark).option("query", query).load().head()[0])


def table_maxima(spark: SparkSession, source: JdbcSource, table: str, columns: list[str]) -> DataFrame:
    """One row with the maxima of ``columns`` under their own names, computed in the database.

    The maximum of a maximum is the same, so ``next_sequence_values`` takes this frame in place of
    the table and no rows are read.
    """
    query = aggregate_query(source, table, **{c: f"max({source.quote(c)})" for c in columns})
    return source.reader(spark).option("query", query).load()


def table_exists(spark: SparkSession, source: JdbcSource, table: str) -> bool:
    """Whether the database has the table; a name without schema is looked up in the connection's own."""
    schema, _, name = table.rpartition(".")
    if not schema:
        schema = source.reader(spark).option("query", f"select {_OWN_SCHEMA[source.source_type]} as own").load().head()[0]
    views = source.reader(spark).option("dbtable", "information_schema.tables").load()
    views = views.toDF(*[c.lower() for c in views.columns])
    return not views.filter((F.col("table_name") == name) & (F.col("table_schema") == schema)).isEmpty()


def sorted_bounds(found: DataFrame, pk: list[str]) -> list[tuple]:
    """The keys of a ``keyset_query`` in the order in which the database has numbered their rows."""
    return [tuple(r[c] for c in pk) for r in found.orderBy("snap_row").collect()]  # one key per part


def scan_table(
    spark: SparkSession,
    source: JdbcSource,
    table: str,
    pk: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Read a whole table in parallel.

    A table with a key of numbers, texts, dates or timestamps is cut at keys that the database finds in its key order, so
    the parts have equally many rows however the keys are spread (one query over the key, run when this is called, which
    returns one key per part). Any other table is split by a row hash. Order is not part of the read, ``page_number``
    applies it.
    """
    n = partitions or source.connections
    plain = source.reader(spark).option("dbtable", source.quote_table(table))
    schema = plain.load().schema
    properties = {"fetchsize": str(FETCH_SIZE), **source.properties}
    if pk and all(isinstance(schema[c].dataType, KEY_TYPES) for c in pk):
        found = source.reader(spark).option("query", keyset_query(source, table, pk, n)).load()
        bounds = sorted_bounds(found, pk)
        if not bounds:
            return plain.load()
        return spark.read.jdbc(source.url, source.quote_table(table), predicates=keyset_predicates(source, pk, bounds), properties=properties)
    aliased = f"{source.quote_table(table)} t"
    predicates = hash_predicates(source.source_type, schema.fieldNames(), n)
    return spark.read.jdbc(source.url, aliased, predicates=predicates, properties=properties)


def scan_tables(spark: SparkSession, source: JdbcSource, catalog: Catalog) -> dict[str, DataFrame]:
    """All tables of a catalog by qualified name; nothing is read until they are used."""
    named = catalog.tables.select("schema", "table").orderBy("schema", "table").collect()
    return {
        qualify(r["schema"], r["table"]): scan_table(
            spark, source, qualify(r["schema"], r["table"]), catalog.primary_key(r["schema"], r["table"])
        )
        for r in named
    }


def read_folder(spark: SparkSession, root: str, tables: Iterable[str], pattern: str = "{}.parquet") -> dict[str, DataFrame]:
    """All named Parquet tables below one folder."""
    return {t: spark.read.parquet(f"{root}/{pattern.format(t)}") for t in tables}


def parquet_facts(spark: SparkSession, path: str, columns: Iterable[str] = ()) -> DataFrame:
    """One row with ``row_count`` and the maxima of ``columns`` under their own names, of a Parquet table.

    Count and maxima of numbers and dates come from the footers, no row is read; Spark's own pushdown of aggregates decides
    that, and scans the columns where a footer does not say (texts, timestamps, files without statistics).
    ``next_sequence_values`` takes this frame in place of the table.
    """
    # A session of its own, since the setting decides how all its tables are read.
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = session.read.parquet(path)
    names = list(columns)
    facts = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.max(f"`{c}`").alias(c) for c in names])
    return spark.createDataFrame([tuple(facts.head())], facts.schema)


def read_catalog(spark: SparkSession, source: JdbcSource, schemas: Iterable[str]) -> Catalog:
    """Catalog of a database, from its system views, see ``vendor_catalog``."""
    queries = QUERIES[source.source_type]

    def view(name: str) -> DataFrame:
        reader = source.reader(spark)
        where = ("query", queries[name]) if name in queries else ("dbtable", f"information_schema.{name}")
        df = reader.option(*where).load()
        return df.toDF(*[c.lower() for c in df.columns])

    return vendor_catalog(spark, source.source_type, view, schemas)


__all__ = [
    "JdbcSource",
    "aggregate_query",
    "catalog_from_views",
    "hash_predicates",
    "keyset_predicates",
    "keyset_query",
    "parquet_facts",
    "read_catalog",
    "read_folder",
    "scan_table",
    "scan_tables",
    "sorted_bounds",
    "split_options",
    "table_exists",
    "table_maxima",
    "table_row_count",
]
