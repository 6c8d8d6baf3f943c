"""Load tables into a target in foreign-key order, clear and drop them."""

from __future__ import annotations

import zlib
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from snapforge.catalog import Catalog, CatalogHook
from snapforge.functions.names import qualified_name, qualify
from snapforge.operators.graph import catalog_edges, load_order
from snapforge.session import local_frame
from snapforge.sinks.snapshots import guard_writable
from snapforge.sources.tables import JdbcSource, table_exists, table_row_count

# Rows per insert batch, tables restored at the same time.
BATCH_SIZE = 1_000
PARALLELISM = 10

REPORT = "table string, level int, status string, row_count bigint, message string"


class RestoreError(RuntimeError):
    """A table could not be loaded; ``report`` has one row per table."""

    def __init__(self, message: str, report: list[tuple]):
        super().__init__(message)
        self.report = report


@dataclass(frozen=True)
class JdbcTarget:
    """Tables of a database. The writer opens one connection per partition, ``connections`` at most.

    Every partition is inserted in its own transaction. A task that was lost after its commit runs
    again and would insert its rows twice, so the rows in the table are counted around the write.
    """

    source: JdbcSource

    @property
    def read_only(self) -> bool:
        return self.source.read_only

    @property
    def source_type(self) -> str:
        return self.source.source_type

    def _writer(self, df: DataFrame, table: str):
        s = self.source
        return df.write.format("jdbc").options(
            url=s.url, dbtable=s.quote_table(table), batchsize=str(BATCH_SIZE), numPartitions=str(s.connections), **s.properties
        )

    def append(self, df: DataFrame, table: str) -> None:
        self._writer(df, table).mode("append").save()

    def count(self, spark: SparkSession, table: str) -> int:
        return table_row_count(spark, self.source, table) if table_exists(spark, self.source, table) else 0

    def clear(self, spark: SparkSession, table: str) -> None:
        empty = self.source.reader(spark).option("dbtable", self.source.quote_table(table)).load().limit(0)
        self._writer(empty, table).option("truncate", "true").mode("overwrite").save()

    def drop(self, spark: SparkSession, table: str) -> None:
        """Through Spark's table catalog of the database, whose connection settings stay in the session."""
        s = self.source
        name = f"snapforge_{zlib.crc32(s.url.encode())}"
        base = f"spark.sql.catalog.{name}"
        spark.conf.set(base, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for key, value in {"url": s.url, **s.properties}.items():
            spark.conf.set(f"{base}.{key}", value)
        quoted = ".".join(f"`{part.replace('`', '``')}`" for part in table.split("."))
        spark.sql(f"DROP TABLE IF EXISTS {name}.{quoted}")

    def check_load(self, catalog: Catalog) -> None:
        """Refuse, before the first row, what the database would refuse."""
        if self.source_type != "SQLSERVER":
            return
        counted = catalog.columns.filter("identity").select(qualified_name(F.col("schema"), F.col("table")).alias("q"))
        named = [r["q"] for r in counted.distinct().orderBy("q").collect()]
        if named:
            raise ValueError(f"explicit identity values cannot be written over JDBC: {named}")

    def check_clear(self, catalog: Catalog, tables: list[str]) -> None:
        """Clearing truncates, and no database truncates a table that another one refers to."""
        edges = catalog_edges(catalog.foreign_keys).filter("src <> ref").select("ref").distinct()
        used = sorted({r["ref"] for r in edges.collect()} & set(tables))
        if used:
            raise ValueError(f"foreign keys refer to {used}; delete their rows in the database")


@dataclass(frozen=True)
class TableTarget:
    """Tables of a Spark catalog namespace; schemas become part of the table name."""

    namespace: str
    source_type: str | None = None
    read_only: bool = False
    fmt: str = "parquet"

    def ident(self, table: str) -> str:
        return f"{self.namespace}.`{table}`"

    def append(self, df: DataFrame, table: str) -> None:
        if df.sparkSession.catalog.tableExists(self.ident(table)):
            order = df.sparkSession.table(self.ident(table)).columns
            df.select(*[f"`{c}`" for c in order]).write.mode("append").insertInto(self.ident(table))
        else:
            df.write.format(self.fmt).saveAsTable(self.ident(table))

    def clear(self, spark: SparkSession, table: str) -> None:
        spark.sql(f"TRUNCATE TABLE {self.ident(table)}")

    def drop(self, spark: SparkSession, table: str) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.ident(table)}")


def restore_table(df: DataFrame, target, table: str) -> int:
    """Append all rows, key and identity values included; creates the table if missing.

    Returns the number of rows written, counted while writing. A target whose appends are not
    atomic has a ``count``; its table must have grown by exactly that number.
    """
    guard_writable(target)
    spark = df.sparkSession
    before = target.count(spark, table) if hasattr(target, "count") else None
    seen = Observation()
    target.append(df.observe(seen, F.count(F.lit(1)).alias("n")), table)
    written = int(seen.get.get("n", 0))
    if before is not None:
        grown = target.count(spark, table) - before
        if grown != written:
            raise RuntimeError(f"{table} grew by {grown} rows instead of {written}; clear it and restore again")
    return written


def table_levels(catalog: Catalog) -> list[list[str]]:
    """Qualified table names, parents before children, one list per level.

    Names of tables, so its size is that of a database schema.
    """
    nodes = catalog.tables.select(qualified_name(F.col("schema"), F.col("table")).alias("node"))
    rows = load_order(catalog_edges(catalog.foreign_keys), nodes).orderBy("level", "node").collect()
    levels: list[list[str]] = [[] for _ in range(1 + max((r["level"] for r in rows), default=-1))]
    for r in rows:
        levels[r["level"]].append(r["node"])
    return levels


def restore_all(
    dfs: dict[str, DataFrame],
    catalog: Catalog,
    target,
    processors: tuple[CatalogHook, ...] = (),
    parallelism: int = PARALLELISM,
) -> DataFrame:
    """Load every table of the catalog, parents before children; one report row per table.

    A table starts as soon as all tables that it refers to are loaded, ``parallelism`` of them at the same time. After a
    failure no other table is started, and ``RestoreError`` is raised with the report.
    """
    guard_writable(target)
    for process in processors:
        catalog = process(catalog)
    if catalog.source_type and target.source_type and catalog.source_type != target.source_type:
        raise ValueError(f"cannot restore {catalog.source_type} into {target.source_type}")
    if hasattr(target, "check_load"):
        target.check_load(catalog)
    levels = table_levels(catalog)
    missing = [t for level in levels for t in level if t not in dfs]
    if missing:
        raise ValueError(f"no data for tables {missing}")
    spark = catalog.tables.sparkSession
    level_of = {t: n for n, level in enumerate(levels) for t in level}
    # References that load order goes against are those of a broken cycle.
    waits: dict[str, set[str]] = {t: set() for t in level_of}
    for r in catalog_edges(catalog.foreign_keys).select("src", "ref").distinct().collect():  # one row per pair of tables
        if level_of[r["ref"]] < level_of[r["src"]]:
            waits[r["src"]].add(r["ref"])

    def load(table: str) -> tuple:
        try:
            return table, level_of[table], "SUCCESS", restore_table(dfs[table], target, table), None
        except Exception as e:  # noqa: BLE001 - every failure belongs in the report
            return table, level_of[table], "FAILED", None, str(e)

    done: dict[str, tuple] = {}
    failed = False
    with ThreadPoolExecutor(parallelism) as pool:
        running = {pool.submit(load, t) for t in level_of if not waits[t]}
        while running:
            ended, running = wait(running, return_when=FIRST_COMPLETED)
            for row in (f.result() for f in ended):
                done[row[0]] = row
                failed = failed or row[2] == "FAILED"
            loaded = {f.result()[0] for f in ended}
            free = [t for t in level_of if waits[t] & loaded and waits[t] <= done.keys()] if not failed else []
            running |= {pool.submit(load, t) for t in free}
    report = [done.get(t, (t, n, "SKIPPED", None, None)) for t, n in level_of.items()]
    if failed:
        bad = [f"{r[0]}: {r[4]}" for r in report if r[2] == "FAILED"]
        raise RestoreError("; ".join(bad), report)
    return local_frame(spark, report, REPORT)


def _children_first(catalog: Catalog, names: list[str] | None) -> list[str]:
    ordered = [t for level in reversed(table_levels(catalog)) for t in level]
    if names is None:
        return ordered
    unknown = set(names) - set(ordered)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    return [t for t in ordered if t in set(names)]


def clear_tables(target, catalog: Catalog, names: list[str] | None = None) -> list[str]:
    """Delete all rows of the named tables, or of all, children first.

    A target that cannot clear a table refuses before any is cleared.
    """
    guard_writable(target)
    ordered = _children_first(catalog, names)
    if hasattr(target, "check_clear"):
        target.check_clear(catalog, ordered)
    for table in ordered:
        target.clear(catalog.tables.sparkSession, table)
    return ordered


def drop_tables(target, catalog: Catalog, names: list[str] | None = None, sequences: list[str] | None = None) -> Catalog:
    """Drop the named tables, or all, children first, then the sequences; returns the new catalog.

    Without ``sequences`` all of them go when all tables go, and none otherwise.
    """
    guard_writable(target)
    ordered = _children_first(catalog, names)
    for table in ordered:
        target.drop(catalog.tables.sparkSession, table)
    gone = F.col("_qname").isin(ordered)

    def rest(df: DataFrame, schema: str = "schema", table: str = "table") -> DataFrame:
        named = df.withColumn("_qname", qualified_name(F.col(schema), F.col(table)))
        return named.filter(~gone).drop("_qname")

    frames = {n: rest(df) for n, df in catalog.frames().items() if n not in ("sequences", "foreign_keys")}
    frames["foreign_keys"] = rest(rest(catalog.foreign_keys, "src_schema", "src_table"), "ref_schema", "ref_table")
    if sequences is not None:
        named = catalog.sequences.withColumn("_qname", qualified_name(F.col("schema"), F.col("name")))
        frames["sequences"] = named.filter(~F.col("_qname").isin(sequences)).drop("_qname")
    elif names is None:
        frames["sequences"] = catalog.sequences.filter(F.lit(False))
    return catalog.with_frames(**frames)


def missing_tables(catalog: Catalog, target: Catalog) -> list[str]:
    """Tables of ``catalog`` that the target lacks."""
    wanted = catalog.tables.select(qualified_name(F.col("schema"), F.col("table")).alias("q"))
    present = target.tables.select(qualified_name(F.col("schema"), F.col("table")).alias("q"))
    return [r["q"] for r in wanted.subtract(present).orderBy("q").collect()]


__all__ = [
    "JdbcTarget",
    "RestoreError",
    "TableTarget",
    "clear_tables",
    "drop_tables",
    "missing_tables",
    "qualify",
    "restore_all",
    "restore_table",
    "table_levels",
]
