"""The three ways the operators are used together, as plain functions, with a run log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.catalog import Catalog
from snapforge.functions.names import qualify
from snapforge.operators.diff import diff_catalog, diff_columns
from snapforge.operators.evolve import OpResult, evolve_table, ops_of
from snapforge.operators.manifest import RUN_LOG
from snapforge.operators.masking import Mask, MaskTarget, mask_columns
from snapforge.operators.schema_map import map_schema
from snapforge.session import local_frame
from snapforge.sinks.restore import restore_all
from snapforge.sinks.snapshots import Storage, write_catalog, write_fanout
from snapforge.sources.snapshots import read_stored_catalog, read_version


@dataclass
class RunLog:
    """Steps of one run in order. A failed step ends the run; the steps after it are SKIPPED."""

    run_id: int
    flow: str
    rows: list[tuple] = field(default_factory=list)

    def run(self, steps: list[tuple[str, Callable[[], object]]]) -> list[object]:
        """Run named steps one after another and record status and times; raises the first failure."""
        results: list[object] = []
        failure: Exception | None = None
        for i, (kind, step) in enumerate(steps):
            start = datetime.now(UTC)
            status = "SKIPPED"
            if failure is None:
                try:
                    results.append(step())
                    status = "SUCCESS"
                except Exception as e:  # noqa: BLE001 - recorded, then raised below
                    failure, status = e, "FAILED"
            self.rows.append((self.run_id, self.flow, i, kind, status, start, datetime.now(UTC)))
        if failure is not None:
            raise failure
        return results

    def frame(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.rows, RUN_LOG)

    def append_to(self, spark: SparkSession, path: str) -> None:
        """Add this run to a stored run log."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    def tags(self) -> dict[str, str]:
        """Tags of a version made by this run: date, time and flow."""
        now = datetime.now(UTC)
        return {"date": now.strftime("%Y-%m-%d"), "time": now.strftime("%H:%M:%S"), "flow": self.flow}


def primary_keys(catalog: Catalog) -> dict[str, list[str]]:
    """Key columns by qualified table name; one row per table."""
    rows = catalog.keys.select("schema", "table", "columns").collect()
    return {qualify(r["schema"], r["table"]): list(r["columns"]) for r in rows}


def backup(
    dfs: dict[str, DataFrame], catalog: Catalog, storages: list[Storage], data: str, version: int, log: RunLog | None = None
) -> DataFrame:
    """Store all tables in key order, and the catalog, in every storage; returns the manifest rows."""
    log = log or RunLog(version, f"backup {data}")

    def store() -> DataFrame:
        rows = write_fanout(dfs, storages, data, version, primary_keys(catalog), log.tags())
        for s in storages:
            write_catalog(catalog, s, data, version)
        return rows

    return log.run([("To", store)])[0]


def masked_restore(
    spark: SparkSession,
    storage: Storage,
    data: str,
    version: int,
    target,
    masks: list[tuple[list[MaskTarget], Mask]] = (),
    schema_map: tuple[str, str] | None = None,
    log: RunLog | None = None,
) -> DataFrame:
    """Read a version with its catalog, mask columns, rename a schema, and load it into ``target``."""
    log = log or RunLog(version, f"restore {data}")
    state: dict = {}

    def read() -> None:
        state["dfs"] = read_version(spark, storage.root, data, version)
        state["catalog"] = read_stored_catalog(spark, storage.root, data, version)

    def mask() -> None:
        for targets, m in masks:
            state["dfs"] = mask_columns(state["dfs"], state["catalog"], targets, m)

    def rename() -> None:
        if schema_map:
            state["catalog"], state["dfs"] = map_schema(state["catalog"], state["dfs"], *schema_map)

    return log.run(
        [
            ("From", read),
            ("MaskColumns", mask),
            ("SchemaMapping", rename),
            ("To", lambda: restore_all(state["dfs"], state["catalog"], target)),
        ]
    )[-1]


def update_schema(
    dfs: dict[str, DataFrame],
    wanted: Catalog,
    current: Catalog,
    dry_run: bool = False,
    continue_on_error: bool = True,
    skip_sequences: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame, dict[str, list[OpResult]]]:
    """Bring the tables ``dfs`` of catalog ``current`` to the columns of ``wanted``.

    Returns the new tables, the planned changes, and the outcome per table. A dry run returns the
    tables as they are. Dropped tables leave the result; a created table has no data here.
    """
    changes = diff_catalog(wanted, current, skip_sequences)
    if dry_run:
        return dfs, changes, {}
    # Column changes and orders of all tables, read once: as many rows as the catalogs have columns.
    by_table: dict[tuple[str, str], list] = {}
    for r in diff_columns(wanted, current).collect():
        by_table.setdefault((r["schema"], r["table"]), []).append(r)
    ordinals = _ordinals(wanted)
    out = dict(dfs)
    outcomes: dict[str, list[OpResult]] = {}
    for (schema, table), rows in by_table.items():
        name = qualify(schema, table)
        if name in out:
            out[name], outcomes[name] = evolve_table(out[name], ops_of(rows), ordinals.get((schema, table), []), continue_on_error)
    dropped = changes.filter("entity = 'table' and op = 'DROP'").select("qualified_name").collect()
    for r in dropped:
        out.pop(r[0], None)
    return out, changes, outcomes


def _ordinals(catalog: Catalog) -> dict[tuple[str, str], list[str]]:
    """Column names in ordinal order by (schema, table)."""
    listed = catalog.columns.groupBy(F.coalesce("schema", F.lit("")).alias("schema"), "table").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda c: c["name"]).alias("names")
    )
    return {(r["schema"], r["table"]): list(r["names"]) for r in listed.collect()}
