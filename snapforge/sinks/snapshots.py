"""Store, copy and delete versions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.catalog import Catalog
from snapforge.operators.manifest import MANIFEST, assert_capacity, capacity_check, retention_select
from snapforge.operators.paging import partition_offsets, write_positioned
from snapforge.session import create_exclusive, delete_path, hadoop_path, local_frame, path_exists
from snapforge.sources.snapshots import (
    CATALOG_FACTS,
    catalog_path,
    claim_path,
    manifest_path,
    offsets_path,
    read_manifest,
    read_stored_catalog,
    table_path,
    version_path,
)

# Content type of a stored table, tables written at the same time.
CONTENT_TYPE = "application/vnd.apache.parquet"
PARALLELISM = 10


@dataclass(frozen=True)
class Storage:
    """A place for snapshots. ``record`` enters its files in the manifest; ``capacity`` in bytes."""

    name: str
    root: str
    record: bool = True
    read_only: bool = False
    capacity: int | None = None


def guard_writable(target) -> None:
    """Refuse to change a read-only target."""
    if getattr(target, "read_only", False):
        raise PermissionError(f"{getattr(target, 'name', target)} is read-only")


def _check_name(kind: str, name: str) -> None:
    """Names become folder names, so they keep to characters that need no escaping."""
    if not re.fullmatch(r"[\w.$-]+", name):
        raise ValueError(f"{kind} name {name!r} cannot be a folder name")


class _Room:
    """What a storage has left for a version: asked before every table, told the size of every table that is written.

    A version that does not fit is given up at the first table that goes beyond the capacity; tables that have not
    begun by then are not written. A storage without capacity has room for all.
    """

    def __init__(self, spark: SparkSession, storage: Storage, data: str, version: int):
        self._capacity, self._taken, self._lock = storage.capacity, 0, Lock()
        if self._capacity is not None:
            # As many rows as there are stored tables, read once: others that write at the same time are seen at the commit.
            used = capacity_check(_stored(spark, storage, data, version), self._capacity, 0).head()["used_size"]
            self._used = local_frame(spark, [(int(used),)], "size bigint")
        self.need(1)

    def need(self, size: int) -> None:
        """An error unless ``size`` more bytes fit."""
        if self._capacity is not None:
            assert_capacity(self._used, self._capacity, self._taken + size)

    def take(self, size: int) -> None:
        with self._lock:
            self._taken += size
        self.need(0)


def _each_table(names, work: Callable[[str], int], room: _Room) -> dict[str, int]:
    """Run ``work`` for every table, several at a time, so that small tables do not wait in line."""

    def one(table: str) -> int:
        room.need(0)
        size = work(table)
        room.take(size)
        return size

    with ThreadPoolExecutor(PARALLELISM) as pool:
        return dict(zip(names, pool.map(one, names)))


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, from the file system listing; 0 if there is none."""
    fs, target = hadoop_path(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def _record(
    spark: SparkSession, storage: Storage, data: str, version: int, sizes: dict[str, int], tags: dict[str, str] | None, now: datetime
) -> DataFrame:
    rows = [
        (data, version, table, f"data={data}/version={version}", CONTENT_TYPE, size, [storage.name], tags or {}, now)
        for table, size in sizes.items()
    ]
    return local_frame(spark, rows, MANIFEST)


def _write_manifest(rows: DataFrame, root: str) -> None:
    # The key columns are partition folders, so a version's entries can be removed alone.
    rows.coalesce(1).write.mode("append").partitionBy("data", "version").parquet(manifest_path(root))


def write_snapshot(
    dfs: dict[str, DataFrame],
    storage: Storage,
    data: str,
    version: int,
    pks: dict[str, list[str]] | None = None,
    tags: dict[str, str] | None = None,
    compression: str = "zstd",
    nulls: str = "last",
    ordered: bool = True,
) -> DataFrame:
    """Store every table of a version in key order; returns its manifest rows.

    Rows go through one range shuffle and are written once; the stored position column gives row
    numbers and pages later without another sort. With ``ordered`` off there is no shuffle: rows
    keep the order of the input, and so do the pages. An existing version is an error, and so is
    an empty set of tables. When a table fails, the whole version is taken away again. A full storage
    is an error before anything is written; one that gets full ends the write at the table that does not fit.
    """
    guard_writable(storage)
    if not dfs:
        raise ValueError("nothing to store")
    _check_name("data", data)
    for table in dfs:
        _check_name("table", table)
    spark = next(iter(dfs.values())).sparkSession

    def store(table: str) -> int:
        path = table_path(storage.root, data, version, table)
        parts = offsets_path(storage.root, data, version, table)
        write_positioned(dfs[table], path, parts, (pks or {}).get(table), nulls, compression, ordered)
        return folder_size(spark, path)

    with _whole_version(spark, storage, data, version):
        room = _Room(spark, storage, data, version)
        return _finish(spark, storage, data, version, _each_table(list(dfs), store, room), tags)


@contextmanager
def _whole_version(spark: SparkSession, storage: Storage, data: str, version: int) -> Iterator[None]:
    """Claims a new version for this writer, and takes it away again when writing it fails.

    The claim is a file that only one of several writers can create, made before the first write and removed after the
    last. Readers do not read a claimed version, and only its owner deletes what a failure leaves. The claim of a writer
    that has died stays; ``delete_version`` removes it together with what there is of the version.
    """
    claim = claim_path(storage.root, data, version)
    owner = f"{spark.sparkContext.applicationId} {uuid.uuid4().hex}"
    if not create_exclusive(spark, claim, owner):
        raise FileExistsError(f"version {version} of {data} is being written in {storage.name}")
    try:
        if path_exists(spark, version_path(storage.root, data, version)):
            raise FileExistsError(f"version {version} of {data} exists in {storage.name}")
        try:
            yield
        except BaseException:
            _remove(spark, storage, data, version)
            raise
    finally:
        delete_path(spark, claim)


def _stored(spark: SparkSession, storage: Storage, data: str, version: int) -> DataFrame:
    """Manifest rows of what a storage holds already; without a manifest one row with the size of its folders."""
    if storage.record:
        return read_manifest(spark, storage.root)
    held = folder_size(spark, storage.root) - folder_size(spark, version_path(storage.root, data, version))
    return _record(spark, storage, data, version, {"all": held}, None, datetime.now(UTC))


def _finish(spark, storage: Storage, data: str, version: int, sizes: dict[str, int], tags) -> DataFrame:
    if storage.capacity is not None:
        assert_capacity(_stored(spark, storage, data, version), storage.capacity, sum(sizes.values()))
    rows = _record(spark, storage, data, version, sizes, tags, datetime.now(UTC))
    if storage.record:
        _write_manifest(rows, storage.root)
    return rows


def write_catalog(catalog: Catalog, storage: Storage, data: str, version: int) -> None:
    """Store the catalog beside the tables of a version, from where a restore reads it."""
    guard_writable(storage)
    base = catalog_path(storage.root, data, version)
    spark = catalog.tables.sparkSession
    facts = local_frame(spark, [(catalog.source_type, list(catalog.schemas or ()))], CATALOG_FACTS)
    facts.write.mode("errorifexists").json(f"{base}/facts")
    with ThreadPoolExecutor(PARALLELISM) as pool:
        list(pool.map(lambda item: item[1].write.mode("errorifexists").parquet(f"{base}/{item[0]}"), catalog.frames().items()))


def write_fanout(
    dfs: dict[str, DataFrame],
    storages: list[Storage],
    data: str,
    version: int,
    pks: dict[str, list[str]] | None = None,
    tags: dict[str, str] | None = None,
    compression: str = "zstd",
) -> DataFrame:
    """Store the same tables in every storage; returns the manifest rows of the recording ones.

    The tables are computed and sorted once: the other storages get copies of the first one's
    files, in the same order and with the same positions. The size is known by then, so a storage
    without room for it is an error before anything is copied there.
    """
    for s in storages:
        guard_writable(s)
    first, *others = storages
    recorded = [write_snapshot(dfs, first, data, version, pks, tags, compression)] if first.record else []
    if not first.record:
        write_snapshot(dfs, first, data, version, pks, tags, compression)
    spark = next(iter(dfs.values())).sparkSession
    for s in others:

        def copy(table: str, to: Storage = s) -> int:
            path = table_path(to.root, data, version, table)
            for source, target in (
                (offsets_path(first.root, data, version, table), offsets_path(to.root, data, version, table)),
                (table_path(first.root, data, version, table), path),
            ):
                spark.read.parquet(source).write.mode("errorifexists").option("compression", compression).parquet(target)
            return folder_size(spark, path)

        with _whole_version(spark, s, data, version):
            room = _Room(spark, s, data, version)
            if s.capacity is not None:
                room.need(sum(folder_size(spark, table_path(first.root, data, version, table)) for table in dfs))
            rows = _finish(spark, s, data, version, _each_table(list(dfs), copy, room), tags)
        if s.record:
            recorded.append(rows)
    out = local_frame(spark, [], MANIFEST)
    for rows in recorded:
        out = out.unionByName(rows)
    return out


def write_compressed(df: DataFrame, path: str, codec: str = "gzip", fmt: str = "parquet") -> None:
    """Write a table compressed; ``codec`` as the format takes it (gzip, zstd, ...)."""
    df.write.mode("errorifexists").option("compression", codec).format(fmt).save(path)


def delete_version(spark: SparkSession, storage: Storage, data: str, version: int) -> bool:
    """Remove the files and manifest entries of a version; a missing version is fine."""
    guard_writable(storage)
    found = _remove(spark, storage, data, version)
    return delete_path(spark, claim_path(storage.root, data, version)) or found


def _remove(spark: SparkSession, storage: Storage, data: str, version: int) -> bool:
    # The manifest goes first: what it does not list is not a version.
    delete_path(spark, f"{manifest_path(storage.root)}/data={data}/version={version}")
    return delete_path(spark, version_path(storage.root, data, version))


def apply_retention(
    spark: SparkSession, storage: Storage, count_limit: int | None = None, size_limit: int | None = None
) -> list[tuple[str, int]]:
    """Delete the versions that ``retention_select`` names; returns them as (data, version)."""
    guard_writable(storage)
    chosen = retention_select(read_manifest(spark, storage.root), count_limit, size_limit)
    rows = chosen.select("data", "version").orderBy("data", "version").collect()  # one row per deleted folder
    removed = [(r["data"], r["version"]) for r in rows]
    for data, version in removed:
        delete_version(spark, storage, data, version)
    return removed


def clear_version(spark: SparkSession, storage: Storage, data: str, version: int, tables: list[str] | None = None) -> DataFrame:
    """A new version (number + 1) in which the listed tables, or all, have no rows.

    Tags and the stored catalog, if there is one, go along.
    """
    guard_writable(storage)
    of_version = (F.col("data") == data) & (F.col("version") == version)
    recorded = read_manifest(spark, storage.root).filter(of_version).select("name", "tags").collect()  # one row per table
    names = {r["name"] for r in recorded}
    tags = {key: value for r in recorded for key, value in (r["tags"] or {}).items()}
    wanted = names if tables is None else set(tables)
    if not names or wanted - names:
        raise ValueError(f"unknown tables {sorted(wanted - names)} in version {version} of {data}")

    def carry(table: str) -> int:
        rows = spark.read.parquet(table_path(storage.root, data, version, table))
        kept = rows.limit(0) if table in wanted else rows
        path = table_path(storage.root, data, version + 1, table)
        kept.write.mode("errorifexists").parquet(path)
        partition_offsets(kept).write.mode("errorifexists").parquet(offsets_path(storage.root, data, version + 1, table))
        return folder_size(spark, path)

    with _whole_version(spark, storage, data, version + 1):
        room = _Room(spark, storage, data, version + 1)
        rows = _finish(spark, storage, data, version + 1, _each_table(sorted(names), carry, room), tags)
        if path_exists(spark, catalog_path(storage.root, data, version)):
            write_catalog(read_stored_catalog(spark, storage.root, data, version), storage, data, version + 1)
    return rows


__all__ = [
    "Storage",
    "apply_retention",
    "clear_version",
    "delete_version",
    "folder_size",
    "guard_writable",
    "write_catalog",
    "write_compressed",
    "write_fanout",
    "write_snapshot",
]
