"""Stored versions: folder layout and reads.

Layout: ``<root>/data=<data>/version=<n>/table=<name>/`` with Parquet files in key order, beside it
``offsets=<name>/`` with one row per range partition, and
``<root>/manifest/data=<data>/version=<n>/`` with one row per table and storage. The catalog of a
version is in its ``catalog/`` folder, one small table per frame. While a version is written there is a file
``<root>/_claims/data=<data>/version=<n>``; such a version is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.catalog import SCHEMAS, Catalog
from snapforge.operators.manifest import MANIFEST, merge_manifest
from snapforge.operators.paging import POSITION, number_positioned, page_of
from snapforge.session import local_frame, path_exists


CATALOG_FACTS = "source_type string, schemas array<string>"


def version_path(root: str, data: str, version: int) -> str:
    return f"{root}/data={data}/version={version}"


def table_path(root: str, data: str, version: int, table: str) -> str:
    return f"{version_path(root, data, version)}/table={table}"


def offsets_path(root: str, data: str, version: int, table: str) -> str:
    return f"{version_path(root, data, version)}/offsets={table}"


def manifest_path(root: str) -> str:
    return f"{root}/manifest"


def claim_path(root: str, data: str, version: int) -> str:
    return f"{root}/_claims/data={data}/version={version}"


def assert_committed(spark: SparkSession, root: str, data: str, version: int) -> None:
    """An error for a version that is being written, or whose writer has died before the end."""
    if path_exists(spark, claim_path(root, data, version)):
        raise ValueError(f"version {version} of {data} is not complete")


def read_snapshot(spark: SparkSession, root: str, data: str, version: int, table: str) -> DataFrame:
    """Rows of one table of a complete version."""
    assert_committed(spark, root, data, version)
    return spark.read.parquet(table_path(root, data, version, table)).drop(POSITION)


def read_numbered(spark: SparkSession, root: str, data: str, version: int, table: str) -> DataFrame:
    """Rows of one table with their ``row_num`` in the stored order; nothing is sorted again."""
    assert_committed(spark, root, data, version)
    offsets = spark.read.parquet(offsets_path(root, data, version, table))
    return number_positioned(spark.read.parquet(table_path(root, data, version, table)), offsets=offsets)


def read_snapshot_page(
    spark: SparkSession, root: str, data: str, version: int, table: str, page: int, size: int
) -> DataFrame:
    """One page of a stored table; files and row groups outside the page are skipped."""
    assert_committed(spark, root, data, version)
    offsets = spark.read.parquet(offsets_path(root, data, version, table))
    return page_of(spark.read.parquet(table_path(root, data, version, table)), page, size, offsets)


def catalog_path(root: str, data: str, version: int) -> str:
    return f"{version_path(root, data, version)}/catalog"


def read_stored_catalog(spark: SparkSession, root: str, data: str, version: int) -> Catalog:
    """The catalog stored with a version; a version without one is an error."""
    base = catalog_path(root, data, version)
    if not path_exists(spark, base):
        raise ValueError(f"version {version} of {data} has no catalog")
    facts = spark.read.schema(CATALOG_FACTS).json(f"{base}/facts").head()
    frames = {name: spark.read.schema(ddl).parquet(f"{base}/{name}") for name, ddl in SCHEMAS.items()}
    return Catalog.of(spark, **frames, source_type=facts["source_type"], schemas=facts["schemas"] or ())


def read_version(spark: SparkSession, root: str, data: str, version: int) -> dict[str, DataFrame]:
    """All tables of a version by name, as recorded in the manifest."""
    names = (
        read_manifest(spark, root)
        .filter((F.col("data") == data) & (F.col("version") == version))
        .select("name").distinct().orderBy("name").collect()  # one row per table
    )
    if not names:
        raise ValueError(f"no version {version} of {data}")
    return {r["name"]: read_snapshot(spark, root, data, version, r["name"]) for r in names}


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a root, one row per file with all storages that hold it."""
    if not path_exists(spark, manifest_path(root)):
        return local_frame(spark, [], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(manifest_path(root))
    columns = [c.split(" ")[0] for c in MANIFEST.replace("map<string,string>", "map").split(", ")]
    empty = local_frame(spark, [], MANIFEST)
    return merge_manifest(rows.select(*columns), empty)
