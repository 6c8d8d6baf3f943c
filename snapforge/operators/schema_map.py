"""Renaming of a schema in a catalog and its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.catalog import Catalog

_SCHEMA_COLUMNS = {"foreign_keys": ("src_schema", "ref_schema")}


def map_schema_column(col: Column, src: str, dst: str) -> Column:
    """``dst`` where ``col`` equals ``src`` without regard to case."""
    return F.when(F.lower(col) == src.lower(), F.lit(dst)).otherwise(col)


def map_schema_frame(df: DataFrame, columns: tuple[str, ...], src: str, dst: str) -> DataFrame:
    return df.withColumns({c: map_schema_column(F.col(c), src, dst) for c in columns})


def map_schema(
    catalog: Catalog, dfs: dict[str, DataFrame], src: str, dst: str
) -> tuple[Catalog, dict[str, DataFrame]]:
    """Rename schema ``src`` to ``dst`` in all catalog frames and in the table names of ``dfs``.

    Nothing happens when the catalog has no schemas or lacks ``src``.
    """
    schemas = list(catalog.schemas or ())
    hit = next((s for s in schemas if s.lower() == src.lower()), None)
    if hit is None:
        return catalog, dfs
    schemas.remove(hit)
    if not any(s.lower() == dst.lower() for s in schemas):
        schemas.append(dst)
    frames = {
        name: map_schema_frame(df, _SCHEMA_COLUMNS.get(name, ("schema",)), src, dst)
        for name, df in catalog.frames().items()
    }
    renamed: dict[str, DataFrame] = {}
    for table, df in dfs.items():
        schema, dot, name = table.rpartition(".")
        key = f"{dst}.{name}" if dot and schema.lower() == src.lower() else table
        if key in renamed:
            raise ValueError(f"two tables would be named {key}")
        renamed[key] = df
    return catalog.with_frames(**frames, schemas=tuple(schemas)), renamed
