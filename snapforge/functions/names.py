"""Qualified names and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the interchange format.
DATA_FILE_PREFIX = "data-"
DATA_FILE_SUFFIX = ".json"
CATALOG_FILE = "db-model.json"


def qualified_name(schema: Column, name: Column) -> Column:
    """``schema.name``, or ``name`` where the schema is null or empty."""
    return F.concat_ws(".", F.nullif(schema, F.lit("")), name)


def qualify(schema: str | None, name: str) -> str:
    """The same rule for plain strings."""
    return f"{schema}.{name}" if schema else name


def data_file_name(qualified: Column) -> Column:
    """Name of the data file of a table."""
    return F.concat(F.lit(DATA_FILE_PREFIX), qualified, F.lit(DATA_FILE_SUFFIX))
