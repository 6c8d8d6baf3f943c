"""Column maxima and the sequence values that follow from them."""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.functions.names import qualified_name, qualify
from snapforge.session import local_frame

# Placeholders of a sequence name template.
TABLE_PLACEHOLDER = "{tableName}"
COLUMN_PLACEHOLDER = "{columnName}"

# Fixed value: sources that have no sequences.
WITHOUT_SEQUENCES = ("MYSQL",)

# Tables that are read at the same time.
PARALLELISM = 10

RESULT = "sequence string, table string, column string, max_value bigint, new_value bigint"


@dataclass(frozen=True)
class SequenceMapping:
    """An explicit sequence for a column, all in one schema."""

    schema: str | None
    sequence: str
    table: str
    column: str


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _as_long(df: DataFrame, column: str) -> Column:
    """Maximum as a whole number, fractions cut off; null for other types, for empty tables, and where it does not fit a bigint.

    The last is so for a maximum of 2^63 or more, for infinity, and for NaN, which counts as the largest number.
    """
    if not isinstance(df.schema[column].dataType, T.NumericType):
        return F.max(F.lit(None).cast("bigint"))
    return F.max(quoted(column)).try_cast("bigint")


def _read_or_warn(maxima: DataFrame) -> DataFrame | None:
    """The rows of one table, one per sequence asked for, read now."""
    try:
        return local_frame(maxima.sparkSession, maxima.collect(), "sequence string, table string, column string, max_value bigint")
    except Exception as e:  # noqa: BLE001 - a table that fails must not stop the others
        warnings.warn(f"sequence skipped: {str(e)[:500]}", stacklevel=2)
        return None


def max_value(df: DataFrame, column: str) -> DataFrame:
    """One row with the maximum of ``column``, see ``next_sequence_values`` for values that are no bigint."""
    return df.agg(_as_long(df, column).alias("max_value"))


def next_sequence_values(
    dfs: dict[str, DataFrame],
    sequences: DataFrame,
    template: str | None = None,
    column: str | None = None,
    mappings: list[SequenceMapping] | None = None,
    source_type: str | None = None,
    continue_on_error: bool = False,
) -> DataFrame:
    """New value max + 1 (1 for an empty table) per sequence that exists.

    The template is tried for every table that has ``column``, mappings name their column.
    Missing tables, columns and sequences are skipped. Every table is scanned once, for the
    columns asked for only. A maximum that does not fit a bigint (2^63 or more, infinity, NaN) counts as none. A source
    without sequences gives no rows. The result is lazy, and one table that cannot be read fails it. With
    ``continue_on_error`` the maxima are read when this is called, several tables at a time; a table that fails gives a
    warning and no rows.
    """
    if source_type in WITHOUT_SEQUENCES:
        return local_frame(sequences.sparkSession, [], RESULT)
    wanted: dict[str, list[tuple[str, str]]] = {}
    if template is not None and column is not None:
        for table in dfs:
            schema, _, name = table.rpartition(".")
            sequence = template.replace(TABLE_PLACEHOLDER, name).replace(COLUMN_PLACEHOLDER, column)
            wanted.setdefault(table, []).append((qualify(schema, sequence), column))
    for m in mappings or []:
        wanted.setdefault(qualify(m.schema, m.table), []).append((qualify(m.schema, m.sequence), m.column))

    parts = []
    for table, asked in wanted.items():
        df = dfs.get(table)
        found = [(s, c) for s, c in asked if df is not None and c in df.columns]
        if not found:
            continue
        maxima = df.agg(*[_as_long(df, c).alias(f"_m{i}") for i, (_, c) in enumerate(found)])
        pairs = [
            F.struct(F.lit(s).alias("sequence"), F.lit(table).alias("table"), F.lit(c).alias("column"), F.col(f"_m{i}").alias("max_value"))
            for i, (s, c) in enumerate(found)
        ]
        parts.append(maxima.select(F.inline(F.array(*pairs))))
    if continue_on_error:
        with ThreadPoolExecutor(PARALLELISM) as pool:
            parts = [p for p in pool.map(_read_or_warn, parts) if p is not None]
    if not parts:
        return local_frame(sequences.sparkSession, [], RESULT)
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    known = sequences.select(qualified_name(F.col("schema"), F.col("name")).alias("sequence"))
    return values.join(known, "sequence", "left_semi").withColumn(
        "new_value", F.coalesce("max_value", F.lit(0)) + F.lit(1)
    )


def advance_sequences(sequences: DataFrame, new_values: DataFrame) -> DataFrame:
    """The ``sequences`` frame with ``last_value`` set to the new values."""
    updates = new_values.groupBy("sequence").agg(F.max("new_value").alias("_new"))
    return (
        sequences.withColumn("sequence", qualified_name(F.col("schema"), F.col("name")))
        .join(updates, "sequence", "left")
        .withColumn("last_value", F.coalesce("_new", "last_value"))
        .select(*sequences.columns)
    )
