"""Row keys and the text form of cells used by the JSON interchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the interchange format.
KEY_SEPARATOR = "|-|"
DATE_FORMAT = "yyyy-MM-dd"
DATETIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def row_key(pk: list[str]) -> Column:
    """Text key of a row: the key value, or the values of a composite key joined in name order.

    A null part of the key gives a null row key instead of a shorter one. Tables without a key
    use the running number of ``operators.paging.row_sequence``.
    """
    if not pk:
        raise ValueError("a table without primary key has no row key; use row_sequence")
    parts = [F.col(c).cast("string") for c in sorted(pk)]
    if len(parts) == 1:
        return parts[0]
    separated = [p for part in parts for p in (F.lit(KEY_SEPARATOR), part)][1:]
    return F.concat(*separated)


def encode_cell(col: Column, dtype: T.DataType, datetime_format: str = DATETIME_FORMAT) -> Column:
    """Text form of one cell; null stays null."""
    if isinstance(dtype, T.BinaryType):
        return F.base64(col)
    if isinstance(dtype, T.DateType):
        return F.date_format(col, DATE_FORMAT)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, datetime_format)
    if isinstance(dtype, T.DayTimeIntervalType):
        micros = F.extract(F.lit("DAY"), col) * 86_400_000_000 + F.extract(F.lit("HOUR"), col) * 3_600_000_000
        micros += F.extract(F.lit("MINUTE"), col) * 60_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000)
        return F.floor(micros / 1000).cast("bigint").cast("string")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def decode_cell(cell: Column, dtype: T.DataType, datetime_format: str = DATETIME_FORMAT) -> Column:
    """Inverse of ``encode_cell`` for the declared type."""
    if isinstance(dtype, T.BinaryType):
        return F.unbase64(cell)
    if isinstance(dtype, T.DateType):
        return F.to_date(cell, DATE_FORMAT)
    if isinstance(dtype, T.TimestampNTZType):
        return F.to_timestamp_ntz(cell, F.lit(datetime_format))
    if isinstance(dtype, T.TimestampType):
        return F.to_timestamp(cell, datetime_format)
    if isinstance(dtype, T.DayTimeIntervalType):
        return F.make_dt_interval(secs=(cell.cast("decimal(20,0)") / 1000).cast("decimal(18,6)"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(cell, dtype)
    return cell.cast(dtype)


def encode_cells(schema: T.StructType, datetime_format: str = DATETIME_FORMAT) -> Column:
    """``array<string>`` of all cells of a row, in alphabetical column order."""
    fields = sorted(schema.fields, key=lambda f: f.name)
    return F.array(*[encode_cell(F.col(f"`{f.name}`"), f.dataType, datetime_format) for f in fields])


def decode_cells(
    df: DataFrame, cells: str, schema: T.StructType, datetime_format: str = DATETIME_FORMAT
) -> DataFrame:
    """Rows of ``schema`` from an ``array<string>`` column in alphabetical column order."""
    position = {name: i for i, name in enumerate(sorted(schema.fieldNames()))}
    return df.select(
        *[
            decode_cell(F.col(cells)[position[f.name]], f.dataType, datetime_format).alias(f.name)
            for f in schema.fields
        ]
    )
