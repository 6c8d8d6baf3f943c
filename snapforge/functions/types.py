"""Vendor type names to Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# Vendor type names by the Spark type that holds their cells.
_VENDOR_TYPES: dict[str, list[str]] = {
    "string": [
        "bpchar", "char", "character", "character varying", "citext", "clob", "enum", "inet",
        "json", "jsonb", "longtext", "mediumtext", "name", "nchar", "ntext", "nvarchar", "set",
        "string", "sysname", "text", "tinytext", "tsvector", "uniqueidentifier", "uuid", "varchar",
        "varchar2", "xml",
    ],
    "binary": [
        "binary", "blob", "bytea", "image", "longblob", "mediumblob", "oid", "rowversion",
        "tinyblob", "varbinary",
    ],
    "boolean": ["bit", "bool", "boolean"],
    "tinyint": ["byte"],
    "smallint": ["int2", "smallint", "smallserial", "tinyint"],
    "int": ["int", "int4", "integer", "mediumint", "serial", "year"],
    "bigint": ["bigint", "bigserial", "int8", "long"],
    "float": ["float4", "real"],
    "double": ["double", "double precision", "float", "float8"],
    "date": ["date"],
    "timestamp_ntz": [
        "datetime", "datetime2", "smalldatetime", "timestamp", "timestamp without time zone",
        "timestamp_ntz",
    ],
    "timestamp": ["datetimeoffset", "timestamp with time zone", "timestamptz"],
    "interval day to second": ["interval", "interval day to second"],
}
_DECIMALS = ("decimal", "dec", "money", "number", "numeric", "smallmoney")
_BY_NAME = {name: spark for spark, names in _VENDOR_TYPES.items() for name in names}


def spark_type(data_type: str, precision: int | None = None, scale: int | None = None) -> str:
    """DDL name of the Spark type for a vendor type name.

    A length such as ``varchar(50)`` is ignored here, it is checked by ``length_violations``;
    a leading underscore or trailing ``[]`` marks an array, whose elements are kept as text.
    """
    name = data_type.strip().lower()
    if name.startswith("_") or name.endswith("[]") or name.startswith("array"):
        return "array<string>"
    base, _, args = name.partition("(")
    base = base.replace(" unsigned", "").strip()
    if base in _DECIMALS:
        if args:
            digits = [int(a) for a in args.rstrip(")").split(",")]
            precision, scale = digits[0], digits[1] if len(digits) > 1 else 0
        elif precision is None and base.endswith("money"):
            precision, scale = 19, 4
        return f"decimal({precision if precision is not None else 38},{scale if scale is not None else (18 if precision is None else 0)})"
    if base not in _BY_NAME:
        raise ValueError(f"unknown data type {data_type!r}")
    return _BY_NAME[base]


def type_facts(dtype: T.DataType) -> tuple[str, int | None, int | None]:
    """(type name, precision, scale) of a Spark type for the catalog frame."""
    if isinstance(dtype, T.DecimalType):
        return "decimal", dtype.precision, dtype.scale
    return dtype.simpleString(), None, None
