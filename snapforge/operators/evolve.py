"""Apply column changes to the data of a table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.functions.types import spark_type
from snapforge.session import local_frame


@dataclass(frozen=True)
class ColumnOp:
    """One change: CREATE, DROP or MODIFY of a column to the given wanted state."""

    op: str
    name: str
    data_type: str | None = None
    num_precision: int | None = None
    num_scale: int | None = None
    max_length: int | None = None
    default: str | None = None
    nullable: bool = True
    changed: tuple[str, ...] = ("data_type",)


@dataclass(frozen=True)
class OpResult:
    op: str
    name: str
    ok: bool
    message: str = ""


class EvolveError(ValueError):
    """A change could not be applied; ``results`` lists all outcomes so far."""

    def __init__(self, results: list[OpResult]):
        self.results = results
        failed = [r for r in results if not r.ok]
        super().__init__("; ".join(f"{r.op} {r.name}: {r.message}" for r in failed))


def column_ops(diff: DataFrame, schema: str | None, table: str) -> list[ColumnOp]:
    """The changes of one table from ``diff_columns``; as many rows as the table has columns."""
    return ops_of(diff.filter((F.col("schema") == (schema or "")) & (F.col("table") == table)).collect())


def ops_of(rows: list) -> list[ColumnOp]:
    """The changes of one table from its rows of ``diff_columns``: new columns, then dropped, then changed ones."""
    ops = []
    for r in sorted(rows, key=lambda r: (("CREATE", "DROP", "MODIFY").index(r["op"]), r["name"])):
        new = r["new"]
        if r["op"] == "DROP":
            ops.append(ColumnOp("DROP", r["name"]))
        else:
            ops.append(
                ColumnOp(
                    r["op"], r["name"], new["data_type"], new["num_precision"], new["num_scale"], new["max_length"],
                    new["column_default"], bool(new["nullable"]), tuple(r["changed_fields"]),
                )
            )
    return ops


# Names of the vendors for the clock and for a new identifier.
_FUNCTIONS = {
    "current_date": "current_date()",
    "current_timestamp": "current_timestamp()",
    "localtimestamp": "current_timestamp()",
    "now": "current_timestamp()",
    "getdate": "current_timestamp()",
    "sysdatetime": "current_timestamp()",
    "gen_random_uuid": "uuid()",
    "newid": "uuid()",
    "uuid": "uuid()",
}
_LITERAL = re.compile(r"(?is)[ne]?'((?:[^']|'')*)'(?:::.+)?")
_CALL = re.compile(r"(?is)(\w+)\s*(\(.*\))")


def _unwrapped(text: str) -> str:
    """``text`` without the brackets around the whole of it; brackets in literals do not count."""
    while text.startswith("(") and text.endswith(")"):
        bare, depth = re.sub(r"'(?:[^']|'')*'", lambda m: "x" * len(m.group()), text), 0
        for at, char in enumerate(bare):
            depth += (char == "(") - (char == ")")
            if depth == 0:
                break
        if at < len(text) - 1:
            break
        text = text[1:-1].strip()
    return text


def default_value(default: str | None, dtype: str) -> Column:
    """A default as a typed constant; brackets, quotes and a trailing ``::type`` are taken off.

    The clock and identifier functions of the vendors become Spark's. ``ValueError`` for any other
    call, such as the next value of a sequence. A literal that does not fit the type gives null.
    """
    if default is None:
        return F.lit(None).cast(dtype)
    text = _unwrapped(default.strip())
    literal = _LITERAL.fullmatch(text)
    if literal:
        return F.lit(literal.group(1).replace("''", "'")).try_cast(dtype)
    plain = _unwrapped(text.split("::")[0].strip())
    if plain.upper() == "NULL":
        return F.lit(None).cast(dtype)
    call = _CALL.fullmatch(text)
    known = _FUNCTIONS.get((call.group(1) if call else plain).lower())
    if known and (not call or re.fullmatch(r"\(\s*\d*\s*\)", call.group(2))):
        return F.expr(known).cast(dtype)
    if call:
        raise ValueError(f"default {default!r} cannot be translated")
    return F.lit(plain).try_cast(dtype)


def _is_null(default: str | None) -> bool:
    return default is None or _unwrapped(_unwrapped(default.strip()).split("::")[0].strip()).upper() == "NULL"


def _default_problem(df: DataFrame, default: str | None, dtype: str) -> str:
    """Why a default cannot be used for a column of this type, or an empty text."""
    if _is_null(default):
        return ""
    try:
        # One row of constants: the planner folds it, no data is read.
        one = local_frame(df.sparkSession, [(1,)], "one int").select(default_value(default, dtype).isNull())
        return f"default {default!r} does not fit {dtype}" if one.head()[0] else ""
    except (ValueError, AnalysisException) as error:
        return str(error).splitlines()[0]


_TYPE_FIELDS = {"data_type", "column_type", "max_length", "num_precision", "num_scale"}


def evolve_table(
    df: DataFrame,
    ops: list[ColumnOp],
    ordinals: list[str] | None = None,
    continue_on_error: bool = True,
) -> tuple[DataFrame, list[OpResult]]:
    """Apply column changes to a table; returns the new table and one outcome per change.

    A change fails as a whole and then leaves its column as it was: a value that does not fit the
    wanted type or length, a null where NOT NULL is wanted, a new NOT NULL column without default
    on a table with rows. All these conditions are counted in one pass over the columns concerned,
    and only when there is a change that can fail. With ``continue_on_error`` the rest is applied,
    else ``EvolveError`` is raised. ``ordinals`` gives the wanted column order.
    """
    planned: list[tuple[ColumnOp, Column | None, Column | None, str]] = []
    for op in ops:
        planned.append(_plan(df, op))
    tests = {f"_t{i}": F.count_if(test) for i, (_, _, test, _) in enumerate(planned) if test is not None}
    broken = df.agg(*[c.alias(n) for n, c in tests.items()]).head().asDict() if tests else {}

    results, updates, drops = [], {}, []
    for i, (op, value, _, message) in enumerate(planned):
        bad = broken.get(f"_t{i}") or 0
        if message and value is None and op.op != "DROP":
            results.append(OpResult(op.op, op.name, False, message))
        elif op.op == "DROP" and message:
            results.append(OpResult(op.op, op.name, False, message))
        elif bad:
            results.append(OpResult(op.op, op.name, False, f"{bad} rows do not fit"))
        else:
            results.append(OpResult(op.op, op.name, True))
            if op.op == "DROP":
                drops.append(op.name)
            else:
                updates[op.name] = value
        if not continue_on_error and not results[-1].ok:
            raise EvolveError(results)
    out = df.withColumns(updates) if updates else df
    out = out.drop(*drops) if drops else out
    if ordinals:
        first = [c for c in ordinals if c in out.columns]
        out = out.select(*[f"`{c}`" for c in first + [c for c in out.columns if c not in first]])
    return out, results


def _plan(df: DataFrame, op: ColumnOp) -> tuple[ColumnOp, Column | None, Column | None, str]:
    """(op, new value, condition of a row that makes it fail, reason it cannot work at all)."""
    exists = op.name in df.columns
    if op.op == "DROP":
        return op, None, None, "" if exists else "no such column"
    if op.op not in ("CREATE", "MODIFY"):
        return op, None, None, f"unknown operation {op.op}"
    if exists != (op.op == "MODIFY"):
        return op, None, None, "column exists" if exists else "no such column"
    try:
        dtype = spark_type(op.data_type, op.num_precision, op.num_scale)
    except (ValueError, AttributeError):
        return op, None, None, f"unknown data type {op.data_type!r}"
    if op.op == "CREATE":
        problem = _default_problem(df, op.default, dtype)
        if problem:
            return op, None, None, problem
        value = default_value(op.default, dtype)
        test = F.lit(True) if not op.nullable and _is_null(op.default) else None
        return op, value, test, ""
    col = F.col(f"`{op.name}`")
    test = F.lit(False)
    value = col
    if _TYPE_FIELDS & set(op.changed):
        value = col.try_cast(dtype)
        test = test | (col.isNotNull() & value.isNull())
        if op.max_length is not None and dtype in ("string", "binary"):
            test = test | (F.length(value) > op.max_length)
    if not op.nullable and "nullable" in op.changed:
        test = test | col.isNull()
    # A changed default or key only concerns rows written later.
    return op, value, test if {"nullable", *_TYPE_FIELDS} & set(op.changed) else None, ""


def summary(results: list[OpResult]) -> dict[str, int]:
    """Counts of applied and failed changes."""
    ok = sum(r.ok for r in results)
    return {"success": ok, "failed": len(results) - ok, "total": len(results)}
