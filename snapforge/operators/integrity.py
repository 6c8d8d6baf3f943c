"""Rows and keys that break a declared rule.

All key checks aggregate before they shuffle: a key value held by a large part of a table becomes
one row per map task. Row-level results are found in a second pass that only looks up the few
broken keys.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.catalog import Catalog
from snapforge.functions.names import qualify
from snapforge.functions.types import spark_type
from snapforge.session import keep, local_frame


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _all_present(names: list[str]) -> Column:
    out = F.lit(True)
    for c in _cols(names):
        out = out & c.isNotNull()
    return out


def pk_violations(df: DataFrame, pk: list[str]) -> DataFrame:
    """Key values that repeat or hold a null: key columns, ``row_count``, ``reason``."""
    counted = df.groupBy(*_cols(pk)).agg(F.count(F.lit(1)).alias("row_count"))
    reason = F.when(~_all_present(pk), F.lit("null")).when(F.col("row_count") > 1, F.lit("duplicate"))
    return counted.withColumn("reason", reason).filter("reason is not null")


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that repeat: columns and ``row_count``. A row with a null never counts."""
    counted = df.filter(_all_present(columns)).groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.filter("row_count > 1")


def unique_violations_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """``unique_violations`` for long texts.

    The first pass groups by an 8-byte hash, so no text is shuffled; only texts whose hash repeats
    take part in the exact grouping, which also sorts out texts that merely share a hash.
    """
    keyed = df.filter(_all_present(columns)).select(*_cols(columns), F.xxhash64(*_cols(columns)).alias("_hash"))
    repeated = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")
    candidates = keyed.join(keep(repeated, "hashes"), "_hash", "left_semi")
    return unique_violations(candidates, columns)


def _key_rules(df: DataFrame, table: str, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """rule, table, constraint, violations of all primary and unique keys (rule, constraint, columns) of one table.

    The table is scanned once: grouping sets count the values of all keys in one aggregate, before and after its shuffle.
    """
    columns = sorted({c for _, _, names in rules for c in names})
    short = {c: f"_k{i}" for i, c in enumerate(columns)}  # names without dots
    sets = sorted({tuple(sorted(names)) for _, _, names in rules})
    narrow = df.select(*[F.col(f"`{c}`").alias(short[c]) for c in columns])
    counted = narrow.groupingSets([[F.col(short[c]) for c in s] for s in sets], *short.values()).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_set")
    )
    sums, rows = [], []
    for i, (rule, constraint, names) in enumerate(rules):
        # The id has a bit for every column that is not part of the set, the first column's is the highest.
        of_key = F.col("_set") == sum(1 << (len(columns) - 1 - n) for n, c in enumerate(columns) if c not in names)
        present = _all_present([short[c] for c in names])
        broken = ~present | (F.col("_n") > 1) if rule == "primary key" else present & (F.col("_n") > 1)
        sums.append(F.count(F.when(of_key & broken, 1)).alias(f"_v{i}"))
        rows.append(F.struct(F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.lit(constraint).alias("constraint"), F.col(f"_v{i}").alias("violations")))
    return counted.agg(*sums).select(F.inline(F.array(*rows)))


def orphan_keys(
    child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str] | None = None
) -> DataFrame:
    """Foreign-key values without a parent, with ``row_count``; a null in any column passes."""
    refs = ref_columns or columns
    asked = child.filter(_all_present(columns)).groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("row_count"))
    known = parent.select(*[c.alias(f"_ref{i}") for i, c in enumerate(_cols(refs))])
    on = None
    for i, c in enumerate(_cols(columns)):
        eq = c == F.col(f"_ref{i}")
        on = eq if on is None else on & eq
    return asked.join(known, on, "left_anti")


def fk_violations(
    child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str] | None = None
) -> DataFrame:
    """Child rows without parent.

    The keys without parent are written first. When they are few, which the planner sees from the
    size of the written table, the child is only scanned; otherwise it is joined by key, and
    adaptive execution splits a hot key of the child.
    """
    keys = keep(orphan_keys(child, parent, columns, ref_columns).select(*_cols(columns)), "orphans")
    return child.join(keys, columns, "left_semi").select(*[F.col(f"`{c}`") for c in child.columns])


def check_violations(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a check predicate (Spark SQL) is false; null passes."""
    return df.filter(~F.expr(predicate))


_CHECK_FORMS = [
    (re.compile(pattern, re.IGNORECASE), new)
    for pattern, new in (
        (r"::(character varying|double precision|timestamp with(out)? time zone|\w+)(\(\d+(,\s*\d+)?\))?(\[\])*", ""),
        (r'"([^"]+)"', r"`\1`"),
        (r"(?:<>|!=)\s*ALL\s*\(\s*(\()?\s*ARRAY\s*\[([^\]]*)\]\s*(?(1)\))\s*\)", r"NOT IN (\2)"),
        (r"=\s*ANY\s*\(\s*(\()?\s*ARRAY\s*\[([^\]]*)\]\s*(?(1)\))\s*\)", r"IN (\2)"),
        (r"\bARRAY\s*\[([^\]]*)\]", r"array(\1)"),
        (r"(?<![\w)\]`])\[([^\[\]]+)\]", r"`\1`"),
    )
]


def check_predicate(condef: str) -> str:
    """Spark SQL predicate from the text of a check constraint.

    Takes off the ``CHECK ( ... )`` wrapping and rewrites the vendor forms that differ:
    ``regexp_like(a, b)`` is kept (Spark has it), character set prefixes and ``::type`` casts go,
    ``= ANY (ARRAY[..])`` becomes ``IN``, ``<> ALL (ARRAY[..])`` becomes ``NOT IN``, and names in
    brackets or double quotes get backticks. Text inside literals stays as it is.
    """
    text = condef.strip()
    wrapped = re.fullmatch(r"(?is)check\s*\((.*)\)(\s+not\s+valid)?", text)
    if wrapped:
        text = wrapped.group(1).strip()
    escaped = re.search(r"_utf8mb[34]\\?'", text)  # this vendor's literals have backslash escapes, as Spark's
    if escaped:
        text = re.sub(r"_utf8mb[34]\\?'", "'", text).replace("\\'", "'")
    literals: list[str] = []

    def put_aside(found: re.Match) -> str:
        inner = found.group(1) if escaped else found.group(1).replace("\\", "\\\\")
        literals.append("'" + inner.replace("''", "\\'") + "'")
        return f"\0{len(literals) - 1}\0"

    text = re.sub(r"'((?:[^']|'')*)'", put_aside, text)
    for pattern, new in _CHECK_FORMS:
        text = pattern.sub(new, text)
    return re.sub(r"\0(\d+)\0", lambda found: literals[int(found.group(1))], text)


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per NOT NULL column that has nulls: ``column``, ``null_count``. One pass."""
    counts = df.agg(*[F.count_if(c.isNull()).alias(f"_n{i}") for i, c in enumerate(_cols(columns))])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"_n{i}").alias("null_count")) for i, n in enumerate(columns)]
    )
    return counts.select(F.inline(pairs)).filter("null_count > 0")


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in a NOT NULL column."""
    return df.filter(~_all_present(columns))


def _too_long(df: DataFrame, name: str, max_length: int | None, data_type: str | None, precision, scale) -> Column | None:
    col = F.col(f"`{name}`")
    kind = df.schema[name].dataType.simpleString()
    if kind == "string" and max_length is not None:
        return F.length(col) > max_length
    if kind == "binary" and max_length is not None:
        return F.octet_length(col) > max_length
    if data_type and precision is not None and spark_type(data_type, precision, scale).startswith("decimal"):
        wanted = spark_type(data_type, precision, scale)
        return col.isNotNull() & col.try_cast(wanted).isNull()
    return None


def length_violations(df: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows with a text longer than declared or a number wider than its declared precision.

    ``columns`` are the catalog rows of this table. Adds ``violations array<string>``.
    """
    facts = columns.select("name", "data_type", "max_length", "num_precision", "num_scale").collect()  # one table's columns
    tests = []
    for f in facts:
        if f["name"] not in df.columns:
            continue
        broken = _too_long(df, f["name"], f["max_length"], f["data_type"], f["num_precision"], f["num_scale"])
        if broken is not None:
            tests.append(F.when(broken, F.lit(f["name"])))
    if not tests:
        return df.withColumn("violations", F.array().cast("array<string>")).filter(F.lit(False))
    return df.withColumn("violations", F.array_compact(F.array(*tests))).filter(F.size("violations") > 0)


def _understood(df: DataFrame, predicate: str) -> bool:
    """Whether Spark can read a predicate on the columns of ``df``; nothing is run."""
    try:
        return bool(df.select(~F.expr(predicate)).columns)
    except AnalysisException:
        return False


def _row_rules(df: DataFrame, table: str, checks: list[tuple[str, str]], required: list[str]) -> DataFrame:
    """Check rules (broken rows) and the NOT NULL rule (columns with nulls) of one table, in one pass."""
    counts = [F.count_if(~F.expr(p)).alias(f"_c{i}") for i, (_, p) in enumerate(checks)]
    nulls = F.lit(0).cast("bigint")
    for c in _cols(required):
        nulls = nulls + F.when(F.count_if(c.isNull()) > 0, 1).otherwise(0)
    found = df.agg(*counts, nulls.alias("_nulls"))

    def row(rule: str, constraint: str, column: str) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.lit(constraint).alias("constraint"), F.col(column).alias("violations")
        )

    rows = [row("check", name, f"_c{i}") for i, (name, _) in enumerate(checks)]
    if required:
        rows.append(row("not null", "", "_nulls"))
    return found.select(F.inline(F.array(*rows)))


def violation_report(dfs: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """Number of violations per declared rule: ``rule``, ``table``, ``constraint``, ``violations``.

    What a database would refuse on restore, as one lazy DataFrame: keys count by value, checks by
    row, NOT NULL by column. A table is scanned once for all its keys, once for its checks and NOT NULL
    columns, and once for each foreign key. A check whose text Spark cannot read is listed with the rule
    ``check not translated`` and null violations. The loops run over the rules of the catalog, not
    over data.
    """
    parts: list[DataFrame] = []

    def add(rule: str, table: str, constraint: str, broken: DataFrame) -> None:
        named = [F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.lit(constraint).alias("constraint")]
        parts.append(broken.agg(F.count(F.lit(1)).alias("violations")).select(*named, "violations"))

    keys: dict[str, list[tuple[str, str, list[str]]]] = {}
    for rule, frame in (("primary key", catalog.keys), ("unique", catalog.uniques)):
        for r in frame.collect():
            keys.setdefault(qualify(r["schema"], r["table"]), []).append((rule, r["constraint"], r["columns"]))
    parts += [_key_rules(dfs[table], table, rules) for table, rules in keys.items() if table in dfs]
    for f in catalog.foreign_keys.collect():
        child, parent = qualify(f["src_schema"], f["src_table"]), qualify(f["ref_schema"], f["ref_table"])
        if child in dfs and parent in dfs:
            add("foreign key", child, f["constraint"], orphan_keys(dfs[child], dfs[parent], f["src_columns"], f["ref_columns"]))
    checks: dict[str, list[tuple[str, str]]] = {}
    strange: list[tuple] = []
    for c in catalog.checks.collect():
        table, predicate = qualify(c["schema"], c["table"]), check_predicate(c["condef"])
        if table not in dfs:
            continue
        if _understood(dfs[table], predicate):
            checks.setdefault(table, []).append((c["constraint"], predicate))
        else:
            strange.append(("check not translated", table, c["constraint"], None))
    required: dict[str, list[str]] = {}
    for c in catalog.columns.filter("not nullable").select("schema", "table", "name").collect():
        required.setdefault(qualify(c["schema"], c["table"]), []).append(c["name"])
    for table in sorted((set(checks) | set(required)) & set(dfs)):
        names = sorted(n for n in required.get(table, []) if n in dfs[table].columns)
        if names or checks.get(table):
            parts.append(_row_rules(dfs[table], table, checks.get(table, []), names))
    if strange or not parts:
        parts.append(local_frame(catalog.tables.sparkSession, strange, "rule string, table string, constraint string, violations bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
