"""Catalog folds, catalog comparison, schema mapping, table evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import TABLES, Registry, table
from checks import derived as dv
from snapforge.catalog import (
    Catalog,
    catalog_columns,
    catalog_constraints,
    catalog_indexes,
    filter_schemas,
    validate_fk_catalog,
)
from snapforge.functions.names import data_file_name, qualified_name
from snapforge.operators import diff as df_
from snapforge.operators.evolve import ColumnOp, column_ops, evolve_table
from snapforge.operators.paging import snapshot_totals
from snapforge.operators.schema_map import map_schema


def _pair_sql(wanted: str, current: str, keys: list[str], fields: list[str], sets: tuple[str, ...] = ()) -> str:
    """Full outer comparison of two row sources; of duplicate keys the smallest row counts."""
    q = [f'"{k}"' for k in keys]

    def first(source: str, side: str) -> str:
        order = ", ".join(f'"{f}" NULLS FIRST' for f in fields)
        return (
            f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(q)} ORDER BY {order}) AS rn "
            f"FROM ({source})) WHERE rn = 1"
        )

    def value(side: str, f: str) -> str:
        return f'list_sort({side}."{f}")' if f in sets else f'{side}."{f}"'

    differs = [f"CASE WHEN {value('s', f)} IS DISTINCT FROM {value('t', f)} THEN '{f}' END" for f in fields]
    any_key = keys[-1]
    return f"""SELECT {', '.join(f'coalesce(s.{k}, t.{k}) AS {k}' for k in q)},
          CASE WHEN t."{any_key}" IS NULL THEN 'CREATE' WHEN s."{any_key}" IS NULL THEN 'DROP' ELSE 'MODIFY' END AS op,
          CASE WHEN t."{any_key}" IS NULL OR s."{any_key}" IS NULL THEN '' ELSE concat_ws(',', {', '.join(differs)}) END AS changed,
          {', '.join(f't."{f}" AS "old_{f}", s."{f}" AS "new_{f}"' for f in fields)}
        FROM ({first(wanted, 's')}) s FULL JOIN ({first(current, 't')}) t ON {' AND '.join(f's.{k} = t.{k}' for k in q)}
        WHERE t."{any_key}" IS NULL OR s."{any_key}" IS NULL OR {' OR '.join(f"{value('s', f)} IS DISTINCT FROM {value('t', f)}" for f in fields)}"""


_W, _C = dv.wanted_columns_sql(), dv.current_columns_sql()
_TABLES_W = f'SELECT DISTINCT "schema", "table" FROM ({_W})'
_TABLES_C = f'SELECT DISTINCT "schema", "table" FROM ({_C})'
_TABLE_DIFF = f"""SELECT "schema", "table", 'CREATE' AS op FROM (({_TABLES_W}) EXCEPT ({_TABLES_C}))
    UNION ALL SELECT "schema", "table", 'DROP' AS op FROM (({_TABLES_C}) EXCEPT ({_TABLES_W}))"""
_COLUMN_DIFF = f"""SELECT * FROM ({_pair_sql(_W, _C, ['schema', 'table', 'name'], df_.COLUMN_FIELDS)}) d
    WHERE EXISTS (SELECT 1 FROM ({_TABLES_W}) w WHERE w."schema" = d."schema" AND w."table" = d."table")
      AND EXISTS (SELECT 1 FROM ({_TABLES_C}) c WHERE c."schema" = d."schema" AND c."table" = d."table")"""


# Tables of the full pair: from the orders, the parts and the line items.
def _all_tables(columns: str, fks: dv.Exprs, where: str | None) -> str:
    return f"""SELECT DISTINCT "schema", "table" FROM ({columns})
        UNION SELECT DISTINCT p_brand, p_type FROM part {f'WHERE {where}' if where else ''}
        UNION SELECT DISTINCT src_schema, src_table FROM ({dv.sql_rows('lineitem', fks)})"""


_FULL_W = _all_tables(_W, dv.FKS_WANTED, None)
_FULL_C = _all_tables(_C, dv.FKS_CURRENT, dv.PARTS_CURRENT_FILTER)
_FULL_TABLE_DIFF = f"""SELECT "schema", "table", 'CREATE' AS op FROM (({_FULL_W}) EXCEPT ({_FULL_C}))
    UNION ALL SELECT "schema", "table", 'DROP' AS op FROM (({_FULL_C}) EXCEPT ({_FULL_W}))"""


def _skipping(sql: str, schema: str = "schema", table_: str = "table") -> str:
    return f"""SELECT d.* FROM ({sql}) d WHERE NOT EXISTS (SELECT 1 FROM ({_FULL_TABLE_DIFF}) g
        WHERE g."schema" = d."{schema}" AND g."table" = d."{table_}")"""


_FK_DIFF = _skipping(
    _pair_sql(
        dv.sql_rows("lineitem", dv.FKS_WANTED), dv.sql_rows("lineitem", dv.FKS_CURRENT),
        ["src_schema", "src_table", "constraint"], df_.FOREIGN_KEY_FIELDS, ("src_columns", "ref_columns"),
    ),
    "src_schema", "src_table",
)


def _part_diff(wanted: dv.Exprs, current: dv.Exprs, key: str, fields: list[str]) -> str:
    return _skipping(
        _pair_sql(
            dv.sql_rows("part", wanted), dv.sql_rows("part", current, dv.PARTS_CURRENT_FILTER), ["schema", "table", key], fields
        )
    )


_UNIQUE_DIFF = _part_diff(dv.UNIQUES_WANTED, dv.UNIQUES_CURRENT, "constraint", df_.UNIQUE_FIELDS)
_CHECK_DIFF = _part_diff(dv.CHECKS_WANTED, dv.CHECKS_CURRENT, "constraint", df_.CHECK_FIELDS)
_INDEX_DIFF = _part_diff(dv.INDEXES_WANTED, dv.INDEXES_CURRENT, "name", df_.INDEX_FIELDS)
_SEQUENCE_DIFF = _pair_sql(
    dv.sql_rows("customer", dv.SEQUENCES_WANTED), dv.sql_rows("customer", dv.SEQUENCES_CURRENT), ["schema", "name"], df_.SEQUENCE_FIELDS
)
_FULL_COLUMN_DIFF = f"""SELECT * FROM ({_pair_sql(_W, _C, ['schema', 'table', 'name'], df_.COLUMN_FIELDS)}) d
    WHERE EXISTS (SELECT 1 FROM ({_FULL_W}) w WHERE w."schema" = d."schema" AND w."table" = d."table")
      AND EXISTS (SELECT 1 FROM ({_FULL_C}) c WHERE c."schema" = d."schema" AND c."table" = d."table")"""


def _joined(fields: list[str]) -> list[str]:
    """Array fields of a comparison, as one text per side."""
    return [f for f in fields if f in ("columns", "extra_columns", "src_columns", "ref_columns")]


def _flat_sql(sql: str, fields: list[str]) -> str:
    arrays = _joined(fields)
    if not arrays:
        return sql
    swaps = ", ".join(f"array_to_string(\"{s}_{f}\", ',') AS \"{s}_{f}\"" for f in arrays for s in ("old", "new"))
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


def _flat(diff, keys: list[str], fields: list[str]):
    """The same shape from Spark: keys, op, changed, old_* and new_*."""

    def side(which: str, f: str):
        col = F.col(f"{which}.{f}")
        return (F.array_join(col, ",") if f in _joined(fields) else col).alias(f"{which}_{f}")

    pairs = [side(which, f) for f in fields for which in ("old", "new")]
    return diff.select(*keys, "op", F.concat_ws(",", "changed_fields").alias("changed"), *pairs)


_ALL_DIFFS = f"""
    SELECT 'table' AS entity, op, concat_ws('.', "schema", "table") AS qualified_name, concat_ws('.', "schema", "table") AS "table", '' AS changed FROM ({_FULL_TABLE_DIFF})
    UNION ALL SELECT 'column', op, concat_ws('.', "schema", "table", name), concat_ws('.', "schema", "table"), changed FROM ({_FULL_COLUMN_DIFF})
    UNION ALL SELECT 'foreign_key', op, concat_ws('.', src_schema, "constraint"), concat_ws('.', src_schema, src_table), changed FROM ({_FK_DIFF})
    UNION ALL SELECT 'unique', op, concat_ws('.', "schema", "constraint"), concat_ws('.', "schema", "table"), changed FROM ({_UNIQUE_DIFF})
    UNION ALL SELECT 'check', op, concat_ws('.', "schema", "constraint"), concat_ws('.', "schema", "table"), changed FROM ({_CHECK_DIFF})
    UNION ALL SELECT 'index', op, concat_ws('.', "schema", name), concat_ws('.', "schema", "table"), changed FROM ({_INDEX_DIFF})
    UNION ALL SELECT 'sequence', op, concat_ws('.', "schema", name), NULL, changed FROM ({_SEQUENCE_DIFF})"""

_TYPE_NAMES = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"


def register(r: Registry) -> None:
    @r.add(
        f"""SELECT c.table_name AS "table", c.column_name AS name, c.ordinal_position::INT AS ordinal, {_TYPE_NAMES} AS data_type, t.n AS total_records
            FROM information_schema.columns c JOIN ({' UNION ALL '.join(f"SELECT '{t}' AS tn, count(*) AS n FROM {t}" for t in TABLES)}) t ON t.tn = c.table_name"""
    )
    def catalog_columns_all(spark, d):
        dfs = {t: table(spark, d, t) for t in TABLES}
        totals = snapshot_totals(dfs).select("table", "total_records")
        return catalog_columns(spark, dfs).join(totals, "table").select("table", "name", "ordinal", "data_type", "total_records")

    @r.add(
        """SELECT 'key' AS kind, concat('c', conv_id) AS "constraint", string_agg(concat(role, turn), ',' ORDER BY turn) AS columns, NULL AS ref_columns
           FROM conversations GROUP BY conv_id
           UNION ALL SELECT 'unique', concat('u', conv_id), string_agg(concat(role, turn), ',' ORDER BY turn DESC), NULL FROM conversations GROUP BY conv_id
           UNION ALL SELECT 'foreign key', concat('f', conv_id), string_agg(concat(role, turn), ',' ORDER BY turn), string_agg(turn::VARCHAR, ',' ORDER BY turn)
           FROM conversations GROUP BY conv_id"""
    )
    def catalog_constraints_conversations(spark, d):
        turns = table(spark, d, "conversations")
        column = F.concat("role", F.col("turn").cast("string"))
        none = F.lit(None).cast("string")

        def rows(prefix: str, kind: str, order, ref_table, ref_column):
            return turns.select(
                F.lit("s").alias("schema"), F.lit("t").alias("table"), F.concat(F.lit(prefix), "conv_id").alias("constraint"),
                F.lit(kind).alias("kind"), order.alias("ord"), column.alias("column"),
                none.alias("ref_schema"), ref_table.alias("ref_table"), ref_column.alias("ref_column"),
            )

        every = (
            rows("c", "PRIMARY KEY", F.col("turn"), none, none)
            .unionByName(rows("u", "UNIQUE", -F.col("turn"), none, none))
            .unionByName(rows("f", "FOREIGN KEY", F.col("turn"), F.lit("r"), F.col("turn").cast("string")))
        )
        out = catalog_constraints(every)
        joined = F.concat_ws(",", "columns").alias("columns")
        return (
            out["keys"].select(F.lit("key").alias("kind"), "constraint", joined, none.alias("ref_columns"))
            .unionByName(out["uniques"].select(F.lit("unique").alias("kind"), "constraint", joined, none.alias("ref_columns")))
            .unionByName(
                out["foreign_keys"].select(
                    F.lit("foreign key").alias("kind"), "constraint", F.concat_ws(",", "src_columns").alias("columns"),
                    F.concat_ws(",", "ref_columns").alias("ref_columns"),
                )
            )
        )

    @r.add(
        """SELECT conv_id, coalesce(string_agg(concat(role, turn), ',' ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS columns,
                  coalesce(string_agg(concat(role, turn), ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS extra_columns
           FROM conversations GROUP BY conv_id"""
    )
    def catalog_indexes_conversations(spark, d):
        rows = table(spark, d, "conversations").select(
            F.lit("s").alias("schema"), F.lit("t").alias("table"), F.col("conv_id").alias("name"), F.lit(False).alias("unique"),
            F.lit("btree").alias("type"), F.col("turn").alias("ord"), F.concat("role", F.col("turn").cast("string")).alias("column"),
            (F.col("role") == "assistant").alias("is_included"),
        )
        return catalog_indexes(rows).select(
            F.col("name").alias("conv_id"), F.concat_ws(",", "columns").alias("columns"), F.concat_ws(",", "extra_columns").alias("extra_columns")
        )

    @r.add(f"SELECT \"schema\", \"table\", name, data_type FROM ({_C}) WHERE \"schema\" IN ('OLD', 'F')")
    def filter_schemas_columns(spark, d):
        _, current = dv.catalog_pair(spark, d)
        return filter_schemas(current, ["OLD", "F"]).columns.select("schema", "table", "name", "data_type")

    @r.add(
        """SELECT concat('fk_', l_orderkey, '_', l_linenumber) AS "constraint", 'unknown referenced table' AS problem,
                  concat('shop.p', l_partkey) AS qname, NULL AS "column"
           FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)
           UNION ALL SELECT concat('fk_', l_orderkey, '_', l_linenumber), 'unknown referenced column', concat('shop.p', l_partkey), concat('s', l_linenumber)
           FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 40 AND l_linenumber > 5"""
    )
    def validate_fk_catalog_lineitem(spark, d):
        line, part = table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size <= 40")
        fks = line.selectExpr(
            "concat('fk_', l_orderkey, '_', l_linenumber) as `constraint`", "'shop' as src_schema", "'line' as src_table",
            "array('x') as src_columns", "'shop' as ref_schema", "concat('p', l_partkey) as ref_table", "array(concat('s', l_linenumber)) as ref_columns",
        )
        names = F.explode(F.array(*[F.lit(f"s{i}") for i in range(1, 6)]))
        columns = part.select(F.lit("shop").alias("schema"), F.concat(F.lit("p"), "p_partkey").alias("table"), names.alias("name"))
        tables = columns.select("schema", "table").distinct().unionByName(line.select(F.lit("shop").alias("schema"), F.lit("line").alias("table")).distinct())
        catalog = Catalog.of(spark, columns=columns, tables=tables, foreign_keys=fks, schemas=["shop"])
        return validate_fk_catalog(catalog)

    @r.add("SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
    def names_only_in_customers(spark, d):
        big = table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("custkey"))
        return df_.names_only_in(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), big)

    @r.add("SELECT DISTINCT n_nationkey AS nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
    def names_in_both_nations(spark, d):
        c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
        return df_.names_in_both(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))

    @r.add(_TABLE_DIFF)
    def diff_tables(spark, d):
        return df_.diff_tables(*dv.catalog_pair(spark, d))

    @r.add(_COLUMN_DIFF)
    def diff_columns(spark, d):
        return _flat(df_.diff_columns(*dv.catalog_pair(spark, d)), ["schema", "table", "name"], df_.COLUMN_FIELDS)

    @r.add(_flat_sql(_FK_DIFF, df_.FOREIGN_KEY_FIELDS))
    def diff_foreign_keys(spark, d):
        return _flat(df_.diff_foreign_keys(*dv.full_catalog_pair(spark, d)), ["src_schema", "src_table", "constraint"], df_.FOREIGN_KEY_FIELDS)

    @r.add(_flat_sql(_UNIQUE_DIFF, df_.UNIQUE_FIELDS))
    def diff_uniques(spark, d):
        return _flat(df_.diff_uniques(*dv.full_catalog_pair(spark, d)), ["schema", "table", "constraint"], df_.UNIQUE_FIELDS)

    @r.add(_CHECK_DIFF)
    def diff_checks(spark, d):
        return _flat(df_.diff_checks(*dv.full_catalog_pair(spark, d)), ["schema", "table", "constraint"], df_.CHECK_FIELDS)

    @r.add(_flat_sql(_INDEX_DIFF, df_.INDEX_FIELDS))
    def diff_indexes(spark, d):
        return _flat(df_.diff_indexes(*dv.full_catalog_pair(spark, d)), ["schema", "table", "name"], df_.INDEX_FIELDS)

    @r.add(_SEQUENCE_DIFF)
    def diff_sequences(spark, d):
        return _flat(df_.diff_sequences(*dv.full_catalog_pair(spark, d)), ["schema", "name"], df_.SEQUENCE_FIELDS)

    @r.add(_ALL_DIFFS)
    def diff_catalog(spark, d):
        out = df_.diff_catalog(*dv.full_catalog_pair(spark, d))
        return out.select("entity", "op", "qualified_name", "table", F.concat_ws(",", "changed_fields").alias("changed"))

    @r.add(f"SELECT entity, op, count(*) AS changes FROM ({_ALL_DIFFS}) WHERE entity <> 'sequence' GROUP BY entity, op")
    def diff_dry_run(spark, d):
        return df_.dry_run(*dv.full_catalog_pair(spark, d), skip_sequences=True)

    @r.add(
        f"""SELECT CASE WHEN lower("schema") = 'old' THEN 'archive' ELSE "schema" END AS "schema", "table", name, data_type FROM ({_C})"""
    )
    def map_schema_columns(spark, d):
        _, current = dv.catalog_pair(spark, d)
        renamed, _ = map_schema(current.with_frames(schemas=("OLD", "F", "O", "P")), {}, "Old", "archive")
        return renamed.columns.select("schema", "table", "name", "data_type")

    @r.add(
        """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN concat('c', o_custkey) ELSE concat(o_orderstatus, '.c', o_custkey) END AS qualified_name,
                  concat('data-', CASE WHEN o_orderstatus = 'P' THEN concat('c', o_custkey) ELSE concat(o_orderstatus, '.c', o_custkey) END, '.json') AS file_name
           FROM orders"""
    )
    def qualified_names_orders(spark, d):
        schema = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_totalprice") > 200000, "")).otherwise(F.col("o_orderstatus"))
        name = qualified_name(schema, F.concat(F.lit("c"), "o_custkey"))
        return table(spark, d, "orders").select("o_orderkey", name.alias("qualified_name"), data_file_name(name).alias("file_name"))

    @r.add(
        """SELECT c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal, 'new' AS status, 7::BIGINT AS points, NULL::DATE AS seen
           FROM customer"""
    )
    def evolve_customer(spark, d):
        ops = [
            ColumnOp("CREATE", "status", "varchar", default="'new'::character varying", nullable=False),
            ColumnOp("CREATE", "points", "int8", default="7"),
            ColumnOp("CREATE", "seen", "date"),
            ColumnOp("DROP", "c_mktsegment"),
            ColumnOp("MODIFY", "c_nationkey", "text"),
        ]
        return evolve_table(table(spark, d, "customer"), ops)[0]

    @r.add("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
    def evolve_failures_kept(spark, d):
        ops = [
            ColumnOp("MODIFY", "p_name", "int4"),  # texts are no numbers
            ColumnOp("MODIFY", "p_type", "varchar", max_length=3),  # too long
            ColumnOp("CREATE", "flag", "bool", nullable=False),  # no default for existing rows
            ColumnOp("MODIFY", "p_size", "numeric", num_precision=1, num_scale=0),  # too wide
            ColumnOp("DROP", "absent"),
            ColumnOp("MODIFY", "p_partkey", "varchar", max_length=30),
        ]
        return evolve_table(table(spark, d, "part"), ops, ["p_partkey", "p_name"])[0]

    @r.add(
        """SELECT * EXCLUDE (l_tax) REPLACE (TRY_CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice, l_shipdate::DATE AS l_shipdate),
                  true AS checked FROM lineitem"""
    )
    def evolve_lineitem_from_diff(spark, d):
        line = table(spark, d, "lineitem")
        names = {"l": line}
        current = Catalog.of(spark, columns=catalog_columns(spark, names))
        wanted_rows = catalog_columns(spark, names).filter("name <> 'l_tax'")
        numeric = F.col("name") == "l_extendedprice"
        wanted_rows = wanted_rows.withColumns(
            {
                "data_type": F.when(numeric, "numeric").when(F.col("name") == "l_shipdate", "date").otherwise(F.col("data_type")),
                "num_precision": F.when(numeric, 12).otherwise(F.col("num_precision")),
                "num_scale": F.when(numeric, 2).otherwise(F.col("num_scale")),
            }
        )
        extra = wanted_rows.limit(1).withColumns(
            {"name": F.lit("checked"), "data_type": F.lit("boolean"), "column_type": F.lit("boolean"), "column_default": F.lit("true"), "ordinal": F.lit(99),
             "num_precision": F.lit(None).cast("int"), "num_scale": F.lit(None).cast("int")}
        )
        wanted = Catalog.of(spark, columns=wanted_rows.unionByName(extra))
        ops = column_ops(df_.diff_columns(wanted, current), None, "l")
        return evolve_table(line, ops)[0]
