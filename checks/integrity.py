"""Violations of declared rules, and sequence values."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import Registry, table
from snapforge.catalog import SCHEMAS, Catalog, Column, ForeignKey
from snapforge.operators import integrity as ig
from snapforge.session import local_frame
from snapforge.operators.sequences import SequenceMapping, advance_sequences, max_value, next_sequence_values

_LENGTH_COLUMNS = [
    Column("shop", "part", "p_name", "varchar", max_length=10),
    Column("shop", "part", "p_brand", "varchar", max_length=7),
    Column("shop", "part", "p_retailprice", "decimal", num_precision=5, num_scale=1),
]


def register(r: Registry) -> None:
    @r.add(
        """SELECT l_orderkey, l_linenumber, count(*) AS row_count, 'duplicate' AS reason FROM lineitem
           GROUP BY ALL HAVING count(*) > 1"""
    )
    def pk_dup_lineitem(spark, d):
        return ig.pk_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])

    @r.add(
        """SELECT user_id, event_type, count(*) AS row_count, CASE WHEN event_type IS NULL THEN 'null' ELSE 'duplicate' END AS reason
           FROM (SELECT user_id, nullif(event_type, 'error') AS event_type FROM events)
           GROUP BY user_id, event_type HAVING count(*) > 1 OR event_type IS NULL"""
    )
    def pk_null_keys_events(spark, d):
        df = table(spark, d, "events").select("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
        return ig.pk_violations(df, ["user_id", "event_type"])

    @r.add("SELECT p_name, count(*) AS row_count FROM part GROUP BY p_name HAVING count(*) > 1")
    def unique_dup_part_name(spark, d):
        return ig.unique_violations(table(spark, d, "part"), ["p_name"])

    @r.add(
        """SELECT c_nationkey, c_mktsegment, count(*) AS row_count
           FROM (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)
           WHERE c_mktsegment IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""
    )
    def unique_null_passes(spark, d):
        df = table(spark, d, "customer").select(
            "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")
        )
        return ig.unique_violations(df, ["c_nationkey", "c_mktsegment"])

    @r.add("SELECT text, count(*) AS row_count FROM documents GROUP BY text HAVING count(*) > 1")
    def unique_dup_documents_text(spark, d):
        return ig.unique_violations_wide(table(spark, d, "documents"), ["text"])

    @r.add("SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)")
    def fk_orphans_orders(spark, d):
        parents = table(spark, d, "customer").filter("c_acctbal >= 0")
        return ig.fk_violations(table(spark, d, "orders"), parents, ["o_custkey"], ["c_custkey"])

    @r.add(
        """SELECT l_partkey, count(*) AS row_count FROM lineitem
           WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25) GROUP BY l_partkey"""
    )
    def fk_orphan_keys_lineitem(spark, d):
        parents = table(spark, d, "part").filter("p_size <= 25")
        return ig.orphan_keys(table(spark, d, "lineitem"), parents, ["l_partkey"], ["p_partkey"])

    @r.add(
        """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS row_count
           FROM (SELECT nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus, l_linenumber FROM lineitem) l
           WHERE l_returnflag IS NOT NULL AND NOT EXISTS (
             SELECT 1 FROM lineitem p WHERE p.l_returnflag = l.l_returnflag AND p.l_linestatus = l.l_linestatus
               AND p.l_linenumber = l.l_linenumber AND p.l_quantity > 49.5 AND p.l_tax > 0.075 AND p.l_discount < 0.005)
           GROUP BY ALL"""
    )
    def fk_composite_null_passes(spark, d):
        line = table(spark, d, "lineitem")
        child = line.select(F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"), "l_linestatus", "l_linenumber")
        parent = line.filter("l_quantity > 49.5 and l_tax > 0.075 and l_discount < 0.005").select(
            F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("c")
        )
        return ig.orphan_keys(child, parent, ["l_returnflag", "l_linestatus", "l_linenumber"], ["a", "b", "c"])

    for child, key, parent, ref in (
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("labels", "doc_id", "documents", "doc_id"),
        ("events", "user_id", "customer", "c_custkey"),
    ):
        r.add(
            f"SELECT {key}, count(*) AS row_count FROM {child} WHERE {key} NOT IN (SELECT {ref} FROM {parent}) GROUP BY {key}",
            f"fk_{child}_{parent}",
        )(
            lambda spark, d, child=child, key=key, parent=parent, ref=ref: ig.orphan_keys(
                table(spark, d, child), table(spark, d, parent), [key], [ref]
            )
        )

    @r.add("SELECT * FROM customer WHERE NOT (c_acctbal >= 0)")
    def check_acctbal(spark, d):
        return ig.check_violations(table(spark, d, "customer"), ig.check_predicate("CHECK ((c_acctbal >= 0))"))

    @r.add("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT (l_discount <= 0.08 OR l_tax < 0.02)")
    def check_discount(spark, d):
        return ig.check_violations(table(spark, d, "lineitem"), "l_discount <= 0.08 or l_tax < 0.02").select(
            "l_orderkey", "l_linenumber", "l_discount", "l_tax"
        )

    @r.add(
        """SELECT 'event_type' AS "column", count(*) AS null_count FROM events WHERE event_type = 'error'
           UNION ALL SELECT 'value', count(*) FROM events WHERE value < 1"""
    )
    def not_null_events(spark, d):
        df = table(spark, d, "events").select(
            "event_id",
            F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
            F.when(F.col("value") >= 1, F.col("value")).alias("value"),
        )
        return ig.not_null_violations(df, ["event_id", "event_type", "value"])

    @r.add(
        """SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) > 10 THEN 'p_name' END,
                  CASE WHEN length(p_brand) > 7 THEN 'p_brand' END,
                  CASE WHEN TRY_CAST(p_retailprice AS DECIMAL(5,1)) IS NULL THEN 'p_retailprice' END) AS violations
           FROM part
           WHERE length(p_name) > 10 OR length(p_brand) > 7 OR TRY_CAST(p_retailprice AS DECIMAL(5,1)) IS NULL"""
    )
    def length_part(spark, d):
        catalog = Catalog.of(spark, columns=_LENGTH_COLUMNS)
        broken = ig.length_violations(table(spark, d, "part"), catalog.columns)
        return broken.select("p_partkey", F.concat_ws(",", "violations").alias("violations"))

    @r.add(
        """SELECT 'primary key' AS rule, 'shop.lineitem' AS "table", 'pk_line' AS "constraint",
                  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS violations
           UNION ALL SELECT 'primary key', 'shop.orders', 'pk_orders', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
           UNION ALL SELECT 'unique', 'shop.part', 'uk_name', (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_name HAVING count(*) > 1))
           UNION ALL SELECT 'foreign key', 'shop.orders', 'fk_customer', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
           UNION ALL SELECT 'foreign key', 'shop.lineitem', 'fk_orders', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
           UNION ALL SELECT 'check', 'shop.customer', 'ck_balance', (SELECT count(*) FROM customer WHERE c_acctbal < 0)
           UNION ALL SELECT 'not null', 'shop.customer', '', (SELECT (count(*) FILTER (WHERE c_name IS NULL) > 0)::BIGINT FROM customer)"""
    )
    def violation_report(spark, d):
        names = ("customer", "orders", "lineitem", "part")
        catalog = Catalog.of(
            spark,
            columns=[Column("shop", "customer", "c_name", "varchar", nullable=False)],
            keys=[("shop", "lineitem", "pk_line", ["l_orderkey", "l_linenumber"]), ("shop", "orders", "pk_orders", ["o_orderkey"])],
            uniques=[("shop", "part", "uk_name", ["p_name"])],
            foreign_keys=[
                ForeignKey("fk_customer", "shop", "orders", ("o_custkey",), "shop", "customer", ("c_custkey",)),
                ForeignKey("fk_orders", "shop", "lineitem", ("l_orderkey",), "shop", "orders", ("o_orderkey",)),
            ],
            checks=[("shop", "customer", "ck_balance", "CHECK (c_acctbal >= 0)")],
        )
        return ig.violation_report({f"shop.{t}": table(spark, d, t) for t in names}, catalog)

    @r.add("SELECT trunc(max(o_totalprice))::BIGINT AS max_value FROM orders")
    def max_value_orders(spark, d):
        return max_value(table(spark, d, "orders"), "o_totalprice")

    _sequences = [
        ("shop", "orders_o_orderkey_seq"), ("shop", "lineitem_l_orderkey_seq"), ("shop", "customer_c_custkey_seq"),
        ("shop", "price_seq"), ("shop", "empty_seq"), ("shop", "name_seq"), ("shop", "lineitem_o_orderkey_seq"),
    ]

    def sequence_frame(spark):
        full = SCHEMAS["sequences"]
        return local_frame(spark, [(s, n, 1, 1, None, 1, False, 1, 0) for s, n in _sequences], full)

    def new_values(spark, d):
        dfs = {f"shop.{t}": table(spark, d, t) for t in ("customer", "orders", "lineitem", "part")}
        dfs["shop.no_rows"] = table(spark, d, "part").filter("p_size > 1000")
        mappings = [
            SequenceMapping("shop", "price_seq", "part", "p_retailprice"),
            SequenceMapping("shop", "empty_seq", "no_rows", "p_partkey"),
            SequenceMapping("shop", "name_seq", "customer", "c_name"),
            SequenceMapping("shop", "customer_c_custkey_seq", "customer", "c_custkey"),
            SequenceMapping("shop", "absent_seq", "part", "p_partkey"),
            SequenceMapping("shop", "price_seq", "absent", "p_partkey"),
            SequenceMapping("shop", "price_seq", "part", "absent"),
        ]
        return next_sequence_values(dfs, sequence_frame(spark), "{tableName}_{columnName}_seq", "o_orderkey", mappings)

    @r.add(
        """SELECT 'shop.orders_o_orderkey_seq' AS sequence, 'shop.orders' AS "table", 'o_orderkey' AS "column",
                  max(o_orderkey) AS max_value, max(o_orderkey) + 1 AS new_value FROM orders
           UNION ALL SELECT 'shop.price_seq', 'shop.part', 'p_retailprice', trunc(max(p_retailprice))::BIGINT, trunc(max(p_retailprice))::BIGINT + 1 FROM part
           UNION ALL SELECT 'shop.empty_seq', 'shop.no_rows', 'p_partkey', NULL, 1
           UNION ALL SELECT 'shop.name_seq', 'shop.customer', 'c_name', NULL, 1
           UNION ALL SELECT 'shop.customer_c_custkey_seq', 'shop.customer', 'c_custkey', max(c_custkey), max(c_custkey) + 1 FROM customer"""
    )
    def next_sequences(spark, d):
        return new_values(spark, d)

    @r.add(
        """SELECT name, CASE name WHEN 'orders_o_orderkey_seq' THEN (SELECT max(o_orderkey) + 1 FROM orders)
             WHEN 'price_seq' THEN (SELECT trunc(max(p_retailprice))::BIGINT + 1 FROM part)
             WHEN 'customer_c_custkey_seq' THEN (SELECT max(c_custkey) + 1 FROM customer)
             WHEN 'empty_seq' THEN 1 WHEN 'name_seq' THEN 1 ELSE 0 END AS last_value
           FROM (VALUES """ + ", ".join(f"('{n}')" for _, n in _sequences) + ") AS s(name)"
    )
    def advance_sequences_shop(spark, d):
        return advance_sequences(sequence_frame(spark), new_values(spark, d)).select("name", "last_value")
