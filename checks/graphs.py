"""Levels, reachability and cycles of references between rows.

The rows of the shop tables refer to each other, which gives a large graph of the same kind as the
foreign keys between tables: orders to customers, customers and suppliers to nations, nations to
regions, and customers directly to the region of their nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Registry, table
from snapforge.operators.graph import break_edges, cycle_edges, dependency_levels, load_order, reachability
from snapforge.operators.paging import number_rows
from snapforge.session import keep

_EDGES = """SELECT concat('orders/', o_orderkey) AS src, concat('customer/', o_custkey) AS ref FROM orders
    UNION SELECT concat('customer/', c_custkey), concat('nation/', c_nationkey) FROM customer
    UNION SELECT concat('supplier/', s_suppkey), concat('nation/', s_nationkey) FROM supplier
    UNION SELECT concat('nation/', n_nationkey), concat('region/', n_regionkey) FROM nation
    UNION SELECT concat('customer/', c_custkey), concat('region/', n_regionkey) FROM customer JOIN nation ON n_nationkey = c_nationkey"""
# Every region refers back to its first nation, and the best customer of a nation to itself.
_BACK = """SELECT concat('region/', n_regionkey) AS src, concat('nation/', min(n_nationkey)) AS ref FROM nation GROUP BY n_regionkey
    UNION SELECT concat('customer/', max_by(c_custkey, c_acctbal)), concat('customer/', max_by(c_custkey, c_acctbal)) FROM customer GROUP BY c_nationkey"""
_PATHS = """WITH RECURSIVE e AS ({edges}), p(src, ref) AS (
      SELECT src, ref FROM e UNION SELECT p.src, e.ref FROM p JOIN e ON p.ref = e.src)"""

# Each customer refers to the first and the last order, the last to the first, and the first to the customer: two cycles that share edges.
_RINGS = """SELECT concat('customer/', o_custkey) AS c, concat('orders/', min(o_orderkey)) AS a, concat('orders/', max(o_orderkey)) AS b
    FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING min(o_orderkey) < max(o_orderkey)"""


def overlapping_edges(spark, d) -> DataFrame:
    a, b = F.min("o_orderkey"), F.max("o_orderkey")
    rings = (
        table(spark, d, "orders").filter("o_custkey is not null").groupBy("o_custkey").agg(a.alias("a"), b.alias("b")).filter("a < b")
        .select(F.concat(F.lit("customer/"), "o_custkey").alias("c"), F.concat(F.lit("orders/"), "a").alias("a"), F.concat(F.lit("orders/"), "b").alias("b"))
    )
    ends = F.expr("inline(array(struct(c as src, a as ref), struct(c as src, b as ref), struct(b as src, a as ref), struct(a as src, c as ref)))")
    return rings.select(ends)


def _edge(df: DataFrame, a: str, ak: str, b: str, bk: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{a}/"), ak).alias("src"), F.concat(F.lit(f"{b}/"), bk).alias("ref"))


def row_edges(spark, d) -> DataFrame:
    orders, customer, supplier, nation = (table(spark, d, t) for t in ("orders", "customer", "supplier", "nation"))
    located = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return (
        _edge(orders, "orders", "o_orderkey", "customer", "o_custkey")
        .unionByName(_edge(customer, "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(_edge(supplier, "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(_edge(nation, "nation", "n_nationkey", "region", "n_regionkey"))
        .unionByName(_edge(located, "customer", "c_custkey", "region", "n_regionkey"))
    )


def cyclic_edges(spark, d) -> DataFrame:
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    capital = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    best = customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", "c_acctbal").alias("a"))
    return (
        row_edges(spark, d)
        .unionByName(_edge(capital, "region", "n_regionkey", "nation", "n_nationkey"))
        .unionByName(_edge(best, "customer", "a", "customer", "a"))
    )


def register(r: Registry) -> None:
    @r.add(
        """SELECT concat('orders/', o_orderkey) AS node, (row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1)::INTEGER AS level
           FROM orders"""
    )
    def fk_levels_deep(spark, d):
        """Three chains, in which each order refers to the one before it: as deep as a third of the table is long."""
        orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("third"))
        numbered = keep(number_rows(orders.filter("o_orderkey is not null"), ["third", "o_orderkey"]), "numbered")
        before = numbered.select((F.col("row_num") + 1).alias("row_num"), "third", F.col("o_orderkey").alias("ref"))
        edges = _edge(numbered.join(before, ["row_num", "third"]), "orders", "o_orderkey", "orders", "ref")
        return dependency_levels(edges, orders.select(F.concat(F.lit("orders/"), "o_orderkey").alias("node")))

    @r.add(
        f"""WITH RECURSIVE e AS ({_EDGES}), l(node, level) AS (
              SELECT DISTINCT ref, 0 FROM e WHERE ref NOT IN (SELECT src FROM e)
              UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.ref = l.node)
            SELECT node, max(level)::INT AS level FROM l GROUP BY node"""
    )
    def fk_levels(spark, d):
        return dependency_levels(row_edges(spark, d))

    @r.add(f"{_PATHS.format(edges=_EDGES)} SELECT src, ref FROM p")
    def fk_closure(spark, d):
        return reachability(row_edges(spark, d))

    @r.add(f"{_PATHS.format(edges=_EDGES + ' UNION ' + _BACK)} SELECT src, ref FROM p")
    def fk_closure_cyclic(spark, d):
        return reachability(cyclic_edges(spark, d))

    @r.add(
        f"""{_PATHS.format(edges=_EDGES + ' UNION ' + _BACK)}
            SELECT src, ref FROM e WHERE EXISTS (SELECT 1 FROM p WHERE p.src = e.ref AND p.ref = e.src) OR e.src = e.ref"""
    )
    def fk_cycles(spark, d):
        return cycle_edges(cyclic_edges(spark, d)).distinct()

    # Every cycle is a region with one nation, or one customer: the edge into the root goes.
    @r.add(
        """SELECT concat('nation/', min(n_nationkey)) AS src, concat('region/', n_regionkey) AS ref FROM nation GROUP BY n_regionkey
           UNION SELECT concat('customer/', max_by(c_custkey, c_acctbal)), concat('customer/', max_by(c_custkey, c_acctbal)) FROM customer GROUP BY c_nationkey"""
    )
    def fk_break_edges(spark, d):
        return break_edges(cyclic_edges(spark, d)).distinct()

    @r.add(
        f"""WITH RECURSIVE broken AS (
              SELECT concat('nation/', min(n_nationkey)) AS src, concat('region/', n_regionkey) AS ref FROM nation GROUP BY n_regionkey),
            e AS (SELECT * FROM ({_EDGES} UNION {_BACK}) x
                  WHERE src <> ref AND NOT EXISTS (SELECT 1 FROM broken b WHERE b.src = x.src AND b.ref = x.ref)),
            l(node, level) AS (
              SELECT DISTINCT ref, 0 FROM e WHERE ref NOT IN (SELECT src FROM e)
              UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.ref = l.node)
            SELECT node, max(level)::INT AS level FROM l GROUP BY node"""
    )
    def fk_load_order(spark, d):
        return load_order(cyclic_edges(spark, d))

    @r.add(f"SELECT a AS src, c AS ref FROM ({_RINGS})")
    def fk_break_edges_overlapping(spark, d):
        return break_edges(overlapping_edges(spark, d))

    @r.add(
        f"""SELECT a AS node, 0::INT AS level FROM ({_RINGS}) UNION ALL SELECT b, 1::INT FROM ({_RINGS})
            UNION ALL SELECT c, 2::INT FROM ({_RINGS})"""
    )
    def fk_load_order_overlapping(spark, d):
        return load_order(overlapping_edges(spark, d))
