"""Pages, row numbers, keys and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import TABLES, Registry, table
from snapforge.functions.codecs import decode_cells, encode_cells, row_key
from snapforge.operators.paging import (
    number_rows,
    page_number,
    page_size,
    read_page,
    row_count,
    row_sequence,
    running_totals,
    snapshot_totals,
)
from snapforge.sources.tables import JdbcSource, keyset_predicates, keyset_query, parquet_facts, sorted_bounds

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES)


def register(r: Registry) -> None:
    @r.add(
        f"""SELECT "table", n AS total_records, least(100000, greatest(1000, ceil(n / 10.0)))::BIGINT AS page_size,
                   (n // least(100000, greatest(1000, ceil(n / 10.0)))::BIGINT + 1)::BIGINT AS total_pages
            FROM ({_COUNTS})"""
    )
    def page_totals(spark, d):
        return snapshot_totals({t: table(spark, d, t) for t in TABLES})

    @r.add("SELECT count(*) AS row_count, max(l_orderkey) AS l_orderkey, max(l_linenumber) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem")
    def parquet_facts_lineitem(spark, d):
        return parquet_facts(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])

    @r.add("SELECT count(*) AS row_count FROM lineitem")
    def row_count_lineitem(spark, d):
        return row_count(table(spark, d, "lineitem"))

    @r.add(
        """SELECT o_custkey, count(*) AS n, least(100000, greatest(4, ceil(count(*) / 10.0)))::BIGINT AS page_size
           FROM orders GROUP BY o_custkey"""
    )
    def page_size_per_customer(spark, d):
        counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn("page_size", page_size(F.col("n"), 4))

    @r.add(
        """SELECT *, (row_num - 1) // (SELECT least(100000, greatest(1000, ceil(count(*) / 10.0)))::BIGINT FROM orders) AS page_num
           FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_num FROM orders)"""
    )
    def page_number_orders(spark, d):
        return page_number(table(spark, d, "orders"), ["o_orderkey"])

    @r.add(
        """SELECT page_num, count(*) AS row_count, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order,
                  sum(l_partkey)::BIGINT AS part_sum
           FROM (SELECT l_orderkey, l_partkey, (row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)
                   // (SELECT least(100000, greatest(1000, ceil(count(*) / 10.0)))::BIGINT FROM lineitem) AS page_num
                 FROM lineitem)
           GROUP BY page_num"""
    )
    def page_rows_lineitem(spark, d):
        return page_number(table(spark, d, "lineitem")).groupBy("page_num").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("l_orderkey").alias("first_order"),
            F.max("l_orderkey").alias("last_order"),
            F.sum("l_partkey").alias("part_sum"),
        )

    @r.add("SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_num FROM orders ORDER BY o_orderkey LIMIT 700 OFFSET 700")
    def read_page_orders(spark, d):
        return read_page(table(spark, d, "orders"), 1, 700, ["o_orderkey"])

    @r.add(
        """SELECT *, row_number() OVER (ORDER BY l_partkey, l_quantity, l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_discount,
                  l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_num FROM lineitem ORDER BY row_num LIMIT 500 OFFSET 30000"""
    )
    def read_page_lineitem(spark, d):
        """A page in the middle of a table without key, in the order of all columns, found without sorting the table."""
        df = table(spark, d, "lineitem")
        order = ["l_partkey", "l_quantity", "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount"]
        return read_page(df, 60, 500, order + ["l_tax", "l_returnflag", "l_linestatus", "l_shipdate"], most=2_000)

    @r.add(
        """SELECT *, row_number() OVER (ORDER BY props NULLS FIRST, event_id) AS row_num
           FROM (SELECT event_id, user_id, CASE WHEN user_id % 3 > 0 THEN props END AS props FROM events) ORDER BY row_num LIMIT 100 OFFSET 6600"""
    )
    def read_page_nulls_first(spark, d):
        events = table(spark, d, "events").selectExpr("event_id", "user_id", "CASE WHEN user_id % 3 > 0 THEN props END AS props")
        return read_page(events, 66, 100, ["props", "event_id"], nulls="first", most=300)

    # The same query and predicates as for a database, run by Spark SQL over the Parquet table.
    def keyset_parts(spark, d, name, pk, parts):
        source = JdbcSource("jdbc:none", "MYSQL")  # the vendor that quotes names as Spark does
        df = table(spark, d, name)
        view = f"keyset_{name}"
        df.createOrReplaceTempView(view)
        bounds = sorted_bounds(spark.sql(keyset_query(source, view, pk, parts)), pk)
        spark.catalog.dropTempView(view)
        cut = [df.filter(p).select(*pk, F.lit(i).cast("bigint").alias("part")) for i, p in enumerate(keyset_predicates(source, pk, bounds))]
        return reduce(DataFrame.unionByName, cut)

    _parts = "SELECT {keys}, (row_number() OVER (ORDER BY {keys}) - 1) * {n} // count(*) OVER () AS part FROM {table}"
    r.add(_parts.format(keys="conv_id, turn", n=7, table="conversations"), "keyset_parts_conversations")(
        lambda spark, d: keyset_parts(spark, d, "conversations", ["conv_id", "turn"], 7)
    )
    r.add(_parts.format(keys="url", n=20, table="pages"), "keyset_parts_pages")(lambda spark, d: keyset_parts(spark, d, "pages", ["url"], 20))

    _nulls = """SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment NULLS {where}, c_custkey) AS row_num
                FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""

    def numbered(spark, d, nulls):
        df = table(spark, d, "customer").select(
            "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")
        )
        return number_rows(df, ["c_mktsegment", "c_custkey"], nulls)

    r.add(_nulls.format(where="LAST"), "row_number_nulls_last")(lambda spark, d: numbered(spark, d, "last"))
    r.add(_nulls.format(where="FIRST"), "row_number_nulls_first")(lambda spark, d: numbered(spark, d, "first"))

    @r.add(
        """SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, role, text) AS row_key FROM conversations"""
    )
    def row_sequence_conversations(spark, d):
        return row_sequence(table(spark, d, "conversations")).select("conv_id", "turn", "row_key")

    @r.add(
        """SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS row_num FROM embeddings"""
    )
    def row_number_embeddings(spark, d):
        return number_rows(table(spark, d, "embeddings"), ["label", "vec_id"]).select("vec_id", "label", "row_num")

    @r.add("SELECT concat_ws('|-|', conv_id, turn) AS row_key, role FROM conversations")
    def row_key_composite(spark, d):
        return table(spark, d, "conversations").select(row_key(["turn", "conv_id"]).alias("row_key"), "role")

    @r.add("SELECT event_id::VARCHAR AS row_key, event_type FROM events")
    def row_key_single(spark, d):
        return table(spark, d, "events").select(row_key(["event_id"]).alias("row_key"), "event_type")

    @r.add(
        """SELECT o_orderkey, concat_ws('~', o_custkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'), o_orderkey,
                  o_orderpriority, o_orderstatus, o_totalprice) AS cells FROM orders"""
    )
    def encode_cells_orders(spark, d):
        df = table(spark, d, "orders")
        return df.select("o_orderkey", F.concat_ws("~", encode_cells(df.schema)).alias("cells"))

    @r.add(
        """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts,
                  to_base64(encode(props)) AS props, user_id::VARCHAR AS user_id,
                  CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type
           FROM events"""
    )
    def encode_cells_types(spark, d):
        typed = table(spark, d, "events").select(
            "event_id",
            F.to_date("ts").alias("day"),
            "ts",
            F.encode("props", "UTF-8").alias("props"),
            "user_id",
            F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        )
        cells = typed.select("event_id", encode_cells(typed.schema).alias("cells"))
        names = sorted(typed.columns)
        return cells.select(
            "event_id", *[F.col("cells")[names.index(n)].alias(n) for n in ("day", "ts", "props", "user_id", "event_type")]
        )

    @r.add("SELECT * FROM orders")
    def decode_cells_orders(spark, d):
        df = table(spark, d, "orders")
        return decode_cells(df.select(encode_cells(df.schema).alias("cells")), "cells", df.schema)

    @r.add("SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding) AS value FROM embeddings")
    def decode_cells_arrays(spark, d):
        df = table(spark, d, "embeddings")
        back = decode_cells(df.select(encode_cells(df.schema).alias("cells")), "cells", df.schema)
        return back.select("vec_id", "label", F.posexplode("embedding").alias("place", "value")).withColumn("place", F.col("place").cast("bigint"))

    @r.add(
        """SELECT event_type, event_id, row_number() OVER w AS rank, sum(user_id) OVER w AS running
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING)"""
        .replace("sum(user_id) OVER w", "(sum(user_id) OVER w)::BIGINT")
    )
    def running_totals_events(spark, d):
        return running_totals(
            table(spark, d, "events").select("event_type", "event_id", "ts", "user_id"),
            ["event_type"], [F.desc("ts"), F.asc("event_id")], "user_id",
        ).select("event_type", "event_id", "rank", "running")
