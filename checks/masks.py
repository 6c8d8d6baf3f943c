"""Masks and their configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import Registry, table
from checks.derived import catalog_pair, wanted_columns_sql
from snapforge.catalog import Catalog, Column
from snapforge.functions.masks import mask_fixed, mask_original, mask_random
from snapforge.operators.masking import Mask, MaskTarget, mask_columns, mask_table, validate_mask_config


def register(r: Registry) -> None:
    @r.add(
        "SELECT c_custkey, repeat('*', least(5, 18)) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
    )
    def mask_fixed_customer(spark, d):
        return table(spark, d, "customer").withColumn("c_name", mask_fixed(F.col("c_name"), "*", 5, 18))

    @r.add("SELECT doc_id, repeat('x', length(text)::INT) AS text, lang, source, n_chars FROM documents")
    def mask_original_documents(spark, d):
        return mask_table(table(spark, d, "documents"), {"text": None}, Mask("ORIGINAL", "x"))

    @r.add(
        "SELECT page_id, repeat('#', length(url)::INT) AS url, repeat('#', length(html)::INT) AS html FROM pages"
    )
    def mask_original_pages(spark, d):
        return mask_table(table(spark, d, "pages"), {"url": None, "html": None}, Mask("ORIGINAL", "#"))

    @r.add(
        """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE repeat('*', 8) END AS c_mktsegment
           FROM customer"""
    )
    def mask_null_kept(spark, d):
        df = table(spark, d, "customer").select(
            "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")
        )
        return mask_table(df, {"c_mktsegment": 10}, Mask("FIXED", "*", 8))

    @r.add(
        """SELECT p_partkey, repeat('9', length(p_size::VARCHAR)::INT) AS p_size,
                  repeat('9', length(p_partkey::VARCHAR)::INT) AS p_partkey_text
           FROM part"""
    )
    def mask_number_as_text(spark, d):
        return table(spark, d, "part").select(
            "p_partkey",
            mask_original(F.col("p_size"), "9").alias("p_size"),
            mask_original(F.col("p_partkey"), "9").alias("p_partkey_text"),
        )

    @r.add(
        """SELECT c_mktsegment, count(*) AS row_count, 0::BIGINT AS too_short, 0::BIGINT AS too_long,
                  0::BIGINT AS other_characters, true AS lengths_vary
           FROM customer GROUP BY c_mktsegment"""
    )
    def mask_random_bounds(spark, d):
        masked = mask_table(table(spark, d, "customer"), {"c_name": 18}, Mask("RANDOM", "*", seed=11), ["c_custkey"])
        length = F.length("c_name")
        return masked.groupBy("c_mktsegment").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(length < 1).alias("too_short"),
            F.count_if(length > 18).alias("too_long"),
            F.count_if(~F.col("c_name").rlike(r"^\*+$")).alias("other_characters"),
            (F.max(length) > F.min(length)).alias("lengths_vary"),
        )

    @r.add(
        """SELECT event_type, count(*) AS row_count, count(*) AS repeated_equal, 0::BIGINT AS past_limit
           FROM events GROUP BY event_type"""
    )
    def mask_random_repeatable(spark, d):
        key = [F.col("event_id")]
        events = table(spark, d, "events")
        one = mask_random(F.col("props"), "?", None, key, 3)
        two = mask_random(F.col("event_type"), "?", None, key, 3)
        # Same seed and key give the same length, whatever the value is.
        return events.select("event_type", one.alias("a"), two.alias("b")).groupBy("event_type").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("a") == F.col("b")).alias("repeated_equal"),
            F.count_if(~F.length("a").between(1, 100)).alias("past_limit"),
        )

    @r.add(
        """SELECT 'customer' AS source, c_custkey AS id, repeat('*', 6) AS name, c_mktsegment AS other FROM customer
           UNION ALL SELECT 'supplier', s_suppkey, repeat('*', 4), NULL FROM supplier
           UNION ALL SELECT 'part', p_partkey, p_name, p_brand FROM part"""
    )
    def mask_columns_tables(spark, d):
        dfs = {f"shop.{t}": table(spark, d, t) for t in ("customer", "supplier", "part")}
        catalog = Catalog.of(
            spark,
            columns=[
                Column("shop", "customer", "c_name", "varchar", max_length=18),
                Column("shop", "supplier", "s_name", "varchar", max_length=4),
                Column("shop", "part", "p_name", "varchar", max_length=20),
            ],
        )
        targets = [MaskTarget("shop", "customer", "c_name"), MaskTarget("shop", "supplier", "s_name")]
        out = mask_columns(dfs, catalog, targets, Mask("FIXED", "*", 6))
        return (
            out["shop.customer"].select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("other"))
            .unionByName(out["shop.supplier"].select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("other")))
            .unionByName(out["shop.part"].select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("other")))
        )

    @r.add(
        f"""WITH known AS ({wanted_columns_sql()}),
            asked AS (
              SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'lost' ELSE o_orderstatus END AS "schema",
                     concat('c', o_custkey) AS "table",
                     CASE WHEN o_totalprice > 300000 THEN concat('x', o_orderkey) ELSE concat('o', o_orderkey) END AS "column"
              FROM orders)
            SELECT "schema", "table", "column",
                   CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k."schema" = a."schema" AND k."table" = a."table")
                        THEN 'column not found' ELSE 'table not found' END AS error
            FROM asked a
            WHERE NOT EXISTS (SELECT 1 FROM known k
              WHERE k."schema" = a."schema" AND k."table" = a."table" AND k.name = a."column")"""
    )
    def validate_mask_targets(spark, d):
        wanted, _ = catalog_pair(spark, d)
        asked = table(spark, d, "orders").select(
            F.when(F.col("o_orderpriority") == "1-URGENT", "lost").otherwise(F.col("o_orderstatus")).alias("schema"),
            F.concat(F.lit("c"), "o_custkey").alias("table"),
            F.concat(F.when(F.col("o_totalprice") > 300000, "x").otherwise("o"), "o_orderkey").alias("column"),
        )
        return validate_mask_config(wanted, asked)
