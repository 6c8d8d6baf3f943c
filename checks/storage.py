"""Writing, reading back, restoring and clearing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import TABLES, Registry, table
from snapforge.catalog import Catalog, Column, ForeignKey, catalog_columns
from snapforge.operators.manifest import merge_manifest
from snapforge.operators.masking import Mask, MaskTarget
from snapforge.operators.paging import row_count
from snapforge.plans.flows import RunLog, backup, masked_restore
from snapforge.session import scratch_path
from snapforge.sinks.interchange import write_backup
from snapforge.sinks.restore import TableTarget, clear_tables, drop_tables, restore_all
from snapforge.sinks.snapshots import Storage, clear_version, delete_version, write_compressed, write_fanout, write_snapshot
from snapforge.sources.interchange import read_backup
from snapforge.sources.page_json import read_page_json, read_page_totals, read_pages, write_page_json, write_table_document
from snapforge.sources.snapshots import read_manifest, read_numbered, read_snapshot, read_snapshot_page, read_version

PKS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "events": ["event_id"], "documents": ["doc_id"],
    "labels": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "benchmark": ["item_id"], "embeddings": ["vec_id"],
}
SHOP = ("region", "nation", "customer", "supplier", "orders")


def shop_catalog(spark, source_type: str | None = None) -> Catalog:
    return Catalog.of(
        spark,
        tables=[(None, t) for t in SHOP],
        columns=[Column(None, "customer", "c_name", "varchar", max_length=18)],
        keys=[(None, t, f"pk_{t}", PKS[t]) for t in SHOP],
        foreign_keys=[
            ForeignKey("fk_nr", None, "nation", ("n_regionkey",), None, "region", ("r_regionkey",)),
            ForeignKey("fk_cn", None, "customer", ("c_nationkey",), None, "nation", ("n_nationkey",)),
            ForeignKey("fk_sn", None, "supplier", ("s_nationkey",), None, "nation", ("n_nationkey",)),
            ForeignKey("fk_oc", None, "orders", ("o_custkey",), None, "customer", ("c_custkey",)),
        ],
        source_type=source_type,
    )


def new_target(spark, label: str) -> TableTarget:
    """A database of its own in the scratch folder."""
    name = f"restore_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, label)}'")
    return TableTarget(name)


def counts(spark, target: TableTarget, names) -> object:
    out = None
    for t in names:
        one = row_count(spark.table(target.ident(t))).select(F.lit(t).alias("table"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def register(r: Registry) -> None:
    @r.add("SELECT * FROM lineitem")
    def snapshot_roundtrip_lineitem(spark, d):
        root = scratch_path(spark, "snapshots")
        write_snapshot({"shop.lineitem": table(spark, d, "lineitem")}, Storage("disk", root), "shop", 1)
        return read_snapshot(spark, root, "shop", 1, "shop.lineitem")

    @r.add("SELECT *, row_number() OVER (ORDER BY event_id) AS row_num FROM events")
    def snapshot_numbered_events(spark, d):
        root = scratch_path(spark, "snapshots")
        write_snapshot({"events": table(spark, d, "events")}, Storage("disk", root), "log", 7, PKS)
        return read_numbered(spark, root, "log", 7, "events")

    @r.add("SELECT * FROM documents")
    def snapshot_unordered_documents(spark, d):
        root = scratch_path(spark, "snapshots")
        write_snapshot({"documents": table(spark, d, "documents")}, Storage("disk", root), "text", 1, ordered=False)
        return read_snapshot(spark, root, "text", 1, "documents")

    @r.add("SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_num FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
    def snapshot_page_orders(spark, d):
        root = scratch_path(spark, "snapshots")
        write_snapshot({"orders": table(spark, d, "orders")}, Storage("disk", root), "shop", 1, PKS)
        return read_snapshot_page(spark, root, "shop", 1, "orders", 2, 500)

    @r.add(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count, 'text/x' IS NULL AS has_no_size FROM {t}" for t in TABLES))
    def snapshot_all_tables(spark, d):
        root = scratch_path(spark, "snapshots")
        storage = Storage("disk", root)
        write_snapshot({t: table(spark, d, t) for t in TABLES}, storage, "all", 1, PKS, {"flow": "nightly"})
        sizes = read_manifest(spark, root).filter("tags['flow'] = 'nightly'").select(F.col("name").alias("table"), (F.col("size") <= 0).alias("has_no_size"))
        out = None
        for name, df in read_version(spark, root, "all", 1).items():
            one = row_count(df).select(F.lit(name).alias("table"), "row_count")
            out = one if out is None else out.unionByName(one)
        return out.join(sizes, "table")

    @r.add("SELECT *, 'cloud,disk' AS storages FROM customer")
    def fanout_customer(spark, d):
        roots = [scratch_path(spark, "disk"), scratch_path(spark, "cloud")]
        targets = [Storage("disk", roots[0]), Storage("cloud", roots[1])]
        rows = write_fanout({"customer": table(spark, d, "customer")}, targets, "shop", 3, PKS)
        merged = merge_manifest(rows, rows.limit(0)).select(F.concat_ws(",", "storages").alias("storages"))
        copy = read_snapshot(spark, roots[1], "shop", 3, "customer")
        return copy.withColumn("storages", F.lit(merged.head()[0]))

    @r.add("SELECT * FROM pages")
    def compressed_pages(spark, d):
        path = scratch_path(spark, "compressed")
        write_compressed(table(spark, d, "pages"), path, "gzip", "json")
        return spark.read.schema(table(spark, d, "pages").schema).json(path)

    @r.add("SELECT * FROM customer")
    def page_json_customer(spark, d):
        path = scratch_path(spark, "json")
        df = table(spark, d, "customer")
        write_page_json(df, path, "customer", ["c_custkey"], size=200, rows_per_line=64)
        return read_page_json(spark, path, df.schema)

    @r.add("SELECT * FROM conversations")
    def page_json_conversations(spark, d):
        path = scratch_path(spark, "json")
        df = table(spark, d, "conversations")
        write_page_json(df, path, "conversations", ["conv_id", "turn"], "gzip")
        return read_page_json(spark, path, df.schema)

    @r.add(
        """SELECT 'lineitem' AS "tableName", least(100000, greatest(1000, ceil(count(*) / 10.0)))::BIGINT AS "pageSize",
                  (count(*) // least(100000, greatest(1000, ceil(count(*) / 10.0)))::BIGINT + 1)::BIGINT AS "totalPages", count(*) AS "totalRecords"
           FROM lineitem"""
    )
    def page_json_totals(spark, d):
        path = scratch_path(spark, "json")
        write_page_json(table(spark, d, "lineitem"), path, "lineitem")
        return read_page_totals(spark, path)

    @r.add("SELECT * FROM lineitem")
    def page_json_lineitem(spark, d):
        path = scratch_path(spark, "json")
        df = table(spark, d, "lineitem")
        write_page_json(df, path, "lineitem")
        return read_page_json(spark, path, df.schema)

    @r.add("SELECT * FROM orders")
    def page_json_document_orders(spark, d):
        path = scratch_path(spark, "document")
        df = table(spark, d, "orders")
        write_table_document(df, path, "orders", ["o_orderkey"])
        return read_page_json(spark, path, df.schema, multi_line=True)

    @r.add(
        """SELECT 'pages' AS "table", (row_number() OVER (ORDER BY page_id) - 1) // 40 AS page_num, page_id::VARCHAR AS row_key,
                  md5(concat_ws(chr(10), html, page_id, url)) AS md5 FROM pages"""
    )
    def page_json_document_pages(spark, d):
        path = scratch_path(spark, "document")
        write_table_document(table(spark, d, "pages"), path, "pages", ["page_id"], size=40)
        found = read_pages(spark, path, multi_line=True)
        return found.select("table", "page_num", "row_key", F.md5(F.array_join("cells", "\n")).alias("md5"))

    @r.add("SELECT * FROM orders")
    def backup_folder_orders(spark, d):
        folder = scratch_path(spark, "folder")
        dfs = {f"shop.{t}": table(spark, d, t) for t in ("customer", "orders")}
        columns = catalog_columns(spark, {t.split(".")[1]: df for t, df in dfs.items()}, "shop")
        keys = [("shop", t, f"pk_{t}", PKS[t]) for t in ("customer", "orders")]
        write_backup(dfs, Catalog.of(spark, columns=columns, keys=keys), folder)
        return read_backup(spark, folder)[1]["shop.orders"]

    @r.add(
        """SELECT *, 'SUCCESS' AS status, NULL::VARCHAR AS message, row_count AS stored FROM (
           SELECT 'region' AS "table", 0 AS level, count(*) AS row_count FROM region UNION ALL SELECT 'nation', 1, count(*) FROM nation
           UNION ALL SELECT 'customer', 2, count(*) FROM customer UNION ALL SELECT 'supplier', 2, count(*) FROM supplier
           UNION ALL SELECT 'orders', 3, count(*) FROM orders)"""
    )
    def restore_all_shop(spark, d):
        target = new_target(spark, "restore")
        report = restore_all({t: table(spark, d, t) for t in SHOP}, shop_catalog(spark), target)
        return report.join(counts(spark, target, SHOP).withColumnRenamed("row_count", "stored"), "table")

    @r.add(
        """SELECT 'region' AS "table", count(*) AS row_count FROM region UNION ALL SELECT 'nation', count(*) FROM nation
           UNION ALL SELECT 'supplier', 0 UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', 0"""
    )
    def clear_tables_shop(spark, d):
        target = new_target(spark, "clear")
        catalog = shop_catalog(spark)
        restore_all({t: table(spark, d, t) for t in SHOP}, catalog, target)
        clear_tables(target, catalog, ["supplier", "orders"])
        return counts(spark, target, SHOP)

    @r.add("SELECT c_custkey, repeat('*', 18) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def masked_restore_customer(spark, d):
        storage = Storage("disk", scratch_path(spark, "backup"))
        catalog = shop_catalog(spark)
        backup({t: table(spark, d, t) for t in SHOP}, catalog, [storage], "shop", 1)
        target = new_target(spark, "masked")
        masks = [([MaskTarget(None, "customer", "c_name")], Mask("FIXED", "*", 30))]
        masked_restore(spark, storage, "shop", 1, target, masks, log=RunLog(1, "nightly"))
        return spark.table(target.ident("customer"))

    @r.add(
        """SELECT 2::BIGINT AS version, 'customer' AS "table", 0 AS row_count UNION ALL SELECT 2, 'orders', count(*) FROM orders"""
    )
    def clear_and_delete_version(spark, d):
        storage = Storage("disk", scratch_path(spark, "versions"))
        write_snapshot({t: table(spark, d, t) for t in ("customer", "orders")}, storage, "shop", 1, PKS)
        clear_version(spark, storage, "shop", 1, ["customer"])
        delete_version(spark, storage, "shop", 1)
        left = read_manifest(spark, storage.root).select("version", F.col("name").alias("table"))
        sizes = None
        for name, df in read_version(spark, storage.root, "shop", 2).items():
            one = row_count(df).select(F.lit(name).alias("table"), "row_count")
            sizes = one if sizes is None else sizes.unionByName(one)
        return left.join(sizes, "table").select("version", "table", "row_count")

    @r.add("""SELECT 'customer' AS "table", count(*) AS row_count FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
    def drop_tables_shop(spark, d):
        target = new_target(spark, "drop")
        catalog = shop_catalog(spark)
        restore_all({t: table(spark, d, t) for t in SHOP}, catalog, target)
        left = drop_tables(target, catalog, ["orders", "supplier"])
        present = [t.name for t in spark.catalog.listTables(target.namespace)]
        names = [r["table"] for r in left.tables.orderBy("table").collect()]
        if sorted(present) != names:
            raise AssertionError(f"{present} is not {names}")
        return counts(spark, target, names)
