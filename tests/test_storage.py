"""Snapshots, manifest, retention, restore, files, run log, streaming."""

import hashlib
import io
import os
import threading
import zipfile
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import files as checked_files
from checks.storage import PKS, SHOP, new_target, shop_catalog
from snapforge.catalog import Catalog, ForeignKey
from snapforge.operators.manifest import (
    MANIFEST,
    RUN_LOG,
    assert_capacity,
    latest_version,
    merge_manifest,
    retention_select,
    run_summary,
    tag_filter,
)
from snapforge.operators.masking import Mask
from snapforge.plans.flows import RunLog
from snapforge.session import create_exclusive, local_frame, partitions_for_bytes, range_partitions, scratch_path
from snapforge.sinks.restore import JdbcTarget, RestoreError, TableTarget, clear_tables, drop_tables, missing_tables, restore_all, restore_table
from snapforge.sinks.snapshots import Storage, apply_retention, delete_version, write_fanout, write_snapshot
from snapforge.sources import files as files_module
from snapforge.sources.files import changed_files, expand_archive_parts, expand_archives, file_checksums, file_inventory, read_archives
from snapforge.sources.snapshots import claim_path, read_manifest, read_numbered, read_snapshot, read_snapshot_page, read_version
from snapforge.sources.tables import JdbcSource, aggregate_query, catalog_from_views, hash_predicates, keyset_predicates, keyset_query, parquet_facts, sorted_bounds, split_options
from snapforge.streaming import check_violations, length_violations, mask_table


def test_versions(spark, root):
    disk = Storage("disk", root)
    df = spark.range(2_500).withColumn("v", F.col("id") * 2)
    write_snapshot({"t": df}, disk, "d", 1, {"t": ["id"]}, {"env": "test"})
    with pytest.raises(FileExistsError):
        write_snapshot({"t": df}, disk, "d", 1)
    write_snapshot({"t": df.limit(10)}, disk, "d", 2)
    assert read_snapshot(spark, root, "d", 1, "t").columns == ["id", "v"]
    page = read_snapshot_page(spark, root, "d", 1, "t", 2, 1_000)
    assert sorted(r["id"] for r in page.collect()) == list(range(2_000, 2_500))
    entry = tag_filter(read_manifest(spark, root), {"env": "test"}).collect()
    assert [(r["version"], r["name"], r["storages"]) for r in entry] == [(1, "t", ["disk"])] and entry[0]["size"] > 0
    assert latest_version(read_manifest(spark, root)).head()["version"] == 2
    assert delete_version(spark, disk, "d", 1) and not delete_version(spark, disk, "d", 1)
    with pytest.raises(ValueError):
        read_version(spark, root, "d", 1)
    assert set(read_version(spark, root, "d", 2)) == {"t"}


def test_page_read_is_a_range_filter_on_the_scan(spark, root):
    write_snapshot({"t": spark.range(5_000)}, Storage("disk", root), "d", 1, {"t": ["id"]})
    plan = read_snapshot_page(spark, root, "d", 1, "t", 1, 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_seq" in plan and "LessThanOrEqual(_seq" in plan
    assert "SortMergeJoin" not in plan


def test_unordered_snapshot_has_no_shuffle_and_whole_pages(spark, root):
    df = spark.range(2_000).select((F.col("id") * 7 % 2_000).alias("id"))
    write_snapshot({"t": df}, Storage("disk", root), "d", 1, {"t": ["id"]}, ordered=False)
    pages = [[r["id"] for r in read_snapshot_page(spark, root, "d", 1, "t", p, 900).collect()] for p in range(3)]
    assert [len(p) for p in pages] == [900, 900, 200]
    assert sorted(sum(pages, [])) == list(range(2_000))


def test_a_full_storage_is_refused_before_tables_are_computed(spark, root):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(500).mapInPandas(count, "id long")
    held = write_snapshot({"t": df}, Storage("disk", root), "d", 1).agg(F.sum("size")).head()[0]
    before = seen.value
    with pytest.raises(ValueError, match="not enough capacity: 0 free"):
        write_snapshot({"t": df}, Storage("disk", root, capacity=held), "d", 2)
    assert seen.value == before and not os.path.exists(f"{root}/data=d/version=2")
    # There is room for some tables, but not for all: those after the first one too many are not written.
    dfs = {f"t{i}": df for i in range(40)}
    with pytest.raises(ValueError, match="not enough capacity"):
        write_snapshot(dfs, Storage("disk", root, capacity=held + held // 2), "d", 2)
    assert seen.value - before < 40 * 500
    assert write_snapshot({"t": df}, Storage("disk", root, capacity=3 * held), "d", 2).count() == 1


def test_copies_are_refused_before_anything_is_copied(spark, root, tmp_path):
    small = Storage("small", str(tmp_path / "small"), capacity=200)
    with pytest.raises(ValueError, match="not enough capacity: 200 free"):
        write_fanout({"t": spark.range(100)}, [Storage("disk", root), small], "d", 1)
    assert read_manifest(spark, root).count() == 1 and not os.path.exists(f"{small.root}/data=d/version=1")


def test_snapshot_refusals(spark, root):
    with pytest.raises(ValueError, match="nothing"):
        write_snapshot({}, Storage("disk", root), "d", 1)
    with pytest.raises(PermissionError):
        write_snapshot({"t": spark.range(1)}, Storage("disk", root, read_only=True), "d", 1)
    with pytest.raises(ValueError, match="folder name"):
        write_snapshot({"a/b": spark.range(1)}, Storage("disk", root), "d", 1)
    with pytest.raises(ValueError, match="capacity"):
        write_snapshot({"t": spark.range(1)}, Storage("disk", root, capacity=10), "d", 1)
    assert read_manifest(spark, root).isEmpty()
    with pytest.raises(ValueError, match="free"):
        assert_capacity(local_frame(spark, [], MANIFEST), 5, 6)


def test_fanout_records_only_what_it_should(spark, root):
    a, b = Storage("a", f"{root}/a", record=False), Storage("b", f"{root}/b")
    rows = write_fanout({"t": spark.range(100)}, [a, b], "d", 1, {"t": ["id"]})
    assert [r["storages"] for r in rows.collect()] == [["b"]]
    assert read_manifest(spark, a.root).isEmpty() and read_manifest(spark, b.root).count() == 1
    for s in (a, b):
        assert read_snapshot_page(spark, s.root, "d", 1, "t", 3, 30).count() == 10


def entry(name, storages, size=1, when=1, version=1):
    return ("d", version, name, "dir", "t", size, storages, {"k": name}, datetime(2024, 1, when))


def test_merge_manifest(spark):
    old = local_frame(spark, [entry("a", ["x"], 5), entry("b", None)], MANIFEST)
    new = local_frame(spark, [entry("a", ["y", "x"], 9), entry("c", ["z"])], MANIFEST)
    got = {r["name"]: (r["size"], r["storages"], r["tags"]) for r in merge_manifest(old, new).collect()}
    assert got == {"a": (5, ["x", "y"], {"k": "a"}), "b": (1, [], {"k": "b"}), "c": (1, ["z"], {"k": "c"})}


def test_retention_keeps_the_newest(spark):
    m = local_frame(spark, [entry("f", ["x"], 100, v, v) for v in range(1, 6)], MANIFEST)

    def removed(**limits):
        return sorted(r["version"] for r in retention_select(m, **limits).collect())

    assert removed(count_limit=2) == [1, 2, 3]
    assert removed(size_limit=250) == [1, 2, 3]
    assert removed(size_limit=10) == [1, 2, 3, 4]
    assert removed() == []


def test_apply_retention(spark, root):
    disk = Storage("disk", root)
    for version in (1, 2, 3):
        write_snapshot({"t": spark.range(version)}, disk, "d", version)
    assert apply_retention(spark, disk, count_limit=2) == [("d", 1)]
    assert sorted(r["version"] for r in read_manifest(spark, root).collect()) == [2, 3]
    assert read_snapshot(spark, root, "d", 3, "t").count() == 3


def test_run_log(spark):
    log = RunLog(4, "nightly")
    with pytest.raises(RuntimeError, match="broken"):
        log.run([("From", lambda: 1), ("MaskColumns", lambda: (_ for _ in ()).throw(RuntimeError("broken"))), ("To", lambda: 2)])
    assert [r["status"] for r in log.frame(spark).orderBy("step").collect()] == ["SUCCESS", "FAILED", "SKIPPED"]
    run = run_summary(log.frame(spark)).head()
    assert (run["status"], run["completed_steps"], run["number_of_steps"]) == ("FAILED", 1, 3)
    assert set(log.tags()) == {"date", "time", "flow"}
    now = datetime(2024, 1, 1)
    still = local_frame(spark, [(1, "f", 0, "x", "SUCCESS", now, now), (1, "f", 1, "y", "RUNNING", now, None)], RUN_LOG)
    assert run_summary(still).head()["status"] == "RUNNING" and run_summary(still).head()["duration_seconds"] is None


def test_restore_refusals(spark):
    tables = {t: spark.range(1) for t in SHOP}
    with pytest.raises(ValueError, match="cannot restore"):
        restore_all(tables, shop_catalog(spark, "MYSQL"), TableTarget("x", "POSTGRES"))
    with pytest.raises(PermissionError):
        restore_all(tables, shop_catalog(spark), TableTarget("x", read_only=True))
    for change in (clear_tables, drop_tables):
        with pytest.raises(PermissionError):
            change(TableTarget("x", read_only=True), shop_catalog(spark))
    with pytest.raises(PermissionError):
        restore_table(spark.range(1), JdbcTarget(JdbcSource("jdbc:x", "MYSQL", read_only=True)), "t")
    with pytest.raises(ValueError, match="no data"):
        restore_all({}, shop_catalog(spark), TableTarget("x"))


def test_restore_stops_after_a_failure(spark):
    target = new_target(spark, "failing")
    tables = {t: spark.range(3) for t in SHOP}
    tables["customer"] = spark.range(3).select(F.raise_error(F.lit("bad row")).cast("int").alias("x"))
    renamed = []
    with pytest.raises(RestoreError, match="customer") as e:
        restore_all(tables, shop_catalog(spark), target, processors=(lambda c: renamed.append(1) or c,))
    status = {r[0]: r[2] for r in e.value.report}
    assert status == {"region": "SUCCESS", "nation": "SUCCESS", "customer": "FAILED", "supplier": "SUCCESS", "orders": "SKIPPED"}
    assert renamed == [1]


def test_restore_appends_by_column_name(spark):
    target = new_target(spark, "append")
    assert restore_table(local_frame(spark, [(1, "a")], "id int, v string"), target, "t") == 1
    assert restore_table(local_frame(spark, [("b", 2)], "v string, id int"), target, "t") == 1
    assert sorted(map(tuple, spark.table(target.ident("t")).collect())) == [(1, "a"), (2, "b")]


class Doubling(TableTarget):
    """A target whose append was run twice, as after a task lost past its commit."""

    def count(self, spark, table):
        return spark.table(self.ident(table)).count() if spark.catalog.tableExists(self.ident(table)) else 0

    def append(self, df, table):
        super().append(df, table)
        super().append(df.filter("id = 1"), table)


def test_restore_notices_rows_inserted_twice(spark):
    target = Doubling(new_target(spark, "doubling").namespace)
    with pytest.raises(RuntimeError, match="grew by 4 rows instead of 3"):
        restore_table(spark.range(3), target, "t")


def test_drop_all_takes_the_sequences(spark):
    catalog = shop_catalog(spark).with_frames(sequences=local_frame(spark, [(None, "s", 1, 1, 9, 1, False, 1, 0)], "schema string, name string, start_value bigint, min_value bigint, max_value bigint, increment_by bigint, cycle boolean, cache_size bigint, last_value bigint"))
    target = new_target(spark, "dropall")
    restore_table(spark.range(1), target, "region")
    left = drop_tables(target, catalog)
    assert left.tables.isEmpty() and left.sequences.isEmpty() and left.foreign_keys.isEmpty()
    assert missing_tables(catalog, left) == sorted(SHOP)
    assert spark.catalog.listTables(target.namespace) == []
    assert sorted(PKS) != []


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("select 1")
    (tmp_path / "sub" / "b.BIN").write_bytes(b"\x00" * 100)
    listing = {r["name"]: (r["length"], r["content_type"]) for r in file_inventory(spark, str(tmp_path)).collect()}
    assert listing == {"a.sql": (8, "text/sql"), "b.BIN": (100, "application/octet-stream")}
    sums = {r["checksum"] for r in file_checksums(spark, str(tmp_path)).collect()}
    assert sums == {hashlib.md5(b"select 1").hexdigest(), hashlib.md5(b"\x00" * 100).hexdigest()}
    with pytest.raises(ValueError):
        file_checksums(spark, str(tmp_path), "crc")
    now = file_checksums(spark, str(tmp_path)).select("path", "checksum")
    assert changed_files(now, now).isEmpty()
    assert changed_files(now, now, only_changed=False).count() == 2
    assert changed_files(now, now.limit(0)).count() == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data-t.json", "{}")
        z.writestr("deep/name.txt", "x" * 1000)
    got = {r["name"]: (r["size"], r["content_type"]) for r in read_archives(spark, str(tmp_path)).collect()}
    assert got == {"data-t.json": (2, "application/json"), "deep/name.txt": (1000, "text/plain")}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.mkdir("folder")
    given = spark.read.format("binaryFile").load(f"{tmp_path}/a.zip")
    assert {r["name"]: (r["size"], r["content_type"]) for r in expand_archives(given).collect()} == got
    with pytest.raises(PySparkException, match="directory entry"):
        read_archives(spark, str(tmp_path)).collect()
    broken = spark.createDataFrame([("c.zip", bytearray(b"no zip"))], "path string, content binary")
    with pytest.raises(PySparkException, match="not a zip"):
        expand_archives(broken).collect()


def test_jdbc_plans(spark):
    date = spark.createDataFrame([], "d date, s string").schema
    assert split_options(date["d"].dataType, "2024-01-01", "2024-02-01", 4, '"d"')["numPartitions"] == "4"
    with pytest.raises(ValueError):
        split_options(date["s"].dataType, 0, 1, 2, "s")
    for vendor in ("POSTGRES", "MYSQL", "SQLSERVER"):
        parts = hash_predicates(vendor, ["a", "b"], 3)
        assert len(parts) == 3 and parts[0].endswith("% 3 = 0")
    assert JdbcSource("jdbc:x", "SQLSERVER").quote_table("dbo.t") == "[dbo].[t]"
    query = aggregate_query(JdbcSource("jdbc:x", "POSTGRES"), "s.t", id='max("id")', n="count(*)")
    assert query == 'select max("id") as "id", count(*) as "n" from "s"."t"'


def test_catalog_from_information_schema(spark):
    columns = local_frame(
        spark,
        [("app", "child", "id", 1, None, "integer", "int4", None, "NO"), ("app", "child", "pid", 2, None, "integer", "int4", "0", "YES"),
         ("app", "child", "pcode", 3, -1, "text", "text", None, "YES"), ("app", "parent", "id", 1, None, "integer", "int4", None, "NO"), ("app", "parent", "code", 2, 20, "varchar", "varchar", None, "NO")],
        "table_schema string, table_name string, column_name string, ordinal_position int, character_maximum_length bigint, data_type string, udt_name string, column_default string, is_nullable string",
    )
    constraints = local_frame(
        spark, [("app", "app", "child", "fk", "FOREIGN KEY"), ("app", "app", "parent", "pk", "PRIMARY KEY"), ("app", "app", "parent", "uk", "UNIQUE")],
        "constraint_schema string, table_schema string, table_name string, constraint_name string, constraint_type string",
    )
    usage = local_frame(
        spark,
        [("app", "app", "child", "fk", "pcode", 2, 2), ("app", "app", "child", "fk", "pid", 1, 1), ("app", "app", "parent", "pk", "id", 1, None),
         ("app", "app", "parent", "uk", "code", 2, None), ("app", "app", "parent", "uk", "id", 1, None)],
        "constraint_schema string, table_schema string, table_name string, constraint_name string, column_name string, ordinal_position int, position_in_unique_constraint int",
    )
    refs = local_frame(spark, [("app", "fk", "app", "uk")], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string")
    catalog = catalog_from_views(spark, columns, constraints, usage, refs, "POSTGRES", ["app"])
    assert catalog.primary_key("app", "parent") == ["id"]
    fk = catalog.foreign_keys.head()
    assert (fk["src_columns"], fk["ref_table"], fk["ref_columns"]) == (["pid", "pcode"], "parent", ["id", "code"])
    facts = {(r["table"], r["name"]): (r["max_length"], r["nullable"]) for r in catalog.columns.collect()}
    assert facts[("child", "pcode")] == (None, True) and facts[("parent", "code")] == (20, False)
    assert catalog.uniques.head()["columns"] == ["id", "code"]


def test_partition_sizing(spark):
    assert partitions_for_bytes(0) == 1
    assert partitions_for_bytes(100 << 40) == 100_000
    assert partitions_for_bytes(1 << 40) == 8_192
    assert range_partitions(spark.range(10)) is None
    assert range_partitions(spark.range(10**9)) > 8


def test_scratch_folder_is_the_named_one(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_catalog_of_rejects_unknown_frames(spark):
    with pytest.raises(ValueError, match="unknown catalog frames"):
        Catalog.of(spark, tabels=[])


def test_streaming(spark, folder, root):
    schema = spark.read.parquet(f"{folder}/customer.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(folder)
    masked = mask_table(check_violations(stream, "c_acctbal >= 0"), {"c_name": 18}, Mask("FIXED", "*", 4), ["c_custkey"])
    lengths = Catalog.of(spark, columns=[]).columns
    assert length_violations(masked, lengths).isStreaming
    query = masked.writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    assert got.count() == spark.read.parquet(f"{folder}/customer.parquet").filter("c_acctbal < 0").count()
    assert {r[0] for r in got.select("c_name").distinct().collect()} == {"****"}


@pytest.mark.parametrize("vendor, text", [("POSTGRES", "'it''s'"), ("MYSQL", "'it''s'"), ("SQLSERVER", "N'it''s'")])
def test_keyset_predicates(vendor, text):
    source = JdbcSource("jdbc:x", vendor)
    a, b = source.quote("a"), source.quote("b")
    parts = keyset_predicates(source, ["a", "b"], [(1, "it's"), (5, "x")])
    low, high = f"({a} > 1 or ({a} = 1 and {b} >= {text}))", f"({a} < 1 or ({a} = 1 and {b} < {text}))"
    assert parts[0] == high and parts[1].startswith(f"{low} and ({a} < 5") and parts[2].startswith(f"({a} > 5 or") and len(parts) == 3
    assert keyset_predicates(source, ["a"], []) == ["1 = 1"]
    assert keyset_predicates(JdbcSource("jdbc:x", "MYSQL"), ["a"], [("\\",)])[0] == "`a` < '\\\\'"


def test_keyset_parts_are_even_whatever_the_keys_are(spark):
    """Skewed, negative and text keys; each row is in one part, and no part has more than one row above its share."""
    rows = [(k, f"v'{i}") for i, k in enumerate([-5] * 40 + [1] * 3 + [10**12] * 30)]
    df = local_frame(spark, rows, "k bigint, v string")
    df.createOrReplaceTempView("keyset_skewed")
    source = JdbcSource("jdbc:none", "MYSQL")
    bounds = sorted_bounds(spark.sql(keyset_query(source, "keyset_skewed", ["k", "v"], 8)), ["k", "v"])
    sizes = [df.filter(p).count() for p in keyset_predicates(source, ["k", "v"], bounds)]
    assert sum(sizes) == 73 and len(sizes) == 8 and max(sizes) <= 10
    spark.sql("SELECT 1L AS k, 'a' AS v WHERE false").createOrReplaceTempView("keyset_empty")
    assert sorted_bounds(spark.sql(keyset_query(source, "keyset_empty", ["k", "v"], 8)), ["k", "v"]) == []
    for view in ("keyset_skewed", "keyset_empty"):  # other tests list the tables of the session
        spark.catalog.dropTempView(view)


def test_two_writers_of_one_version(spark, root):
    """One writes the version, the others are refused and take nothing away."""
    storage = Storage("disk", root)
    gate = threading.Barrier(4)

    def write(n):
        gate.wait()
        try:
            write_snapshot({"t": spark.range(100 + n)}, storage, "d", 1)
            return n
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = [n for n in pool.map(write, range(4)) if n is not None]
    assert len(done) == 1 and read_snapshot(spark, root, "d", 1, "t").count() == 100 + done[0]
    assert read_manifest(spark, root).count() == 1
    with pytest.raises(FileExistsError, match="exists"):
        write_snapshot({"t": spark.range(1)}, storage, "d", 1)
    assert read_version(spark, root, "d", 1)["t"].count() == 100 + done[0]


def test_a_claimed_version_is_not_read(spark, root):
    storage = Storage("disk", root)
    write_snapshot({"t": spark.range(5)}, storage, "d", 1)
    claim = claim_path(root, "d", 1)
    assert create_exclusive(spark, claim, "a writer that has died") and not create_exclusive(spark, claim, "another")
    for read in (read_snapshot, read_numbered):
        with pytest.raises(ValueError, match="not complete"):
            read(spark, root, "d", 1, "t")
    with pytest.raises(FileExistsError, match="being written"):
        write_snapshot({"t": spark.range(1)}, storage, "d", 1)
    assert delete_version(spark, storage, "d", 1)
    write_snapshot({"t": spark.range(7)}, storage, "d", 1)
    assert read_snapshot(spark, root, "d", 1, "t").count() == 7


def test_entries_of_archives(spark, tmp_path):
    """Stored, deflated, bzip2, lzma, empty and long entries; parts joined are the entry; damage is an error."""
    kinds = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    want = {}
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            for i, kind in enumerate(kinds * 3):
                want[f"{n}-{i}"] = (bytes([i, n]) + os.urandom(50)) * (i * 300)
                z.writestr(f"{n}-{i}", want[f"{n}-{i}"], kind)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    assert {r["name"]: bytes(r["content"]) for r in expand_archives(files).collect()} == want
    parts = {}
    for r in expand_archive_parts(files, 1000).collect():
        parts.setdefault(r["name"], {})[r["part"]] = bytes(r["content"])
        assert len(r["content"]) <= 1000 and r["size"] == len(want[r["name"]])
    assert {name: b"".join(p[i] for i in range(len(p))) for name, p in parts.items()} == want
    data = bytearray((tmp_path / "1.zip").read_bytes())
    data[600] ^= 255
    (tmp_path / "1.zip").write_bytes(data)
    with pytest.raises(PySparkException):
        expand_archives(files).collect()
    assert expand_archives(files.limit(0)).count() == 0


def test_given_archives_leave_in_bounded_batches(monkeypatch):
    """small archives share a batch, and long ones do not pile up."""
    monkeypatch.setattr(files_module, "_GIVEN_BYTES", 2_000)
    packed = []
    for i in range(40):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("a.txt", str(i) * 100)
            z.writestr("b.txt", "")
        packed.append(buffer.getvalue())
    given = pa.RecordBatch.from_arrays([pa.array([f"{i}.zip" for i in range(40)]), pa.array(packed)], ["path", "content"])
    out = list(files_module._given_entries(iter([given])))
    assert [r for b in out for r in b.to_pylist()] == [
        {"path": f"{i}.zip", "name": n, "size": len(x), "content": x.encode()} for i in range(40) for n, x in (("a.txt", str(i) * 100), ("b.txt", ""))
    ]
    assert len(out) < 10 and all(sum(r["size"] for r in b.to_pylist()) < 2_200 for b in out)


def test_page_files_are_written_by_tasks(spark, tmp_path):
    """one file per page, written in place; equal keys share a file, a null text is an empty line."""
    rows = [(1, "u", "<p>é</p>"), (2, "u", "x"), (2, "u", "x"), (3, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    folder = checked_files._page_files(spark, str(tmp_path))
    found = {r["path"].split("/")[-2]: (r["name"], r["length"]) for r in file_inventory(spark, folder).collect()}
    assert found == {"page_id=1": ("part-00000.txt", 10), "page_id=2": ("part-00000.txt", 4), "page_id=3": ("part-00000.txt", 1)}
    sums = {r["checksum"] for r in file_checksums(spark, folder).collect()}
    assert sums == {hashlib.md5(x).hexdigest() for x in ("<p>é</p>\n".encode(), b"x\nx\n", b"\n")}


def test_restore_waits_for_parents_only(spark):
    """A table starts when its own parents are loaded, while a slow table of an earlier level still loads."""

    class Slow:
        read_only, source_type, name, order = False, None, "slow", []
        leaf = threading.Event()

        def append(self, df, table):
            if table == "slow":
                assert self.leaf.wait(60)
            df.write.format("noop").mode("overwrite").save()
            self.order.append(table)
            if table == "leaf":
                self.leaf.set()

    catalog = Catalog.of(
        spark, tables=[(None, t) for t in ("slow", "root", "leaf", "last")],
        foreign_keys=[ForeignKey("a", None, "leaf", ("x",), None, "root", ("x",)), ForeignKey("b", None, "last", ("x",), None, "slow", ("x",)), ForeignKey("c", None, "last", ("x",), None, "leaf", ("x",))],
    )
    target = Slow()
    report = restore_all({t: spark.range(3) for t in ("slow", "root", "leaf", "last")}, catalog, target)
    assert target.order == ["root", "leaf", "slow", "last"] and {r["status"] for r in report.collect()} == {"SUCCESS"}


def test_facts_of_parquet_footers(spark, root):
    spark.range(1000).selectExpr("id", "nullif(id, 999) AS v", "cast(id AS string) AS s").write.parquet(root)
    facts = parquet_facts(spark, root, ["id", "v", "s"])
    assert facts.columns == ["row_count", "id", "v", "s"] and tuple(facts.head()) == (1000, 999, 998, "999")
    assert tuple(parquet_facts(spark, root).head()) == (1000,)
