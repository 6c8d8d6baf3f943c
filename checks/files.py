"""Digests, file listings and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from checks import Registry, table
from snapforge.functions.checksums import checksum_md5, checksum_sha256
from snapforge.session import scratch_path
from snapforge.sources.files import changed_files, expand_archive_parts, expand_archives, file_checksums, file_inventory, read_archives, write_file

_PACKED_BYTES = 4 << 20


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One zip per document, with its text and its language; they leave the task in batches of bounded size."""
    for batch in batches:
        paths, packed, size = [], [], 0
        for i in range(batch.num_rows):
            doc_id, text, lang = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "lang"))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{doc_id}.txt", text)
                z.writestr(f"{doc_id}.lang.json", lang)
            paths.append(f"{doc_id}.zip")
            packed.append(buffer.getvalue())
            size += len(packed[-1])
            if size >= _PACKED_BYTES or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(packed, pa.binary())], ["path", "content"])
                paths, packed, size = [], [], 0


def _archive_files(spark, d: str) -> str:
    """A folder with zip files of many documents each; entries are stored, deflated and packed with bzip2."""
    folder = scratch_path(spark, "archives")
    kinds = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                for row in batch.itertuples():
                    z.writestr(f"{row.doc_id}.txt", row.text, kinds[row.doc_id % 3])
            name = f"{folder}/{batch['doc_id'].min()}.zip"
            write_file(name, buffer.getvalue())
            yield pd.DataFrame({"path": [name]})

    table(spark, d, "documents").select("doc_id", "text").mapInPandas(write, "path string").count()
    return folder


def _page_files(spark, d: str) -> str:
    """A folder with one text file per page, in a folder of its own; each text ends with a line feed.

    The tasks write the files: Spark's writer would move every file once more when it commits, one after the other.
    """
    folder = scratch_path(spark, "pages")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        for page, texts in groupby(rows, key=lambda row: row.page):
            write_file(f"{folder}/page_id={page}/part-00000.txt", b"".join((row.html or "").encode() + b"\n" for row in texts))
            yield pd.DataFrame({"page": [page]})

    page = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("page")
    pages = table(spark, d, "pages").select(page, "html").repartition("page").sortWithinPartitions("page")
    pages.mapInPandas(write, "page string").count()
    return folder


def _page_id():
    return F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("bigint").alias("page_id")


def register(r: Registry) -> None:
    @r.add("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
    def doc_checksums(spark, d):
        text = F.encode("text", "UTF-8")
        return table(spark, d, "documents").select(
            "doc_id", checksum_md5(text).alias("md5"), checksum_sha256(text).alias("sha256")
        )

    @r.add(
        """SELECT url AS path, md5(html) AS checksum FROM pages
           WHERE length(html) > 2000 OR url LIKE '%page%'"""
    )
    def changed_pages(spark, d):
        pages = table(spark, d, "pages")
        now = pages.select(F.col("url").alias("path"), F.md5("html").alias("checksum"))
        # Before, long pages had another content, and some pages were not known.
        past = pages.filter("url not like '%page%'").select(
            F.col("url").alias("path"),
            F.md5(F.when(F.length("html") > 2000, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("checksum"),
        )
        return changed_files(now, past)

    @r.add("SELECT page_id, octet_length(encode(html)) + 1 AS length, 'text/plain' AS content_type, true AS named FROM pages")
    def file_inventory_pages(spark, d):
        found = file_inventory(spark, _page_files(spark, d))
        return found.select(_page_id(), "length", "content_type", F.col("name").startswith("part-").alias("named"))

    @r.add("SELECT page_id, octet_length(encode(html)) + 1 AS length, sha256(html || chr(10)) AS sha256 FROM pages")
    def file_checksums_pages(spark, d):
        found = file_checksums(spark, _page_files(spark, d), "sha256")
        return found.select(_page_id(), "length", F.col("checksum").alias("sha256"))

    @r.add("SELECT concat(doc_id, '.txt') AS name, 'text/plain' AS content_type, octet_length(encode(text))::BIGINT AS size, md5(text) AS md5 FROM documents")
    def read_archives_documents(spark, d):
        found = read_archives(spark, _archive_files(spark, d))
        return found.select("name", "content_type", "size", F.md5("content").alias("md5"))

    @r.add(
        """SELECT concat(doc_id, '.txt') AS name, octet_length(encode(text))::BIGINT AS size,
                  greatest(1, (octet_length(encode(text)) + 999) // 1000)::BIGINT AS parts, md5(text) AS md5 FROM documents"""
    )
    def expand_archive_parts_documents(spark, d):
        files = spark.read.format("binaryFile").load(_archive_files(spark, d)).select("path")
        parts = expand_archive_parts(files, 1_000).groupBy("name", "size").agg(
            F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part", F.hex("content").alias("x")))).alias("all")
        )
        return parts.select("name", "size", "parts", F.md5(F.unhex(F.array_join("all.x", ""))).alias("md5"))

    @r.add(
        """SELECT concat(doc_id, '.zip') AS path, concat(doc_id, '.txt') AS name, 'text/plain' AS content_type,
                  octet_length(encode(text))::BIGINT AS size, md5(text) AS md5 FROM documents
           UNION ALL SELECT concat(doc_id, '.zip'), concat(doc_id, '.lang.json'), 'application/json', octet_length(encode(lang))::BIGINT, md5(lang) FROM documents"""
    )
    def expand_archives_documents(spark, d):
        packed = table(spark, d, "documents").select("doc_id", "text", "lang").mapInArrow(_pack, "path string, content binary")
        return expand_archives(packed).select("path", "name", "content_type", "size", F.md5("content").alias("md5"))
