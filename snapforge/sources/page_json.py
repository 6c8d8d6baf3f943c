"""The JSON interchange form of a table: pages of rows, each a key with its list of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapforge.functions.codecs import DATETIME_FORMAT, decode_cells, encode_cells, row_key
from snapforge.operators.paging import DEFAULT_BATCH, page_number, page_size
from snapforge.session import MAX_PARTITIONS, delete_path, path_exists, scratch_path
from snapforge.sources.files import join_files, list_files
from snapforge.sources.page_documents import read_document_pages, read_document_totals

# Fixed value: shape of the interchange document.
PAGE_SCHEMA = (
    "tableName string, pageSize bigint, totalPages bigint, totalRecords bigint, "
    "dataPages array<struct<pageNum: bigint, data: map<string, array<string>>, size: bigint>>"
)
ROWS_PER_LINE = 1_000
# Bytes of a document that one task sorts, and rows whose width tells how many tasks that takes.
DOCUMENT_PART = 64 << 20
SAMPLE_ROWS = 10_000
# Endings of files that are read from their start only.
COMPRESSED = ("gz", "bz2", "zst", "lz4", "snappy", "deflate", "xz")


def _paged(df: DataFrame, pk: list[str] | None, size: int | None, batch: int) -> tuple[DataFrame, int, int]:
    """The numbered rows, their count, and the page size."""
    paged = page_number(df, pk, size, batch=batch)
    # The page size is given or follows from the number of the last row.
    rows = paged.agg(F.max("row_num").alias("_rows")).head()["_rows"] or 0
    if size is None:
        size = df.sparkSession.range(1).select(page_size(F.lit(rows), batch)).head()[0]
    return paged, rows, size


def page_documents(
    df: DataFrame,
    table: str,
    pk: list[str] | None = None,
    size: int | None = None,
    batch: int = DEFAULT_BATCH,
    datetime_format: str = DATETIME_FORMAT,
    rows_per_line: int = ROWS_PER_LINE,
) -> DataFrame:
    """Lines of JSON (column ``value``) that hold the table.

    Every line is a document of the form above with one page or a part of one: a line has at most
    ``rows_per_line`` rows, so no row of the result grows with the table or with the page size.
    Lines of one page share its ``pageNum``. Two rows with the same key in one line are an error,
    a table with such rows has no key (``pk=None``).
    """
    paged, rows, size = _paged(df, pk, size, batch)
    key = row_key(pk) if pk else F.col("row_num").cast("string")
    lined = paged.select(
        "page_num",
        F.expr(f"((row_num - 1) % {size}L) div {rows_per_line}L").alias("_line"),
        key.alias("_key"),
        encode_cells(df.schema, datetime_format).alias("_cells"),
    )
    data = F.map_from_entries(F.collect_list(F.struct("_key", "_cells")))
    lines = lined.groupBy("page_num", "_line").agg(data.alias("data"), F.count(F.lit(1)).alias("size"))
    document = F.struct(
        F.lit(table).alias("tableName"),
        F.lit(size).alias("pageSize"),
        F.lit(rows // size + 1).alias("totalPages"),
        F.lit(rows).alias("totalRecords"),
        F.array(F.struct(F.col("page_num").alias("pageNum"), "data", "size")).alias("dataPages"),
    )
    return lines.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def write_page_json(df: DataFrame, path: str, table: str, pk: list[str] | None = None, compression: str | None = None, **options) -> None:
    """Write the interchange form as text files, one document per line."""
    writer = page_documents(df, table, pk, **options).write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_table_document(
    df: DataFrame, path: str, table: str, pk: list[str] | None = None, size: int | None = None,
    batch: int = DEFAULT_BATCH, datetime_format: str = DATETIME_FORMAT,
) -> None:
    """Write the table as one document in one file, a row a line, each page once and in order.

    Ranges of row numbers of about ``DOCUMENT_PART`` bytes are sorted by a task each; their files, in this order, are the
    document, see ``join_files``. Two rows of a page with the same key are not refused here.
    """
    paged, rows, size = _paged(df, pk, size, batch)
    pages = rows // size + 1
    facts = F.to_json(F.struct(F.lit(table).alias("tableName"), F.lit(size).alias("pageSize"), F.lit(pages).alias("totalPages"), F.lit(rows).alias("totalRecords")))
    head = F.concat(F.regexp_replace(facts, r"\}$", ""), F.lit(',"dataPages":['))
    open_page = lambda n: F.concat(F.lit('{"pageNum":'), n.cast("string"), F.lit(',"data":{'))
    close_page = lambda n: F.concat(F.lit('},"size":'), n.cast("string"), F.lit("}"))
    nothing, last_page = F.lit(""), F.lit(pages - 1)
    if not rows:
        empty = df.sparkSession.range(1).select(F.concat(head, open_page(last_page), close_page(F.lit(0)), F.lit("]}")).alias("value"))
        empty.coalesce(1).write.mode("errorifexists").text(path)
        return
    number, key = F.col("row_num"), row_key(pk) if pk else F.col("row_num").cast("string")
    place = (number - 1) % size
    before = F.when(number == 1, F.concat(head, open_page(F.lit(0)))).when(place == 0, F.concat(F.lit(","), open_page(F.col("page_num")))).otherwise(F.lit(","))
    # The page behind a full last one is there, without rows.
    rest = F.concat(F.lit(","), open_page(last_page), close_page(F.lit(0))) if rows % size == 0 else nothing
    ends = (number == rows) | (place == size - 1)
    after = F.concat(F.when(ends, close_page(place + 1)).otherwise(nothing), F.when(number == rows, F.concat(rest, F.lit("]}"))).otherwise(nothing))
    pair = F.to_json(F.create_map(key, encode_cells(df.schema, datetime_format)), {"ignoreNullFields": "false"})
    line = F.concat(before, F.expr("substring(_pair, 2, length(_pair) - 2)"), after)
    lines = paged.withColumn("_pair", pair).select("row_num", line.alias("value"))
    width = lines.sample(min(1.0, SAMPLE_ROWS / rows), 11).agg(F.avg(F.octet_length("value"))).head()[0] or 0
    parts = max(1, min(rows, MAX_PARTITIONS, int(width * rows) // DOCUMENT_PART))
    place = F.expr(f"cast((row_num - 1) * {parts}L div {rows}L as int)")
    ordered = lines.repartitionById(parts, place).sortWithinPartitions("row_num").select("value")
    if parts == 1:
        ordered.write.mode("errorifexists").text(path)
        return
    if path_exists(df.sparkSession, path):
        raise FileExistsError(f"{path} exists")
    folder = scratch_path(df.sparkSession, "document")
    ordered.write.text(folder)
    join_files(df.sparkSession, folder, f"{path}/part-00000.txt")
    delete_path(df.sparkSession, folder)


def _compressed(spark: SparkSession, path: str) -> bool:
    return not list_files(spark, path).filter(F.lower(F.substring_index("path", ".", -1)).isin(*COMPRESSED)).isEmpty()


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of the interchange form: table, page_num, row_key, cells.

    Reads lines written by ``write_page_json``, and with ``multi_line`` whole-table documents of any length, in
    chunks (compressed ones, which cannot be cut, by one task each).
    """
    if multi_line and not _compressed(spark, path):
        return read_document_pages(spark, path)
    docs = spark.read.schema(PAGE_SCHEMA).option("multiLine", str(multi_line).lower()).option("mode", "FAILFAST").json(path)
    pages = docs.select(F.col("tableName").alias("table"), F.explode("dataPages").alias("p"))
    return pages.select("table", F.col("p.pageNum").alias("page_num"), F.explode("p.data").alias("row_key", "cells"))


def read_page_json(
    spark: SparkSession, path: str, schema: T.StructType, datetime_format: str = DATETIME_FORMAT, multi_line: bool = False
) -> DataFrame:
    """The rows of a table with the declared types; cells are taken by position."""
    return decode_cells(read_pages(spark, path, multi_line), "cells", schema, datetime_format)


def read_page_totals(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """tableName, pageSize, totalPages, totalRecords as recorded in the documents."""
    if multi_line and not _compressed(spark, path):
        return read_document_totals(spark, path)
    docs = spark.read.schema(PAGE_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    return docs.select("tableName", "pageSize", "totalPages", "totalRecords").distinct()
