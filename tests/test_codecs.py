"""Cells, row keys, page JSON."""

import json
import os
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snapforge.functions.codecs import decode_cells, encode_cells, row_key
from snapforge.functions.types import spark_type
from snapforge.session import local_frame
from snapforge.sources import page_json
from snapforge.sources.page_documents import read_document_pages, read_document_totals, scan
from snapforge.sources.page_json import page_documents, read_page_json, read_page_totals, read_pages, write_page_json, write_table_document

ALL_TYPES = (
    "z string, a int, b bigint, c double, d decimal(12,3), e boolean, f date, g timestamp_ntz, h binary, "
    "i array<string>, j smallint, k float, l timestamp"
)
ROWS = [
    ("é😀|-|\"x\"\n", -1, 2**60, 0.1, Decimal("12.500"), True, date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5, 678000), b"\x00\xff", ["a", None, ""], 7, 1.5, datetime(2020, 5, 6, 7, 8, 9)),
    (None,) * 13,
    ("", 0, 0, -0.0, Decimal("0.000"), False, date(1970, 1, 1), datetime(1969, 12, 31, 23, 59, 59), b"", [], 0, 0.0, datetime(1999, 1, 1)),
]


def test_cells_roundtrip(spark):
    df = spark.createDataFrame(ROWS, ALL_TYPES)
    cells = df.select(encode_cells(df.schema).alias("cells"))
    back = decode_cells(cells, "cells", df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_cells_are_in_name_order(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), b"hi", 3)], "z date, m binary, a int")
    assert df.select(encode_cells(df.schema)).head()[0] == ["3", "aGk=", "2024-01-02"]


def test_interval_is_milliseconds(spark):
    df = spark.createDataFrame([(timedelta(days=1, seconds=2, milliseconds=3),)], "d interval day to second")
    cells = df.select(encode_cells(df.schema).alias("cells"))
    assert cells.head()[0] == ["86402003"]
    assert decode_cells(cells, "cells", df.schema).head()[0] == timedelta(days=1, seconds=2, milliseconds=3)


def test_row_key(spark):
    df = local_frame(spark, [(1, "x"), (2, None)], "b int, a string")
    assert [r[0] for r in df.orderBy("b").select(row_key(["b", "a"])).collect()] == ["x|-|1", None]
    assert df.orderBy("b").select(row_key(["b"])).head()[0] == "1"
    with pytest.raises(ValueError):
        row_key([])


def test_page_json_of_all_types(spark, root):
    df = spark.createDataFrame(ROWS, ALL_TYPES)
    write_page_json(df, root, "t")
    assert sorted(map(str, read_page_json(spark, root, df.schema).collect())) == sorted(map(str, df.collect()))
    keys = sorted(r["row_key"] for r in read_pages(spark, root).collect())
    assert keys == ["1", "2", "3"]


def test_page_json_lines_are_bounded(spark):
    docs = page_documents(spark.range(95), "t", ["id"], size=40, rows_per_line=15)
    sizes = docs.select(F.from_json("value", "totalPages int, totalRecords int, dataPages array<struct<pageNum:int,size:int>>").alias("d")).select("d.*").collect()
    assert {(r["totalPages"], r["totalRecords"]) for r in sizes} == {(3, 95)}
    per_page = {}
    for r in sizes:
        (page,) = r["dataPages"]
        assert page["size"] <= 15
        per_page[page["pageNum"]] = per_page.get(page["pageNum"], 0) + page["size"]
    assert per_page == {0: 40, 1: 40, 2: 15}


def test_page_json_refuses_equal_keys(spark, root):
    df = local_frame(spark, [(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException, match="DUPLICATED_MAP_KEY"):
        write_page_json(df, root, "t", ["k"])


def test_whole_table_document(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        """{"tableName": "t", "pageSize": 2, "totalPages": 2, "totalRecords": 3, "dataPages": [
           {"pageNum": 0, "data": {"1": [1, "a", 1.50], "2": [2, null, 3]}, "size": 2},
           {"pageNum": 1, "data": {"3": [3, "c", null]}, "size": 1}]}"""
    )
    schema = spark.createDataFrame([], "a int, b string, c decimal(5,2)").schema
    got = sorted(map(tuple, read_page_json(spark, str(tmp_path), schema, multi_line=True).collect()))
    assert got == [(1, "a", Decimal("1.50")), (2, None, Decimal("3.00")), (3, "c", None)]


NASTY = [
    {"size": 3, "data": {'a"{[': ["\\\\", '"', None, "}]"], "\\": ["é中🎉" * 40], "k\n": ["x" * 900, "\\\"" * 30]}, "pageNum": 0, "note": {"k": ["not a row"], "l": "text"}},
    {"pageNum": 1, "extra": [[1, {"deep": {"er": ["no"]}}]], "data": {}, "size": 0},
    {"pageNum": 2, "data": None, "size": 0},
    {"pageNum": 7, "data": {"1": [1, 2.5, True, None, "x"], "2": []}, "size": 2},
]


@pytest.mark.parametrize("chunk", [5, 64, 333, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_whole_documents_in_chunks(spark, tmp_path, chunk, indent):
    """Chunks that start anywhere: in strings, behind backslashes, inside characters; properties in any order."""
    doc = {"dataPages": NASTY, "tableName": 's.t"', "pageSize": 3, "totalPages": 4, "totalRecords": 5, "more": {"dataPages": [{"data": {"z": ["no"]}}]}}
    other = {"tableName": "u", "pageSize": 1, "totalPages": 1, "totalRecords": 0, "dataPages": []}
    if chunk == 5:
        NASTY_ = [{**NASTY[0], "data": {'a"{[': NASTY[0]["data"]['a"{[']}}]
        doc = {**doc, "dataPages": NASTY_}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + "\n " + json.dumps(other), encoding="utf-8")
    (tmp_path / "b.json").write_text("")
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    want = sorted(('s.t"', p["pageNum"], k, tuple(map(text, v))) for p in doc["dataPages"] for k, v in (p["data"] or {}).items())
    got = read_document_pages(spark, str(tmp_path), chunk).collect()
    assert sorted((r.table, r.page_num, r.row_key, tuple(r.cells)) for r in got) == want
    if chunk > 64:
        assert sorted(map(tuple, read_document_totals(spark, str(tmp_path), chunk).collect())) == [('s.t"', 3, 4, 5), ("u", 1, 1, 0)]


def test_broken_documents_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tableName": "t", "dataPages": [{"pageNum": 0, "data": {"1": ["a"], "2": ["b"')
    with pytest.raises(PySparkException):
        read_document_pages(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows, pages", [(0, [0]), (5, [0, 2, 4]), (4, [0, 2, 4])])
def test_table_document(spark, root, rows, pages):
    """Written as one document with each page once; a page behind a full last one is there and empty."""
    df = spark.range(rows).selectExpr("id", "nullif(concat('v', id), 'v1') AS v")
    write_table_document(df, root, "t", ["id"] if rows != 5 else None, size=2)
    (name,) = [f for f in os.listdir(root) if f.endswith(".txt")]
    with open(os.path.join(root, name)) as f:
        doc = json.load(f)
    assert [p["pageNum"] for p in doc["dataPages"]] == list(range(len(pages))) and doc["totalPages"] == len(pages) and doc["totalRecords"] == rows
    assert [p["size"] for p in doc["dataPages"]] == [min(2, max(0, rows - at)) for at in pages]
    assert sorted(read_page_json(spark, root, df.schema, multi_line=True).collect()) == sorted(df.collect())
    assert read_page_totals(spark, root, multi_line=True).collect()[0].totalRecords == rows


def _one_document(spark, root, monkeypatch, df, pk, size):
    """``df`` as one document whose lines are sorted by several tasks; the most rows of a task are counted."""
    written = []
    join = page_json.join_files
    monkeypatch.setattr(page_json, "DOCUMENT_PART", 1_000)
    monkeypatch.setattr(page_json, "join_files", lambda spark, source, path: (written.append(spark.read.text(source).groupBy(F.input_file_name()).count().collect()), join(spark, source, path)))
    write_table_document(df, root, "t", pk, size=size)
    (parts,) = written
    assert len(parts) >= 4 and max(r["count"] for r in parts) < df.count() / 3
    (name,) = [f for f in os.listdir(root) if not f.startswith(("_", "."))]
    with open(os.path.join(root, name)) as f:
        return json.load(f)


def test_table_document_by_many_tasks(spark, root, monkeypatch):
    """no task sorts all rows; the pages and rows keep their order, and the document reads back."""
    df = spark.range(200).selectExpr("199 - id AS id", "concat('v', id) AS v")
    doc = _one_document(spark, root, monkeypatch, df, ["id"], 7)
    assert [k for p in doc["dataPages"] for k in p["data"]] == [str(i) for i in range(200)]
    assert [p["pageNum"] for p in doc["dataPages"]] == list(range(29)) and doc["totalRecords"] == 200
    assert sorted(read_page_json(spark, root, df.schema, multi_line=True).collect()) == sorted(df.collect())
    with pytest.raises(FileExistsError):
        write_table_document(df, root, "t", ["id"], size=7)


def test_wide_rows_are_dealt_by_bytes(spark, root, monkeypatch):
    """long texts with line feeds, quotes and brackets go to as many tasks as they are long."""
    df = spark.range(60).selectExpr("id", """concat(repeat('<p>"[{\\\\}]"', 20), char(10), id) AS html""")
    doc = _one_document(spark, root, monkeypatch, df, ["id"], 40)
    assert [p["size"] for p in doc["dataPages"]] == [40, 20]
    assert sorted(read_page_json(spark, root, df.schema, multi_line=True).collect()) == sorted(df.collect())


def test_places_outside_of_strings():
    text = rb'{"a\\":["]\"[",{"b":1}]}'
    found = scan(np.frombuffer(text, np.uint8), False, False, 0)
    assert bytes(text[i] for i in found.brackets) == b"{[{}]}" and found.depth.tolist() == [1, 2, 3, 2, 1, 0]
    for at in range(1, len(text)):  # every chunk border gives the same, when it knows what stands before it
        before = scan(np.frombuffer(text[:at], np.uint8), False, False, 0)
        escaped = (len(text[:at]) - len(text[:at].rstrip(b"\\"))) % 2 == 1
        depth = int(before.depth[-1]) if len(before.depth) else 0
        rest = scan(np.frombuffer(text[at:], np.uint8), escaped, len(before.quotes) % 2 == 1, depth)
        assert [*before.brackets, *(rest.brackets + at)] == found.brackets.tolist() and [*before.depth, *rest.depth] == found.depth.tolist()


@pytest.mark.parametrize(
    "vendor, want",
    [
        ("varchar(50)", "string"), ("BIGINT", "bigint"), ("int unsigned", "int"), ("numeric(10,2)", "decimal(10,2)"), ("decimal(7)", "decimal(7,0)"),
        ("money", "decimal(19,4)"), ("_text", "array<string>"), ("integer[]", "array<string>"), ("timestamptz", "timestamp"), ("bytea", "binary"),
        ("datetime2", "timestamp_ntz"), ("uuid", "string"), ("float8", "double"), ("bit", "boolean"),
    ],
)
def test_vendor_types(vendor, want):
    assert spark_type(vendor) == want


def test_vendor_type_with_given_precision():
    assert spark_type("numeric", 9, 3) == "decimal(9,3)"
    with pytest.raises(ValueError):
        spark_type("geometry")
