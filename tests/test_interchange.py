"""Backup folders: the catalog document and the data files."""

from decimal import Decimal

from snapforge.catalog import FRAMES, Catalog, Column, ForeignKey
from snapforge.operators.diff import diff_catalog
from snapforge.session import local_frame
from snapforge.sinks.interchange import write_backup
from snapforge.sources.interchange import read_backup, read_catalog_json

DOCUMENT = """{"format": "1", "sourceType": "SQLSERVER", "schemas": ["dbo"], "circularIgnore": [], "tables": {
  "dbo.item": {"schema": "dbo", "name": "item", "pkColumnNames": ["id"], "pkConstraintName": "pk_item", "referencedBy": [], "references": [],
    "columns": {"price": {"name": "price", "dataType": "decimal", "ordinalPosition": 3, "maxLength": 5, "columnType": "decimal", "numPrecision": 6, "numScale": 2, "nullable": true, "identity": false},
                "id": {"name": "id", "dataType": "int", "ordinalPosition": 1, "maxLength": null, "columnType": "int", "nullable": false, "identity": true},
                "label": {"name": "label", "dataType": "nvarchar", "ordinalPosition": 2, "maxLength": 40, "columnType": "nvarchar", "nullable": true, "identity": false},
                "memo": {"name": "memo", "dataType": "nvarchar", "ordinalPosition": 4, "maxLength": -1, "columnType": "nvarchar", "nullable": true, "identity": false}}}},
  "referenceInfos": [{"constraintName": "fk", "srcSchema": "dbo", "srcTableName": "item", "srcColumnNames": ["id"], "refSchema": "dbo", "refTableName": "item", "refColumnNames": ["id"]}],
  "contraintInfos": [{"constraintName": "uk", "schema": "dbo", "tableName": "item", "columnNames": ["label"]}],
  "checkConstraints": [{"schema": "dbo", "tableName": "item", "constraintName": "ck", "condef": "price > 0"}],
  "indexes": {"dbo.ix": {"ix": {"schemaName": "dbo", "tableName": "item", "indexName": "ix", "unique": true, "indexType": "btree", "columns": ["label"], "extraColumns": []}}},
  "sequences": [{"schema": "dbo", "name": "s", "startValue": 1, "minValue": 1, "maxValue": 9, "incrementBy": 1, "cycle": false, "cacheSize": 1, "lastValue": 4}]}"""


def test_read_a_given_folder(spark, tmp_path):
    (tmp_path / "db-model.json").write_text(DOCUMENT)
    # Cells are in alphabetical column order: id, label, memo, price.
    (tmp_path / "data-dbo.item.json").write_text(
        '{"tableName": "dbo.item", "pageSize": 1000, "totalPages": 1, "totalRecords": 2, "dataPages": [{"pageNum": 0, "size": 2,'
        ' "data": {"7": [7, "pen", null, 1.5], "9": [9, null, "m", 20]}}]}'
    )
    catalog, tables = read_backup(spark, str(tmp_path))
    assert catalog.source_type == "SQLSERVER" and catalog.schemas == ("dbo",)
    lengths = {r["name"]: r["max_length"] for r in catalog.columns.collect()}
    assert lengths == {"id": None, "label": 20, "memo": None, "price": 5}
    assert catalog.primary_key("dbo", "item") == ["id"]
    item = tables["dbo.item"]
    assert item.dtypes == [("id", "int"), ("label", "string"), ("price", "decimal(6,2)"), ("memo", "string")]
    assert sorted(map(tuple, item.collect())) == [(7, "pen", Decimal("1.50"), None), (9, None, Decimal("20.00"), "m")]
    assert [getattr(catalog, f).count() for f in FRAMES] == [1, 4, 1, 1, 1, 1, 1, 1]


def test_catalog_document_roundtrip(spark, root):
    catalog = Catalog.of(
        spark, source_type="POSTGRES", schemas=["s", "t"],
        columns=[Column("s", "a", "id", "int4", 1, nullable=False), Column("s", "a", "v", "numeric", 2, num_precision=5, num_scale=1), Column("t", "b", "id", "int8", 1)],
        keys=[("s", "a", "pk_a", ["id", "v"])], foreign_keys=[ForeignKey("fk", "t", "b", ("id",), "s", "a", ("id",))],
        uniques=[("s", "a", "uk", ["v"])], checks=[("s", "a", "ck", "v > 0")], indexes=[("s", "a", "ix", True, "btree", ["id"], ["v"]), ("s", "a", "iy", False, "btree", ["v"], [])],
        sequences=[("s", "q", 1, 1, 10, 1, False, 1, None)],
    )
    write_backup({"s.a": local_frame(spark, [], "id int, v decimal(5,1)"), "t.b": spark.range(3)}, catalog, root)
    back = read_catalog_json(spark, f"{root}/db-model.json")
    assert diff_catalog(back, catalog).isEmpty()
    assert (back.source_type, back.schemas, back.primary_key("s", "a")) == ("POSTGRES", ("s", "t"), ["id", "v"])
    tables = read_backup(spark, root)[1]
    assert tables["s.a"].count() == 0 and sorted(r["id"] for r in tables["t.b"].collect()) == [0, 1, 2]
