"""Column changes, schema mapping, sequences."""

from decimal import Decimal

import pytest

from snapforge.catalog import SCHEMAS, Catalog, Column, ForeignKey, filter_schemas
from snapforge.operators.diff import diff_columns
from snapforge.operators.evolve import ColumnOp, EvolveError, column_ops, evolve_table, summary
from snapforge.operators.schema_map import map_schema
from snapforge.operators.sequences import SequenceMapping, max_value, next_sequence_values
from snapforge.plans.flows import update_schema
from snapforge.session import local_frame


def table(spark):
    return local_frame(spark, [(1, "10", None), (2, "x", "b")], "id int, code string, note string")


def test_all_changes(spark):
    ops = [
        ColumnOp("CREATE", "n", "numeric", 6, 2, default="1.5"), ColumnOp("CREATE", "d", "date", default="'2024-01-01'::date"),
        ColumnOp("CREATE", "q", "text", default="'it''s'"), ColumnOp("DROP", "note"), ColumnOp("MODIFY", "id", "text"),
    ]
    out, results = evolve_table(table(spark), ops, ["d", "id"])
    assert out.columns == ["d", "id", "code", "n", "q"]
    assert out.dtypes[1] == ("id", "string") and out.dtypes[3] == ("n", "decimal(6,2)")
    assert out.head()["n"] == Decimal("1.50") and out.head()["q"] == "it's"
    assert summary(results) == {"success": 5, "failed": 0, "total": 5}


FAILING = [
    (ColumnOp("MODIFY", "code", "int4"), "1 rows do not fit"),
    (ColumnOp("MODIFY", "note", "text", nullable=False, changed=("nullable",)), "1 rows do not fit"),
    (ColumnOp("MODIFY", "code", "varchar", max_length=1), "1 rows do not fit"),
    (ColumnOp("CREATE", "must", "int4", nullable=False), "2 rows do not fit"),
    (ColumnOp("CREATE", "code", "int4"), "column exists"),
    (ColumnOp("MODIFY", "gone", "int4"), "no such column"),
    (ColumnOp("DROP", "gone"), "no such column"),
    (ColumnOp("CREATE", "g", "geometry"), "unknown data type 'geometry'"),
]


def test_failures_leave_the_column(spark):
    df = table(spark)
    out, results = evolve_table(df, [op for op, _ in FAILING])
    assert [(r.ok, r.message) for r in results] == [(False, m) for _, m in FAILING]
    assert out.collect() == df.collect()


def test_stop_on_error(spark):
    with pytest.raises(EvolveError, match="code") as e:
        evolve_table(table(spark), [ColumnOp("DROP", "note"), FAILING[0][0], ColumnOp("DROP", "id")], continue_on_error=False)
    assert [r.ok for r in e.value.results] == [True, False]


def test_not_null_without_default_is_fine_on_an_empty_table(spark):
    out, results = evolve_table(table(spark).limit(0), [ColumnOp("CREATE", "must", "int4", nullable=False)])
    assert results[0].ok and "must" in out.columns


def test_default_and_key_changes_do_not_touch_rows(spark):
    df = table(spark)
    out, results = evolve_table(df, [ColumnOp("MODIFY", "code", "varchar", default="'z'", changed=("column_default", "column_key"))])
    assert results[0].ok and out.collect() == df.collect()


def test_update_schema(spark):
    current = Catalog.of(
        spark, columns=[Column("s", "t", "id", "int", 1), Column("s", "t", "code", "varchar", 2), Column("s", "t", "note", "varchar", 3), Column("s", "old", "x", "int", 1)]
    )
    wanted = Catalog.of(
        spark, columns=[Column("s", "t", "added", "int8", 1, column_default="5"), Column("s", "t", "id", "int8", 2), Column("s", "t", "code", "varchar", 3)]
    )
    dfs = {"s.t": table(spark), "s.old": spark.range(1)}
    same, planned, _ = update_schema(dfs, wanted, current, dry_run=True)
    assert same is dfs and planned.count() == 4
    out, _, outcomes = update_schema(dfs, wanted, current)
    assert set(out) == {"s.t"} and all(r.ok for r in outcomes["s.t"])
    assert out["s.t"].dtypes == [("added", "bigint"), ("id", "bigint"), ("code", "string")]
    assert [op.op for op in column_ops(diff_columns(wanted, current), "s", "t")] == ["CREATE", "DROP", "MODIFY"]


def mapped(spark, schemas):
    return Catalog.of(
        spark, schemas=schemas, columns=[Column("Public", "t", "a", "int"), Column("other", "t", "a", "int")],
        foreign_keys=[ForeignKey("fk", "other", "t", ("a",), "PUBLIC", "t", ("a",))], sequences=[("public", "s", 1, 1, 9, 1, False, 1, 0)],
        indexes=[("public", "t", "ix", True, "btree", ["a"], [])], uniques=[("public", "t", "uk", ["a"])], checks=[("public", "t", "ck", "a > 0")],
    )


def test_map_schema(spark):
    dfs = {"Public.t": spark.range(1), "other.t": spark.range(2), "plain": spark.range(3)}
    catalog, tables = map_schema(mapped(spark, ["Public", "other"]), dfs, "public", "app")
    assert set(tables) == {"app.t", "other.t", "plain"}
    assert sorted(catalog.schemas) == ["app", "other"]
    assert {r["schema"] for r in catalog.columns.collect()} == {"app", "other"}
    fk = catalog.foreign_keys.head()
    assert (fk["src_schema"], fk["ref_schema"]) == ("other", "app")
    for name in ("sequences", "indexes", "uniques", "checks"):
        assert getattr(catalog, name).head()["schema"] == "app"


@pytest.mark.parametrize("schemas", [[], ["other"]])
def test_map_schema_without_the_schema_does_nothing(spark, schemas):
    catalog, dfs = mapped(spark, schemas), {"public.t": spark.range(1)}
    assert map_schema(catalog, dfs, "public", "app") == (catalog, dfs)


def test_filter_schemas(spark):
    kept = filter_schemas(mapped(spark, ["Public", "other"]), ["other"])
    assert kept.columns.count() == 1 and kept.sequences.isEmpty() and kept.schemas == ("other",)
    assert kept.foreign_keys.count() == 1


def test_sequences(spark):
    dfs = {
        "s.a": local_frame(spark, [(3, 2.9, "x")], "id int, d double, t string"), "s.b": local_frame(spark, [], "id bigint"),
        "s.c": local_frame(spark, [(8,)], "other int"), "s.neg": local_frame(spark, [(-4.7,)], "id double"),
    }
    seqs = local_frame(spark, [("s", n, 1, 1, 9, 1, False, 1, 0) for n in ("a_id_seq", "b_id_seq", "c_id_seq", "neg_id_seq", "x")], SCHEMAS["sequences"])
    out = next_sequence_values(dfs, seqs, "{tableName}_{columnName}_seq", "id", [SequenceMapping("s", "x", "a", "d")])
    got = {r["sequence"]: (r["max_value"], r["new_value"]) for r in out.collect()}
    assert got == {"s.a_id_seq": (3, 4), "s.b_id_seq": (None, 1), "s.neg_id_seq": (-4, -3), "s.x": (2, 3)}
    assert max_value(dfs["s.a"], "t").head()[0] is None
    assert next_sequence_values(dfs, seqs).isEmpty()
    assert next_sequence_values(dfs, seqs, "{tableName}_{columnName}_seq", "id", source_type="MYSQL").isEmpty()


def test_maxima_that_are_no_bigint(spark):
    df = spark.sql("SELECT explode(array(1.5D, double('NaN'))) AS a, double('Infinity') AS b, 1e30D AS c, 7.9D AS d")
    assert [max_value(df, c).head()[0] for c in "abcd"] == [None, None, None, 7]


def test_a_failing_table_only_warns(spark):
    broken = spark.range(3).selectExpr("raise_error('gone') AS x", "id").selectExpr("cast(x AS bigint) AS id")
    seqs = local_frame(spark, [("s", f"{t}_id_seq") for t in "ab"], "schema string, name string")
    with pytest.warns(UserWarning, match="gone"):
        out = next_sequence_values({"s.a": broken, "s.b": spark.range(5)}, seqs, "{tableName}_{columnName}_seq", "id", continue_on_error=True)
    assert [(r["sequence"], r["max_value"], r["new_value"]) for r in out.collect()] == [("s.b_id_seq", 4, 5)]
