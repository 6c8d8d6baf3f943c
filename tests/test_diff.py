"""Catalog comparison: the model's cases, and the order and shape of a full diff."""

from snapforge.catalog import Catalog, Column, ForeignKey
from snapforge.operators.diff import diff_catalog, diff_columns, diff_foreign_keys, diff_tables, dry_run


def ops(df):
    return {(r["entity"], r["op"], r["qualified_name"]) for r in df.collect()}


def test_tables(spark):
    a = Catalog.of(spark, tables=[("public", "new_table")])
    b = Catalog.of(spark, tables=[("public", "old_table")])
    assert ops(diff_catalog(a, b)) == {("table", "CREATE", "public.new_table"), ("table", "DROP", "public.old_table")}


def accounts(spark, rows):
    return Catalog.of(spark, columns=[Column("public", "accounts", n, t, i, nullable=null) for i, (n, t, null) in enumerate(rows)])


def test_columns(spark):
    src = accounts(spark, [("name", "varchar", True), ("age", "int", False), ("status", "varchar", False)])
    tgt = accounts(spark, [("name", "text", True), ("legacy", "varchar", True), ("status", "varchar", True)])
    rows = {r["name"]: r for r in diff_columns(src, tgt).collect()}
    assert {n: r["op"] for n, r in rows.items()} == {"age": "CREATE", "legacy": "DROP", "name": "MODIFY", "status": "MODIFY"}
    assert rows["name"]["changed_fields"] == ["data_type"]
    assert rows["status"]["changed_fields"] == ["nullable"]
    assert rows["name"]["old"]["data_type"] == "text" and rows["name"]["new"]["data_type"] == "varchar"
    assert rows["age"]["old"] is None and rows["age"]["changed_fields"] == []


def test_ordinal_and_default_name_do_not_count(spark):
    one = Catalog.of(spark, columns=[Column("p", "t", "c", "int", 1, default_constraint="df_1")])
    two = Catalog.of(spark, columns=[Column("p", "t", "c", "int", 9, default_constraint="df_2")])
    assert diff_catalog(one, two).isEmpty()


def family(spark, with_fk):
    columns = [Column("public", "parent", "id", "bigint"), Column("public", "child", "id", "bigint")]
    fks = []
    if with_fk:
        columns.append(Column("public", "child", "parent_id", "bigint"))
        fks.append(ForeignKey("fk_child_parent", "public", "child", ("parent_id",), "public", "parent", ("id",)))
    return Catalog.of(spark, columns=columns, foreign_keys=fks)


def test_foreign_key(spark):
    wanted, current = family(spark, True), family(spark, False)
    assert ops(diff_catalog(wanted, current)) == {
        ("column", "CREATE", "public.child.parent_id"), ("foreign_key", "CREATE", "public.fk_child_parent"),
    }
    assert ops(diff_catalog(current, wanted)) == {
        ("column", "DROP", "public.child.parent_id"), ("foreign_key", "DROP", "public.fk_child_parent"),
    }


def test_foreign_key_columns_compare_as_sets(spark):
    def one(cols, refs):
        return Catalog.of(
            spark, columns=[Column("p", "t", "a", "int")], foreign_keys=[ForeignKey("fk", "p", "t", cols, "p", "t", refs)]
        )

    assert diff_foreign_keys(one(("a", "b"), ("c", "d")), one(("b", "a"), ("d", "c"))).isEmpty()
    changed = diff_foreign_keys(one(("a", "b"), ("c", "d")), one(("a",), ("c",))).head()
    assert changed["op"] == "MODIFY" and changed["changed_fields"] == ["src_columns", "ref_columns"]


def both_ways(spark, frame, row, entity, name):
    columns = [Column("public", "t", "amount", "int", nullable=False)]
    with_it, without = Catalog.of(spark, columns=columns, **{frame: [row]}), Catalog.of(spark, columns=columns)
    assert ops(diff_catalog(with_it, without)) == {(entity, "CREATE", name)}
    assert ops(diff_catalog(without, with_it)) == {(entity, "DROP", name)}


def test_check(spark):
    both_ways(spark, "checks", ("public", "t", "ck_amount", "CHECK (amount > 0)"), "check", "public.ck_amount")


def test_index(spark):
    both_ways(spark, "indexes", ("public", "t", "idx_code", False, "btree", ["code"], []), "index", "public.idx_code")


def test_unique(spark):
    both_ways(spark, "uniques", ("public", "t", "uk_email", ["email"]), "unique", "public.uk_email")


def test_sequence(spark):
    row = ("public", "seq_demo", 1, 1, 100, 1, False, 1, None)
    both_ways(spark, "sequences", row, "sequence", "public.seq_demo")
    changed = ("public", "seq_demo", 1, 10, 2000, 2, False, 1, None)
    a, b = Catalog.of(spark, sequences=[changed]), Catalog.of(spark, sequences=[row])
    out = diff_catalog(a, b).head()
    assert out["op"] == "MODIFY" and out["changed_fields"] == ["min_value", "max_value", "increment_by"]
    assert diff_catalog(a, b, skip_sequences=True).isEmpty()


def test_objects_of_new_and_gone_tables_are_skipped(spark):
    wanted = Catalog.of(
        spark, columns=[Column("p", "fresh", "a", "int")], uniques=[("p", "fresh", "uk", ["a"])],
        checks=[("p", "fresh", "ck", "a > 0")], indexes=[("p", "fresh", "ix", True, "btree", ["a"], [])],
        foreign_keys=[ForeignKey("fk", "p", "fresh", ("a",), "p", "fresh", ("a",))],
    )
    empty = Catalog.of(spark)
    assert ops(diff_catalog(wanted, empty)) == {("table", "CREATE", "p.fresh")}
    assert ops(diff_catalog(empty, wanted)) == {("table", "DROP", "p.fresh")}


def test_equal_names_in_two_schemas_stay_apart(spark):
    a = Catalog.of(spark, tables=[("x", "t"), ("y", "t")], checks=[("x", "t", "ck", "a > 0"), ("y", "t", "ck", "a > 1")])
    b = Catalog.of(spark, tables=[("x", "t"), ("y", "t")], checks=[("x", "t", "ck", "a > 0"), ("y", "t", "ck", "a > 2")])
    assert ops(diff_catalog(a, b)) == {("check", "MODIFY", "y.ck")}


def test_null_schema_is_one_schema(spark):
    a = Catalog.of(spark, columns=[Column(None, "t", "a", "int")])
    b = Catalog.of(spark, columns=[Column("", "t", "a", "int")])
    assert diff_catalog(a, b).isEmpty()
    assert diff_tables(a, b).isEmpty()


def test_order_and_dry_run(spark):
    src = Catalog.of(
        spark, tables=[("p", "t"), ("p", "n2"), ("p", "n1")],
        columns=[Column("p", "t", "b", "int"), Column("p", "t", "m", "int")], sequences=[("p", "s", 1, 1, 9, 1, False, 1, 0)],
    )
    tgt = Catalog.of(spark, tables=[("p", "t"), ("p", "o")], columns=[Column("p", "t", "a", "int"), Column("p", "t", "m", "text")])
    got = [(r["entity"], r["op"], r["qualified_name"]) for r in diff_catalog(src, tgt).collect()]
    assert got == [
        ("table", "CREATE", "p.n1"), ("table", "CREATE", "p.n2"), ("table", "DROP", "p.o"),
        ("column", "CREATE", "p.t.b"), ("column", "DROP", "p.t.a"), ("column", "MODIFY", "p.t.m"),
        ("sequence", "CREATE", "p.s"),
    ]
    assert [tuple(r) for r in dry_run(src, tgt).collect()] == [
        ("table", "CREATE", 2), ("table", "DROP", 1), ("column", "CREATE", 1), ("column", "DROP", 1), ("column", "MODIFY", 1),
        ("sequence", "CREATE", 1),
    ]
