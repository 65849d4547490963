"""Declared constraints of the stored tables (P3): every rule bites, and keys treat nulls as a unique index does."""
import pytest

from conftest import SF001
from orderpulse.operators.constraints import TABLES, Field, Table, violations
from orderpulse.sources import tables as tb
from orderpulse.sources.broken_rows import broken_rows


@pytest.mark.parametrize("name", sorted(TABLES))
def test_every_declared_rule_is_broken_by_some_row_and_most_rows_are_sound(spark, name):
    table = TABLES[name]
    declared = {r for f in table.fields for r, _ in f.rules()} | {f"{k}_repeated" for k in table.keys} | {f"{c}_unknown" for c in table.references}
    rows = broken_rows(spark, SF001, name)
    got = violations(rows, table, {c: tb.endpoints(spark, SF001) for c in table.references})
    assert {r.rule for r in got.select("rule").distinct().collect()} >= declared - {"endpoint_id_unknown"}
    if name != "webhook_deliveries":   # the smallest scale has fewer endpoints than deliveries address
        assert got.select("id").distinct().count() < rows.count() * 0.6


def test_keys_of_several_columns_and_references(spark):
    table = Table((Field("id"), Field("a", required=False), Field("b", 2, required=False)),
                  {"id": ("id",), "ab": ("a", "b")}, {"a": "k"})
    rows = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "x", None), (4, "x", None), (5, None, "p"), (6, "z", "ppp"),
                                  (7, "y", "q"), (7, "y", "r"), (None, "y", "s")], "id int, a string, b string")
    parents = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string")
    got = violations(rows, table, {"a": parents})
    want = {(1, "ab_repeated"), (2, "ab_repeated"), (6, "b_too_long"), (6, "a_unknown"), (7, "id_repeated"), (None, "id_null")}
    assert {(r.id, r.rule) for r in got.collect()} == want and got.count() == len(want) + 1   # both rows with id 7
    assert violations(rows.limit(0), table, {"a": parents}).count() == 0
    assert violations(rows, table, {"a": parents.limit(0)}).where("rule = 'a_unknown'").count() == 8
