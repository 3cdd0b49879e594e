"""A schema read from catalog tables, with composite keys, indexes and labels."""

import pytest

from seedplane.model import SchemaError
from seedplane.sources import introspect as I

COLUMNS = "table_name string, column_name string, ordinal int, type string, nullable boolean, length int, precision int, scale int, element string, generated string"
CONSTRAINTS = "table_name string, name string, kind string, ordinal int, column_name string, parent string, parent_column string, expression string"
INDEXES = "table_name string, name string, ordinal int, column_name string, is_unique boolean, is_primary boolean, predicate string"


@pytest.fixture(scope="module")
def catalog(spark):
    column = lambda t, c, i, kind="int4", nullable=False, generated=None: (t, c, i, kind, nullable, None, None, None, None, generated)
    columns = spark.createDataFrame(
        [column("line", "note", 4, "varchar", True), column("line", "b", 2), column("line", "a", 1), column("line", "state", 3, "mood"), column("head", "a", 1), column("head", "b", 2), column("head", "email", 3, "varchar"), column("head", "twice", 4, "int4", True, "a * 2")], COLUMNS
    )
    constraints = spark.createDataFrame(
        [("head", "head_pkey", "p", 2, "a", None, None, None), ("head", "head_pkey", "p", 1, "b", None, None, None), ("line", "z_fkey", "f", 2, "a", "head", "a", None), ("line", "z_fkey", "f", 1, "b", "head", "b", None), ("line", "a_check", "c", 1, "a", None, None, "a > 0"), ("head", "head_email_key", "u", 1, "email", None, None, None)], CONSTRAINTS
    )
    indexes = spark.createDataFrame(
        [("head", "head_pkey", 1, "b", True, True, None), ("head", "head_email_key", 1, "email", True, False, None), ("line", "line_ix", 2, "a", True, False, None), ("line", "line_ix", 1, "state", True, False, None), ("line", "part_ix", 1, "note", True, False, "a > 1"), ("line", "plain_ix", 1, "note", False, False, None)], INDEXES
    )
    labels = spark.createDataFrame([("mood", 2, "sad"), ("mood", 1, "ok")], "type string, ordinal int, label string")
    return columns, constraints, indexes, labels


def test_schema_from_a_catalog(catalog):
    schema = I.introspect(*catalog)
    head, line = schema.tables["head"], schema.tables["line"]
    assert [c.name for c in line.columns] == ["a", "b", "state", "note"]
    assert head.key == ("b", "a") and head.uniques == (("email",),) and head.column("twice").generated == "a * 2"
    assert line.uniques == (("state", "a"),) and line.checks == ("a > 0",) and line.column("state").labels == ("ok", "sad")
    assert [(fk.name, fk.columns, fk.parent, fk.parent_columns) for fk in line.fks] == [("z_fkey", ("b", "a"), "head", ("b", "a"))]
    assert I.introspect(catalog[0], catalog[1].limit(0)).tables["head"].key == ()


def test_unique_indexes_leave_out_what_constraints_back(catalog):
    assert [(r["table_name"], r["name"], r["columns"]) for r in I.unique_indexes(catalog[2], catalog[1]).collect()] == [("line", "line_ix", ["state", "a"])]


def test_unknown_tables_are_refused(catalog):
    with pytest.raises(SchemaError):
        I.introspect(catalog[0].filter("table_name = 'line'"), catalog[1].filter("table_name = 'line'"))
    assert I.introspect(catalog[0].limit(0), catalog[1].limit(0)).tables == {}
