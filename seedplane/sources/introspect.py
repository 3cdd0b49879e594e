"""A Schema from catalog tables: columns, constraints, indexes and enum labels as DataFrames, one row per listed column.

Metadata is narrow (a row a column), so ordered lists and anti joins are ordinary aggregates and what the driver
collects has a row per table, constraint or index.

columns: table_name, column_name, ordinal, type, nullable, length, precision, scale, element, generated
constraints: table_name, name, kind (p, f, u, c), ordinal, column_name, parent, parent_column, expression
indexes: table_name, name, ordinal, column_name, is_unique, is_primary, predicate
labels: type, ordinal, label
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Column, ForeignKey, Schema, SchemaError, Table
from ..plans.classify import classify


def _in_order(*columns: str):
    listed = F.sort_array(F.collect_list(F.struct("ordinal", *[F.col(c) for c in columns])))
    return [listed.getField(c).alias("columns" if c == "column_name" else f"{c}s") for c in columns]


def constraints_of(constraints: DataFrame) -> DataFrame:
    """table_name, name, kind, parent, expression and, in the constraint's own order, columns and parent_columns."""
    return constraints.groupBy("table_name", "name", "kind", "parent", "expression").agg(*_in_order("column_name", "parent_column"))


def unique_indexes(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """table_name, name and ordered columns of the unique indexes that no constraint backs: not primary, not partial."""
    whole = indexes.filter("is_unique and not is_primary and predicate is null")
    free = whole.join(constraints.select("table_name", "name").distinct(), ["table_name", "name"], "left_anti")
    return free.groupBy("table_name", "name").agg(*_in_order("column_name"))


def introspect(columns: DataFrame, constraints: DataFrame, indexes: DataFrame | None = None, labels: DataFrame | None = None, name: str = "public") -> Schema:
    """The schema that the catalog describes; foreign keys, uniques and checks are in order of their names.

    A table without columns is not in the schema; a constraint of an unknown table or parent is refused.
    """
    enums = {} if labels is None else {r["type"]: tuple(r["labels"]) for r in labels.groupBy("type").agg(*_in_order("label")).collect()}
    of_table: dict[str, list] = {}
    for r in columns.orderBy("table_name", "ordinal").collect():
        of_table.setdefault(r["table_name"], []).append(r)
    named: dict[str, list] = {t: [] for t in of_table}
    backed = constraints_of(constraints).collect()
    free = [] if indexes is None else unique_indexes(indexes, constraints).withColumn("kind", F.lit("u")).collect()
    for r in sorted(backed + free, key=lambda r: r["name"]):
        if r["table_name"] not in named:
            raise SchemaError(f"{r['name']}: no table {r['table_name']}")
        if r["kind"] == "f" and r["parent"] not in named:
            raise SchemaError(f"{r['name']}: no table {r['parent']}")
        named[r["table_name"]].append(r)
    tables = {}
    for t, rows in of_table.items():
        own = {kind: [r for r in named[t] if r["kind"] == kind] for kind in "pfuc"}
        key = tuple(own["p"][0]["columns"]) if own["p"] else ()
        fks = tuple(ForeignKey(r["name"], t, tuple(r["columns"]), r["parent"], tuple(r["parent_columns"])) for r in own["f"])
        foreign = {c for fk in fks for c in fk.columns}
        listed = tuple(
            Column(
                r["column_name"], r["type"], r["nullable"], r["length"], r["precision"], r["scale"], enums.get(r["type"], ()), r["element"], r["generated"],
                classify(r["column_name"], r["type"], r["type"] in enums, r["column_name"] in key, r["column_name"] in foreign),
            )
            for r in rows
        )
        uniques = tuple(dict.fromkeys(tuple(r["columns"]) for r in own["u"]))
        tables[t] = Table(t, listed, key, uniques, tuple(r["expression"] for r in own["c"]), fks)
    return Schema(name, tables)
