"""CSV, manifest and schema-script export of a run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedplane.model import Schema, Table
from seedplane.plans.planner import Plan


def csv_cell(column: str) -> Column:
    """NULL is empty and unquoted, everything else quoted: so the two stay apart."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(F.col(column).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, limit: int | None = None, order: list[str] | None = None) -> None:
    """Lines of text without a header; with a limit, the first rows by ``order``."""
    if limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    df.select(csv_line(columns or df.columns).alias("value")).write.mode("overwrite").text(path)


def manifest(schema: Schema, plan: Plan) -> str:
    """No clock in it: the same plan gives the same text."""
    tables = [{"table": schema.qualified(t), "order": i, "depth": plan.order.depth[t], "rows": plan.rows[t], "columns": [c.name for c in schema.tables[t].columns]} for i, t in enumerate(plan.order.tables)]
    masked = [{"column": f"{c.table}.{c.name}", "class": c.data_class, "strategy": c.strategy, "source": c.source} for c in plan.masked()]
    return json.dumps({"seed": plan.seed, "schema": schema.name, "total_rows": plan.total(), "tables": tables, "masking": masked, "warnings": plan.warnings}, indent=2)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def ddl(schema: Schema) -> list[str]:
    """Statements in the order that works: schema, enums, tables, keys and uniques, then foreign keys and checks."""
    s = quoted(schema.name)
    enums = {c.type: c.labels for t in schema.tables.values() for c in t.columns if c.labels}
    out = [f"CREATE SCHEMA IF NOT EXISTS {s};"]
    out += [f"CREATE TYPE {s}.{quoted(n)} AS ENUM ({', '.join(chr(39) + x + chr(39) for x in labels)});" for n, labels in sorted(enums.items())]
    for t in schema.tables.values():
        out.append(f"CREATE TABLE {s}.{quoted(t.name)} (\n" + ",\n".join(f"  {quoted(c.name)} {c.shown}{'' if c.nullable else ' NOT NULL'}" for c in t.columns) + "\n);")
    for t in schema.tables.values():
        out.append(_constraint(s, t, f"{t.name}_pkey", f"PRIMARY KEY ({_list(t.key)})"))
        out += [_constraint(s, t, f"{t.name}_{'_'.join(u)}_key", f"UNIQUE ({_list(u)})") for u in t.uniques]
    for t in schema.tables.values():
        out += [_constraint(s, t, fk.name, f"FOREIGN KEY ({_list(fk.columns)}) REFERENCES {s}.{quoted(fk.parent)} ({_list(fk.parent_columns)}) DEFERRABLE INITIALLY IMMEDIATE") for fk in t.fks if fk.parent in schema.tables]
        out += [_constraint(s, t, f"{t.name}_check{i}", f"CHECK {c}") for i, c in enumerate(t.checks)]
    return out


def _list(columns: tuple[str, ...]) -> str:
    return ", ".join(map(quoted, columns))


def _constraint(schema: str, table: Table, name: str, body: str) -> str:
    return f"ALTER TABLE {schema}.{quoted(table.name)} ADD CONSTRAINT {quoted(name)} {body};"


def export(spark: SparkSession, schema: Schema, plan: Plan, source: str, target: str) -> None:
    """CSV of every table of a run under target/data, with schema.sql and manifest.json as one-line-a-row texts."""
    for name in plan.order.tables:
        write_csv(spark.read.parquet(f"{source}/{name}"), f"{target}/data/{name}")
    for name, body in (("schema.sql", "\n".join(ddl(schema))), ("manifest.json", manifest(schema, plan))):
        spark.createDataFrame([(i, x) for i, x in enumerate(body.split("\n"))], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{target}/{name}")
