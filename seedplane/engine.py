"""Preview, run and regenerate: from a request to referentially consistent, masked tables on storage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedplane.functions.dialect import SPARK
from seedplane.functions.generators import Cell, fit
from seedplane.functions.masks import Masker
from seedplane.model import Request, Role, Schema, Table
from seedplane.operators import keys, verify
from seedplane.plans import checks, planner, resolver

TEXT_MASKS = {"REDACT": "redact", "HASH": "hash", "TOKENIZE": "tokenize", "PARTIAL": "partial", "EMAIL": "email", "PHONE": "phone", "NAME": "name", "SSN": "ssn", "CREDIT_CARD": "credit_card", "IBAN": "iban"}
OPTIONS = {"length": "length", "keepPrefix": "prefix", "keepSuffix": "suffix"}


class Engine:
    """salt: what masks are derived with besides the key; the same salt gives the same masked values again."""

    def __init__(self, spark: SparkSession, schema: Schema, key: str, salt: str = ""):
        self.spark, self.schema, self.key, self.salt = spark, schema, key, salt

    def preview(self, request: Request) -> planner.Plan:
        return planner.plan(self.schema, request)

    def run(self, request: Request, folder: str) -> planner.Plan:
        """Write every planned table as Parquet under folder, parents first, and return the plan."""
        plan = self.preview(request)
        for name in plan.order.tables:
            self.frame(plan, name, folder).write.mode("overwrite").parquet(f"{folder}/{name}")
        return plan

    def regenerate(self, request: Request, folder: str) -> planner.Plan:
        """The same request, key and salt give the same rows."""
        return self.run(request, folder)

    # one table
    def frame(self, plan: planner.Plan, name: str, folder: str) -> DataFrame:
        table = self.schema.tables[name]
        plans = {c.name: c for c in plan.columns if c.table == name}
        rows = self.spark.range(plan.rows[name]).select(F.col("id").alias("__row"))
        groups = [list(g) for g in dict.fromkeys((table.key, *table.uniques)) if self._needs_rounds(table, g, plans)]
        made = lambda df: self._made(plan, table, plans, df, folder)
        if groups:
            attempts = keys.unique_rounds(rows, made, groups)
            rows = rows.join(attempts, "__row")
        else:
            rows = rows.withColumn("__attempt", F.lit(0))
        return made(rows).select(*[c.name for c in table.columns])

    def _junction(self, table: Table) -> tuple[str, ...] | None:
        """The group that is made of whole foreign keys only, if there is one."""
        for group in (table.key, *table.uniques):
            owners = {table.owner(c) for c in group}
            if len(group) > 1 and None not in owners and len(owners) > 1 and {c for fk in owners for c in fk.columns} == set(group):
                return group
        return None

    def _needs_rounds(self, table: Table, group: tuple[str, ...], plans) -> bool:
        if group == self._junction(table):
            return False
        if len(group) > 1:
            return True
        return plans[group[0]].strategy != "PRESERVE"  # by construction unless masked

    def _made(self, plan: planner.Plan, table: Table, plans, rows: DataFrame, folder: str) -> DataFrame:
        cell = lambda column: Cell(SPARK, plan.seed, self.schema.qualified(table.name), column, attempt="__attempt")
        out: dict[str, str] = {}
        junction = self._junction(table)
        places: dict[str, str] = {}
        if junction:
            fks = sorted({table.owner(c) for c in junction}, key=lambda f: f.name)
            counts = [plan.rows[fk.parent] for fk in fks]
            if all(counts) and math.prod(counts) >= plan.rows[table.name]:
                places = dict(zip((fk.name for fk in fks), keys.junction_indices("__row", counts, abs(planner.table_seed(plan.seed, table.name)) % 10**6), strict=True))
        for fk in table.fks:
            c, n = cell(fk.columns[0]), plan.rows.get(fk.parent, 0)
            role = Role(plans[fk.columns[0]].role)
            if role is Role.DANGLING_FOREIGN_KEY or not n:
                place = "cast(null as bigint)"
            elif role is Role.SELF_REFERENCE:
                place = keys.draw_self(c, fk.name)
            elif role is Role.DEFERRED_FOREIGN_KEY:
                place = keys.draw_deferred(c, fk.name, n)
            else:
                place = places.get(fk.name) or keys.draw_index(c, fk.name, n)
            if fk.parent_columns == self.schema.tables[fk.parent].key == ("id",):
                kind = resolver.KINDS[table.column(fk.columns[0]).type]
                out[fk.columns[0]] = f"cast({place} + 1 as {kind})"
            else:  # not a function of the place: join with the parent's rows by their place
                ix = f"__ix_{fk.name}"
                pool = keys.pooled(self.spark.read.parquet(f"{folder}/{fk.parent}"), list(fk.parent_columns), fk.parent_columns[0])
                pool = pool.select(F.col("pool_ix").alias(ix), *[F.col(p).alias(f"__{fk.name}_{k}") for p, k in zip(fk.parent_columns, fk.columns, strict=True)])
                rows = rows.withColumn(ix, F.expr(place)).join(pool, ix)
                out |= {k: f"__{fk.name}_{k}" for k in fk.columns}
        for column in table.columns:
            if column.name in out:
                continue
            if column.generated:
                out[column.name] = None
            elif (column.name,) == table.key and column.type in resolver.KINDS:
                out[column.name] = f"cast(__row + 1 as {resolver.KINDS[column.type]})"
            else:
                out[column.name] = resolver.value(table, column, cell(column.name))
        # masks read the plain value many times over: it is a column of its own first
        made = rows.select("__row", "__attempt", *[F.expr(sql).alias(c) for c, sql in out.items() if sql is not None])
        masked = {c.name: self._masked(plans[c.name], c, f"`{c.name}`", self.schema.qualified(table.name)) for c in table.columns if out.get(c.name) and plans[c.name].strategy != "PRESERVE"}
        if masked:
            made = made.select("__row", "__attempt", *[F.expr(masked.get(c, f"`{c}`")).alias(c) for c, sql in out.items() if sql is not None])
        for column in table.columns:
            if column.generated:
                made = made.withColumn(column.name, F.expr(column.generated))
        return made

    def _masked(self, plan: planner.ColumnPlan, column, sql: str, table: str) -> str:
        m = Masker(SPARK, self.key, self.salt)
        s = plan.strategy
        if s == "PRESERVE":
            return sql
        if s == "NULLIFY":
            return "null"
        if s == "DATE_SHIFT":
            stamp = column.type != "date"
            return m.date_shift(sql, f"concat('{table}#', cast(__row as string))", plan.options.get("maxDays", 365), stamp)
        if s == "NUMERIC_JITTER":
            scale = column.scale if column.scale is not None else 2
            made = m.jitter(f"cast({sql} as double)", plan.options.get("percent", 15), scale, f"cast({sql} as string)")
            return f"cast({made} as decimal({column.precision or 12}, {scale}))" if column.type == "numeric" else made
        if column.type not in (*resolver.TEXTUAL, "inet", "cidr", "macaddr", "macaddr8", "uuid"):
            raise ValueError(f"{plan.table}.{plan.name}: {s} is for text")
        masked = getattr(m, TEXT_MASKS[s])(sql, **{OPTIONS[k]: v for k, v in plan.options.items() if k in OPTIONS})
        return (f"right({masked}, {column.length})" if plan.unique else fit(masked, column.length)) if column.length else masked


def violations(spark: SparkSession, schema: Schema, plan: planner.Plan, folder: str) -> DataFrame:
    """(rule, n) of everything that a run has to hold; n is 0 throughout for a sound run.

    One job a table; only the counts, one a rule, reach the driver.
    """
    read = {t: spark.read.parquet(f"{folder}/{t}") for t in plan.order.tables}
    counts: list[tuple[str, int]] = []
    for name in plan.order.tables:
        table, df = schema.tables[name], read[name]
        rules = {f"nulls {name}.{c.name}": F.col(c.name).isNull() for c in table.columns if not c.nullable and not c.generated}
        rules |= {f"labels {name}.{c.name}": ~F.col(c.name).isin(*c.labels) for c in table.columns if c.labels}
        rules |= {f"check {name} {check}": ~F.expr(checks.as_spark(check)) for check in table.checks}
        facts = df.agg(F.count("*").alias("n"), *[F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])
        found = facts.select(F.explode(F.map_from_arrays(F.array(F.lit(f"rows {name}"), *map(F.lit, rules)), F.array(F.abs(F.col("n") - plan.rows[name]), *[F.col(f"r{i}") for i in range(len(rules))]))).alias("rule", "n"))
        bad = {f"orphans {fk.name}": verify.orphans(df, list(fk.columns), read[fk.parent], list(fk.parent_columns)) for fk in table.fks if fk.parent in read}
        bad |= {f"duplicates {name}({', '.join(g)})": verify.duplicates(df, list(g)) for g in dict.fromkeys((table.key, *table.uniques))}
        for rule, rows in bad.items():
            found = found.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
        counts += [(r.rule, r.n) for r in found.collect()]
    return spark.createDataFrame(counts, "rule string, n long")
