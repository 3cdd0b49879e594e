"""Row counts, column roles and masking decisions for a request, before any row is made."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from seedplane.model import SENSITIVE, Column, MaskRule, Request, Role, Schema, SchemaError, Table

from .graph import Graph, Order, closure

MASK64 = (1 << 64) - 1
#: The mask of each sensitive class; HASH for the others.
DEFAULT_MASK = {
    "EMAIL": "EMAIL", "PHONE": "PHONE", "GIVEN_NAME": "NAME", "FAMILY_NAME": "NAME", "FULL_NAME": "NAME", "SSN": "SSN", "NATIONAL_ID": "SSN", "CREDIT_CARD": "CREDIT_CARD", "IBAN": "IBAN", "DATE_OF_BIRTH": "DATE_SHIFT", "LATITUDE": "NUMERIC_JITTER", "LONGITUDE": "NUMERIC_JITTER",
    "PASSWORD_HASH": "HASH", "API_TOKEN": "HASH", "USERNAME": "TOKENIZE", "STREET_ADDRESS": "PARTIAL", "CITY": "PARTIAL", "REGION": "PARTIAL", "POSTAL_CODE": "PARTIAL", "IP_ADDRESS": "PARTIAL", "MAC_ADDRESS": "PARTIAL",
}


def mix64(x: int) -> int:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK64
    return x ^ (x >> 31)


def fnv64(name: str) -> int:
    """FNV-1a over UTF-16 units."""
    data = name.encode("utf-16-le")
    h = 0xCBF29CE484222325
    for i in range(0, len(data), 2):
        h = (h ^ (data[i] | data[i + 1] << 8)) * 0x100000001B3 & MASK64
    return h


def table_seed(seed: int, qualified: str) -> int:
    x = mix64(mix64((seed ^ 0x94D049BB133111EB) & MASK64) ^ fnv64(qualified))
    return x - (1 << 64) if x >> 63 else x


def unique_capacity(column: Column) -> float:
    if column.type == "int2":
        return 32_767
    if column.type == "bool":
        return 2
    if column.type in ("varchar", "char", "bpchar") and column.length and column.length < 13:
        return 36**column.length
    return math.inf


def glob_matches(pattern: str, name: str) -> bool:
    """* stands for anything; a pattern without it also matches behind a dot; case doesn't count."""
    pattern, name = pattern.lower(), name.lower()
    if "*" in pattern:
        return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name) is not None
    return name == pattern or name.endswith("." + pattern)


def matching_rule(rules: tuple[MaskRule, ...], table: str, column: str) -> MaskRule | None:
    """The most specific rule, the first declared of equals: an exact table counts two, an exact column one."""
    fits = [r for r in rules if glob_matches(r.table, table) and glob_matches(r.column, column)]
    return max(fits, key=lambda r: 2 * ("*" not in r.table) + ("*" not in r.column), default=None)


@dataclass
class ColumnPlan:
    table: str
    name: str
    type: str
    data_class: str
    role: str
    strategy: str
    source: str
    unique: bool
    nullable: bool
    options: dict[str, int] = field(default_factory=dict)


@dataclass
class Plan:
    seed: int
    order: Order
    rows: dict[str, int]
    columns: list[ColumnPlan]
    added: list[str]
    warnings: list[str]

    def total(self) -> int:
        return sum(self.rows.values())

    def masked(self) -> list[ColumnPlan]:
        return [c for c in self.columns if c.strategy != "PRESERVE"]


def select_tables(schema: Schema, request: Request) -> tuple[set[str], list[str]]:
    unknown = [t for t in request.include if t not in schema.tables]
    if unknown:
        raise SchemaError(f"no such table: {', '.join(unknown)}")
    wanted = set(request.include or schema.tables) - set(request.exclude)
    if not wanted:
        raise SchemaError("no table is left")
    all_ = closure(schema, wanted, set(request.exclude))
    for t in sorted(all_):
        for fk in schema.tables[t].fks:
            if fk.parent in request.exclude and not fk.to_self and not schema.tables[t].nullable(fk.columns, every=True):
                raise SchemaError(f"{fk.name} needs {fk.parent}, which is excluded")
    return all_, sorted(all_ - wanted)


def plan(schema: Schema, request: Request) -> Plan:
    included, added = select_tables(schema, request)
    graph = Graph(schema, included)
    order = graph.order()
    warnings: list[str] = []
    rows: dict[str, int] = {}
    for t in order.tables:
        rows[t] = _rows(schema, request, graph, rows, schema.tables[t], warnings)
    if sum(rows.values()) > request.most_in_all:
        raise SchemaError(f"{sum(rows.values())} rows are more than {request.most_in_all}")
    columns = [c for t in order.tables for c in _columns(schema, request, order, schema.tables[t], warnings)]
    return Plan(request.seed, order, rows, columns, added, warnings)


def _rows(schema: Schema, request: Request, graph: Graph, counts: dict[str, int], table: Table, warnings: list[str]) -> int:
    name = schema.qualified(table.name)
    n = request.rows.get(name, request.rows.get(table.name))
    if n is None:
        n = request.scale
        parents = graph.parents[table.name]
        if parents:
            span = max(1, request.fanout_max - request.fanout_min + 1)
            n = max(1, max(counts.get(p, request.scale) for p in parents) * (request.fanout_min + table_seed(request.seed, name) % span))
        made_of_keys = len(table.key) > 1 and {c for fk in table.fks for c in fk.columns} >= set(table.key)
        pairs = math.prod(max(1, counts.get(p, 1)) for p in parents)
        limits = [(max(1, pairs * 3 // 4), "its key is made of foreign keys")] if made_of_keys and pairs <= 2**31 - 1 else []
        limits += [(unique_capacity(table.column(u[0])), f"unique column {u[0]} has no more values") for u in table.uniques if len(u) == 1]
        for most, why in limits:
            if most < n:
                warnings.append(f"{name} capped at {most} rows: {why}")
                n = int(most)
    if n > request.most_per_table:
        warnings.append(f"{name} capped at {request.most_per_table} rows: the limit for a table")
    return max(0, min(n, request.most_per_table))


def role_of(order: Order, table: Table, column: Column) -> Role:
    fk = table.owner(column.name)
    if column.generated:
        return Role.DATABASE_GENERATED
    if fk is not None:
        return Role.SELF_REFERENCE if fk.to_self else Role.DEFERRED_FOREIGN_KEY if fk in order.deferred else Role.DANGLING_FOREIGN_KEY if fk in order.dangling else Role.FOREIGN_KEY
    return Role.PRIMARY_KEY if column.name in table.key else Role.VALUE


def _columns(schema: Schema, request: Request, order: Order, table: Table, warnings: list[str]) -> list[ColumnPlan]:
    name, out = schema.qualified(table.name), []
    for c in table.columns:
        role = role_of(order, table, c)
        rule = matching_rule(request.rules, name, c.name)
        strategy = rule.strategy if rule else DEFAULT_MASK.get(c.data_class, "HASH") if c.data_class in SENSITIVE else "PRESERVE"
        source = f"rule {rule.table}.{rule.column}" if rule else "not sensitive" if strategy == "PRESERVE" else f"sensitive class {c.data_class}"
        if strategy == "NULLIFY" and not c.nullable:
            warnings.append(f"{name}.{c.name} can't be NULL and is hashed instead")
            strategy = "HASH"
        if role is not Role.VALUE and strategy != "PRESERVE":
            if role in (Role.PRIMARY_KEY, Role.FOREIGN_KEY):
                warnings.append(f"{name}.{c.name} is a key and stays unmasked")
            strategy, source = "PRESERVE", "key column"
        out.append(ColumnPlan(table.name, c.name, c.shown, c.data_class, role.value, strategy, source, table.is_unique(c.name), c.nullable, dict(rule.options) if rule else {}))
    return out
