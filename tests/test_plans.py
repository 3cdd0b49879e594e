"""Classifier, graph, planner and CHECK reader: driver logic on metadata."""

import pytest

from seedplane.model import Column, CyclicSchemaError, ForeignKey, MaskRule, Request, Schema, SchemaError, Table
from seedplane.plans import planner
from seedplane.plans.checks import bounds
from seedplane.plans.classify import RULES, classify, normalise
from seedplane.plans.graph import Graph, closure, strong_components
from seedplane.queries import GOLDEN_DEPTH, GOLDEN_MASKS, GOLDEN_ROWS, PLANNED
from seedplane.sources.commerce import commerce
from seedplane.sources.export import ddl, manifest


def schema(*edges):
    """child.column[?]->parent"""
    names = sorted({e.split(".")[0] for e in edges} | {e.split("->")[1] for e in edges})
    tables = {}
    for name in names:
        columns, fks = [Column("id", "int4", nullable=False)], []
        for e in edges:
            if e.startswith(name + "."):
                column, parent = e[len(name) + 1 :].split("->")
                columns.append(Column(column.rstrip("?"), "int4", nullable=column.endswith("?")))
                fks.append(ForeignKey(f"{name}_{column.rstrip('?')}_fkey", name, (column.rstrip("?"),), parent, ("id",)))
        tables[name] = Table(name, tuple(columns), fks=tuple(fks))
    return Schema("public", tables)


def order(*edges):
    return Graph(schema(*edges)).order()


def test_chain_and_levels():
    o = order("customer.country_id->country", "order_header.customer_id->customer", "order_line.order_id->order_header")
    assert o.tables == ["country", "customer", "order_header", "order_line"] and max(o.depth.values()) == 3 and not o.deferred
    assert o.levels() == [["country"], ["customer"], ["order_header"], ["order_line"]]


def test_diamond_self_and_parallel_edges():
    o = order("invoice.account_id->account", "payment.account_id->account", "allocation.invoice_id->invoice", "allocation.payment_id->payment", "account.parent_id?->account", "invoice.payer_id->account")
    assert o.tables.index("allocation") == 3 and [fk.name for fk in o.own] == ["account_parent_id_fkey"] and not o.deferred


def test_cycles_break_at_the_nullable_edge():
    o = order("customer.primary_order_id?->order_header", "order_header.customer_id->customer")
    assert [fk.name for fk in o.deferred] == ["customer_primary_order_id_fkey"] and o.tables == ["customer", "order_header"]
    o = order("a.b_id->b", "b.c_id?->c", "c.a_id->a", "d.a_id->a")
    assert [fk.name for fk in o.deferred] == ["b_c_id_fkey"] and o.tables == ["b", "a", "c", "d"]
    with pytest.raises(CyclicSchemaError) as e:
        order("a.b_id->b", "b.a_id->a")
    assert e.value.members == ["a", "b"] and "a, b" in str(e.value)


def test_dangling_and_closure():
    s = schema("b.a_id->a", "c.b_id->b", "c.d_id?->d")
    g = Graph(s, {"b", "c"})
    assert sorted(fk.name for fk in g.dangling) == ["b_a_id_fkey", "c_d_id_fkey"]
    assert closure(s, {"c"}) == {"a", "b", "c"} and closure(s, {"c"}, {"a"}) == {"b", "c"}
    assert Graph(s).roots() == ["a", "d"] and Graph(s).leaves() == ["c"]


def test_strong_components():
    assert sorted(strong_components({"a": {"b"}, "b": {"a", "c"}, "c": set(), "d": {"d"}})) == [["a", "b"], ["c"], ["d"]]


def test_wide_schema_parents_come_first():
    s = schema(*[f"t{i:03d}.p{k}_id->t{(i * 7 + k * 13) % i:03d}" for i in range(1, 120) for k in range(min(i, 3))])
    o = Graph(s).order()
    for fk in Graph(s).edges:
        assert o.tables.index(fk.parent) < o.tables.index(fk.child) and o.depth[fk.parent] < o.depth[fk.child]


def test_commerce_plan_is_golden():
    s = commerce()
    p = planner.plan(s, PLANNED)
    assert p.rows == GOLDEN_ROWS and list(p.rows) == list(GOLDEN_ROWS) and p.order.depth == GOLDEN_DEPTH and p.total() == 20_760
    assert {f"{c.table}.{c.name}": c.strategy for c in p.masked()} == {c: m for m, cs in GOLDEN_MASKS.items() for c in cs.split()}
    assert sum(len(t.fks) for t in s.tables.values()) == 34 and p.order.cycles == [["customer", "order_header"]]
    assert planner.plan(s, Request(scale=100, seed=42)).total() == 207_500


def test_rules_overrides_and_limits():
    s = commerce()
    p = planner.plan(s, Request(scale=10, seed=1, rows={"country": 7, "public.category": 3}, rules=(MaskRule("*", "*", "HASH"), MaskRule("customer", "email", "NULLIFY"))))
    by = {(c.table, c.name): c for c in p.columns}
    assert p.rows["country"] == 7 and p.rows["category"] == 3
    assert by["customer", "email"].strategy == "HASH" and any("can't be NULL" in w for w in p.warnings)
    assert by["customer", "id"].strategy == "PRESERVE" and by["customer", "id"].source == "key column"
    with pytest.raises(SchemaError):
        planner.plan(s, Request(include=("nope",)))
    with pytest.raises(SchemaError):
        planner.plan(s, Request(include=("region",), exclude=("country",)))
    with pytest.raises(SchemaError):
        planner.plan(s, Request(scale=1000, seed=1, most_in_all=10))
    assert planner.plan(s, Request(include=("region",))).added == ["country"]
    assert any("capped" in w for w in planner.plan(s, Request(scale=5000, seed=3, most_per_table=6000)).warnings)


def test_table_seed_is_64_bit():
    assert planner.mix64(0) == 0 and planner.fnv64("") == 0xCBF29CE484222325
    assert planner.fnv64("a") == 0xAF63DC4C8601EC8C
    assert -(2**63) <= planner.table_seed(-1, "public.x") < 2**63


@pytest.mark.parametrize(
    "name, kind, expected",
    [
        ("email", "varchar", "EMAIL"), ("work_email", "varchar", "EMAIL"), ("FirstName", "varchar", "GIVEN_NAME"), ("last-name", "text", "FAMILY_NAME"), ("date_of_birth", "date", "DATE_OF_BIRTH"), ("email", "int4", "QUANTITY"), ("state", "varchar", "REGION"), ("cardholder_name", "varchar", "TITLE"),
        ("unit_price", "numeric", "MONETARY_AMOUNT"), ("order_id", "int8", "SURROGATE_KEY"), ("client_ip", "inet", "IP_ADDRESS"), ("flag", "bool", "BOOLEAN_FLAG"), ("notes", "text", "FREE_TEXT"), ("x", "jsonb", "JSON_DOCUMENT"), ("x", "point", "UNKNOWN"), ("elapsed", "int4", "DURATION"),
    ],
)
def test_classify(name, kind, expected):
    assert classify(name, kind) == expected


def test_classify_precedence():
    assert classify("email", "varchar", foreign=True) == "FOREIGN_KEY" and classify("id", "uuid", key=True) == "SURROGATE_KEY" and classify("status", "order_status", enum=True) == "ENUM_LABEL"
    assert normalise("__A--b  C_") == "a_b_c" and len(RULES) == 39


def test_check_bounds():
    b = bounds(["((rating >= 1) AND (rating <= 5))", "(rating > 1)"])["rating"]
    assert b.closed() == (2, 5)
    assert str(bounds(["(x > 0.5)"])["x"].closed(2)[0]) == "0.51"
    assert bounds(["kind = ANY (ARRAY['a'::text, 'b'::text])"])["kind"].members == ("a", "b")
    warnings = []
    bounds(["(a > 1) OR (b < 2)"], warnings)
    assert warnings


def test_request_limits():
    with pytest.raises(SchemaError):
        Request(scale=0)
    with pytest.raises(SchemaError):
        Request(ttl_minutes=1)


def test_ddl_and_manifest():
    s = commerce()
    lines = ddl(s)
    assert lines[0].startswith("CREATE SCHEMA") and sum("FOREIGN KEY" in x for x in lines) == 34 and sum(x.startswith("CREATE TABLE") for x in lines) == 22
    kinds = [next(i for i, k in enumerate(("CREATE SCHEMA", "CREATE TYPE", "CREATE TABLE", "PRIMARY KEY", "FOREIGN KEY")) if k in x) if any(k in x for k in ("CREATE SCHEMA", "CREATE TYPE", "CREATE TABLE", "PRIMARY KEY", "FOREIGN KEY")) else None for x in lines]
    known = [k for k in kinds if k is not None]
    assert known == sorted(known)
    p = planner.plan(s, PLANNED)
    assert manifest(s, p) == manifest(s, p) and '"total_rows": 20760' in manifest(s, p)
