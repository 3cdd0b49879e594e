"""The registered queries: name -> (Spark query, the same in DuckDB's SQL).

Row queries are written once over the dialects of functions/dialect.py; plans are driver metadata shown as
DataFrames and held against literal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedplane.functions import corpora as W
from seedplane.functions import generators as G
from seedplane.functions.dialect import DUCK, SPARK, Spark, text
from seedplane.functions.generators import Cell
from seedplane.functions.masks import Masker
from seedplane.model import DATA_CLASSES, SENSITIVE, MaskRule, Request
from seedplane.operators import control, keys, verify
from seedplane.plans import classify, planner
from seedplane.plans.checks import bounds
from seedplane.plans.graph import Graph, closure
from seedplane.sources import introspect
from seedplane.sources.commerce import TEST_EDGES, TEST_TABLES, commerce
from seedplane.sources.export import csv_line

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: The key of the registered queries' masks; a real run brings its own secret.
KEY, SALT, SEED = "registered-query-key", "registered", 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def both(name: str, tables: list[str], statement: Callable[[Spark], str]) -> None:
    """A query whose text is the same but for the dialect; Spark reads the tables as views of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sql(spark, statement(SPARK), {t: table(spark, sf_dir, t) for t in tables})

    QUERIES[name] = run
    ORACLE[name] = statement(DUCK)


def _sql(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def values(name: str, columns: str, rows: Callable[[], list[tuple]]) -> None:
    """A plan as rows; columns: ``name type`` pairs."""

    def literal(x) -> str:
        return "null" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else text(x)

    types = {"string": "varchar", "long": "bigint", "int": "integer", "boolean": "boolean"}
    named = [c.strip().split() for c in columns.split(",")]
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(rows(), columns)
    ORACLE[name] = f"select {', '.join(f'cast({n} as {types[t]}) as {n}' for n, t in named)} from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows())}) as t({', '.join(n for n, _ in named)})"


# --- generators: one query a family over as many rows as customer has ------------------------------------
def _cell(d: Spark, column: str) -> Cell:
    return Cell(d, SEED, "public.demo", column)


FAMILIES: dict[str, dict[str, Callable[[Cell], str]]] = {
    "gen_people": {"given": lambda c: G.corpus(c, W.GIVEN), "family": lambda c: G.corpus(c, W.FAMILY), "full_name": lambda c: G._cat(c.pick(W.GIVEN), "' '", c.pick(W.FAMILY, 1)), "username": lambda c: G.username(c), "username_unique": lambda c: G.username(c, True, 20)},
    "gen_contact": {"email": lambda c: G.email(c), "email_unique": lambda c: G.email(c, True), "email_short": lambda c: G.email(c, True, 24), "phone": lambda c: G.phone(c), "url": lambda c: G.url(c)},
    "gen_identifiers": {"ssn": lambda c: G.ssn(c), "card": lambda c: G.credit_card(c), "iban": lambda c: G.iban(c), "uuid": lambda c: G.uuid(c)},
    "gen_places": {"street": lambda c: G.street(c), "city": lambda c: G.corpus(c, W.CITIES), "region": lambda c: G.corpus(c, W.REGIONS), "country": lambda c: G.corpus(c, W.COUNTRIES), "country_code": lambda c: G.corpus(c, W.COUNTRY_CODES), "postal": lambda c: c.pad(c.below(100_000), 5), "latitude": lambda c: G.degrees(c, 90), "longitude": lambda c: G.degrees(c, 180)},
    "gen_network": {"ip": lambda c: G.ipv4(c), "mac": lambda c: G.mac(c), "password": lambda c: G.opaque(c, "$2b$12$", 53), "token": lambda c: G.opaque(c, "tfk_", 32)},
    "gen_commerce": {"company": lambda c: G.corpus(c, W.COMPANIES), "job": lambda c: G.corpus(c, W.JOBS), "department": lambda c: G.corpus(c, W.DEPARTMENTS), "product": lambda c: G.corpus(c, W.PRODUCTS), "currency": lambda c: G.corpus(c, W.CURRENCIES), "status": lambda c: G.corpus(c, W.STATUSES), "enum": lambda c: G.enum_label(c, ["DRAFT", "PLACED", "PAID"])},
    "gen_text": {"unique12": lambda c: G.unique_text(c, 12), "unique8": lambda c: G.unique_text(c, 8), "slug": lambda c: G.slug(c), "slug_unique": lambda c: G.slug(c, True), "title": lambda c: G.title(c), "free": lambda c: G.free_text(c, 120), "generic": lambda c: G.generic_text(c)},
    "gen_integers": {"small_unique": lambda c: G.integer(c, True, kind="smallint"), "small": lambda c: G.integer(c, bound=30_000, kind="smallint"), "whole": lambda c: G.integer(c), "big": lambda c: G.integer(c, bound=10**9, kind="bigint"), "quantity": lambda c: G.integer(c, bound=500), "ranged": lambda c: G.int_in_range(c, -5, 5)},
    "gen_decimals": {"money": lambda c: G.money(c), "money52": lambda c: G.money(c, 5, 2), "decimal": lambda c: G.decimal(c, 10, 3), "percentage": lambda c: G.percentage(c), "ranged": lambda c: G.decimal_in_range(c, "0.01", "9.99", 6, 2), "real": lambda c: G.real(c)},
    "gen_flags": {"even": lambda c: G.boolean(c), "flag": lambda c: G.boolean(c, 30), "maybe": lambda c: G.nullable(c, G.boolean(c, 30)), "maybe_text": lambda c: G.nullable(c, G.title(c, 8))},
    "gen_dates": {"day": lambda c: G.date(c), "born": lambda c: G.birth_date(c), "created": lambda c: G.timestamp(c, 365, 0), "clock": lambda c: G.time(c), "span": lambda c: G.interval(c), "ms": lambda c: G.duration_ms(c)},
    "gen_nested": {"json": lambda c: G.json_document(c), "blob_hex": lambda c: f"hex({G.blob(c, 8)})", "words": lambda c: c.d.joined(G.text_array(c), ","), "n_ints": lambda c: c.d.joined(c.d.map(G.int_array(c), f"cast(c as {c.d.strings()})"), ",")},
}


def _family(name: str, columns: dict[str, Callable[[Cell], str]]) -> None:
    def statement(d: Spark) -> str:
        listed = ", ".join(f"{f(_cell(d, c))} as {c}" for c, f in columns.items())
        rows = "select range as __row from range(0, (select count(*) from customer))" if d is DUCK else "select id as __row from __rows"
        return f"select __row as row_ix, {listed} from ({rows}) as r"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.range(table(spark, sf_dir, "customer").count()).createOrReplaceTempView("__rows")
        return spark.sql(statement(SPARK))

    QUERIES[name], ORACLE[name] = run, statement(DUCK)


for _name, _columns in FAMILIES.items():
    _family(_name, _columns)


# --- masks ----------------------------------------------------------------------------------------------
def _mask(d: Spark, column: str = "") -> Masker:
    return Masker(d, KEY, SALT, column)


MASKS: dict[str, tuple[str, str, str, Callable[[Masker], str]]] = {
    # name: table, key column, expression of the plain value, mask
    "mask_preserve": ("customer", "c_custkey", "c_name", lambda m: m.preserve("v")),
    "mask_nullify": ("customer", "c_custkey", "c_name", lambda m: m.nullify("v")),
    "mask_redact": ("customer", "c_custkey", "c_name", lambda m: m.redact("v")),
    "mask_hash": ("customer", "c_custkey", "c_name", lambda m: m.hash("v", 12)),
    "mask_tokenize": ("customer", "c_custkey", "c_name", lambda m: m.tokenize("v")),
    "mask_name": ("supplier", "s_suppkey", "concat(s_name, case when s_suppkey % 2 = 0 then ' X' else '' end)", lambda m: m.name("v")),
    "mask_email": ("customer", "c_custkey", "concat(c_name, '@corp.test')", lambda m: m.email("v")),
    "mask_email_domain": ("customer", "c_custkey", "concat(c_name, '@corp.test')", lambda m: m.email("v", True)),
    "mask_partial": ("customer", "c_custkey", "c_name", lambda m: m.partial("v", 2, 1)),
    "mask_network": ("supplier", "s_suppkey", "case when s_suppkey % 3 = 0 then '8.8.4.4' when s_suppkey % 3 = 1 then '0a:1b:2c:3d:4e:5f' else 'fe80::1:2' end", lambda m: m.partial("v")),
    "mask_filler": ("part", "p_partkey", "concat(p_name, '-aB3')", lambda m: m.filler("v")),
    "mask_phone": ("supplier", "s_suppkey", "concat('+49 (030) ', cast(s_suppkey + 1000 as {s}), '-77')", lambda m: m.phone("v")),
    "mask_ssn": ("supplier", "s_suppkey", "case when s_suppkey % 2 = 0 then '123-45-6789' else '123456789' end", lambda m: m.ssn("v")),
    "mask_card": ("supplier", "s_suppkey", "concat('4111 1111 1111 ', lpad(cast(s_suppkey as {s}), 4, '0'))", lambda m: m.credit_card("v")),
    "mask_iban": ("supplier", "s_suppkey", "concat('DE893704004405', lpad(cast(s_suppkey as {s}), 8, '0'))", lambda m: m.iban("v")),
    "mask_url": ("pages", "page_id", "url", lambda m: m.hash("v", 64)),
}


def _masked(t: str, key: str, plain: str, mask: Callable[[Masker], str]) -> Callable[[Spark], str]:
    return lambda d: f"select {key}, {mask(_mask(d))} as masked from (select {key}, {plain.replace('{s}', d.strings())} as v from {t}) as p"


for _name, (_t, _key, _plain, _f) in MASKS.items():
    both(_name, [_t], _masked(_t, _key, _plain, _f))

both("mask_date_shift", ["orders"], lambda d: f"select o_orderkey, {_mask(d).date_shift('o_orderdate', f'concat({text('public.orders#')}, cast(o_orderkey as {d.strings()}))', 365)} as shifted from orders")
both("mask_jitter", ["customer"], lambda d: f"select c_custkey, {_mask(d).jitter('c_acctbal', 15, 2, f'cast(c_custkey as {d.strings()})')} as jittered from customer")
both(
    "mask_join_survival", ["events", "customer"],
    lambda d: f"with e as (select {_mask(d).tokenize(f'cast(user_id as {d.strings()})')} as token from events), c as (select {_mask(d).tokenize(f'cast(c_custkey as {d.strings()})')} as token, c_nationkey from customer) select c_nationkey, count(*) as n from e join c on e.token = c.token group by c_nationkey",
)
both(
    "mask_interval_survival", ["lineitem", "orders"],
    lambda d: f"with x as (select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate, concat('public.orders#', cast(o_orderkey as {d.strings()})) as k from lineitem join orders on l_orderkey = o_orderkey), "
    f"y as (select l_linenumber, {_mask(d).date_shift('l_shipdate', 'k')} as a, {_mask(d).date_shift('o_orderdate', 'k')} as b, l_shipdate, o_orderdate from x) select l_linenumber, count(*) as n, sum(case when a - b = l_shipdate - o_orderdate then 1 else 0 end) as kept from y group by l_linenumber" if d is SPARK else
    f"with x as (select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate, concat('public.orders#', cast(o_orderkey as {d.strings()})) as k from lineitem join orders on l_orderkey = o_orderkey), "
    f"y as (select l_linenumber, {_mask(d).date_shift('l_shipdate', 'k')} as a, {_mask(d).date_shift('o_orderdate', 'k')} as b, l_shipdate, o_orderdate from x) select l_linenumber, count(*) as n, cast(sum(case when a - b = l_shipdate - o_orderdate then 1 else 0 end) as bigint) as kept from y group by l_linenumber",
)

# --- keys -----------------------------------------------------------------------------------------------
_row = lambda d, t, key: f"select {key} as __row from {t}"


both("key_draw", ["orders"], lambda d: f"select __row as row_ix, {keys.draw_index(Cell(d, SEED, 'public.child', 'parent_id'), 'child_parent_fkey', 1500)} + 1 as parent_id from ({_row(d, 'orders', 'o_orderkey')}) as r")
both("key_draw_self", ["part"], lambda d: f"select __row as row_ix, {keys.draw_self(Cell(d, SEED, 'public.tree', 'parent_id'), 'tree_parent_fkey')} + 1 as parent_id from ({_row(d, 'part', 'p_partkey')}) as r")
both("key_deferred", ["customer"], lambda d: f"select __row as row_ix, {keys.draw_deferred(Cell(d, SEED, 'public.customer', 'primary_order_id'), 'fk_customer_primary_order', 4000)} + 1 as order_id from ({_row(d, 'customer', 'c_custkey')}) as r")


def _junction(d: Spark) -> str:
    a, b = keys.junction_indices("__row", [100, 2000], SEED)
    return f"select __row as row_ix, {a} as supplier_ix, {b} as part_ix from ({_row(d, 'orders', 'o_orderkey')}) as r"


both("junction_pairs", ["orders"], _junction)


@register("key_pool", "select row_number() over (order by c_custkey) - 1 as pool_ix, c_custkey, c_nationkey from customer where c_nationkey is not null")
def key_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pooled(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"], "c_custkey")


@register("unique_rounds")
def unique_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Cell(SPARK, SEED, "public.code", "code", attempt="__attempt")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__row"))
    made = lambda df: df.withColumn("code", F.expr(c.below(40_000)))
    return made(keys.unique_rounds(rows, made, [["code"]])).select(F.col("__row").alias("row_ix"), "code")


# --- scans and integrity of the test tables ---------------------------------------------------------------
TYPES = {"bigint": "int8", "int": "int4", "double": "float8", "string": "varchar", "timestamp_ntz": "timestamp", "array<float>": "float4[]", "boolean": "bool", "date": "date"}
_duck_type = "case data_type when 'BIGINT' then 'int8' when 'INTEGER' then 'int4' when 'DOUBLE' then 'float8' when 'VARCHAR' then 'varchar' when 'TIMESTAMP' then 'timestamp' when 'FLOAT[]' then 'float4[]' else lower(data_type) end"
_in_tables = f"table_name in ({', '.join(text(t) for t in TEST_TABLES)})"
_keys = {("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"), ("embeddings", "vec_id")}


def _columns_of(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, str, str]]:
    return [(t, i, name, TYPES.get(kind, kind)) for t in TEST_TABLES for i, (name, kind) in enumerate(table(spark, sf_dir, t).dtypes, 1)]


# the catalog rows of the commerce schema, a row a listed column
_CONSTRAINTS = [
    (t.name, name, kind, i, c, parent, pc)
    for t in commerce().tables.values()
    for name, kind, columns, parent, parents in [(f"{t.name}_pkey", "p", t.key, None, ())] + [(f"{t.name}_{'_'.join(u)}_key", "u", u, None, ()) for u in t.uniques] + [(fk.name, "f", fk.columns, fk.parent, fk.parent_columns) for fk in t.fks]
    for i, (c, pc) in enumerate(zip(columns, parents or [None] * len(columns)), 1)
]
#: Every constraint's columns, and of every other unique constraint an index of a name of its own, or a partial one.
_INDEXES = [(t, name if n % 2 else f"{name}_ix", i, c, kind != "f", kind == "p", "true" if n % 6 == 0 else None) for n, (t, name, kind, i, c, _, _) in enumerate(_CONSTRAINTS)]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, (bool, int)) else text(x)
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as v({names})"


def _catalog(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_CONSTRAINTS, "table_name string, name string, kind string, ordinal int, column_name string, parent string, parent_column string")
    return rows.withColumn("expression", F.lit(None).cast("string"))


_NAMES = "table_name, name, kind, ordinal, column_name, parent, parent_column"


@register("introspect_constraints", f"select table_name, name, kind, parent, string_agg(column_name, ',' order by ordinal) as listed, coalesce(string_agg(parent_column, ',' order by ordinal), '') as referred from {_values(_CONSTRAINTS, _NAMES)} group by all")
def introspect_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = introspect.constraints_of(_catalog(spark))
    return found.select("table_name", "name", "kind", "parent", F.array_join("columns", ",").alias("listed"), F.array_join("parent_columns", ",").alias("referred"))


@register(
    "introspect_unique_indexes",
    f"select table_name, name, string_agg(column_name, ',' order by ordinal) as listed from {_values(_INDEXES, 'table_name, name, ordinal, column_name, is_unique, is_primary, predicate')} where is_unique and not is_primary and predicate is null "
    f"and not exists (select 1 from (select table_name as t, name as n from {_values(_CONSTRAINTS, _NAMES)}) as c where c.t = v.table_name and c.n = v.name) group by all",
)
def introspect_unique_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = spark.createDataFrame(_INDEXES, "table_name string, name string, ordinal int, column_name string, is_unique boolean, is_primary boolean, predicate string")
    return introspect.unique_indexes(indexes, _catalog(spark)).select("table_name", "name", F.array_join("columns", ",").alias("listed"))


@register("meta_columns", f"select table_name, cast(ordinal_position as bigint) as position, column_name, {_duck_type} as type from information_schema.columns where {_in_tables}")
def meta_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_columns_of(spark, sf_dir), "table_name string, position long, column_name string, type string")


def _pairs(pairs: set[tuple[str, str]]) -> str:
    return " or ".join(f"(table_name = {text(t)} and column_name = {text(c)})" for t, c in sorted(pairs))


_foreign = {(a, b) for a, b, _, _ in TEST_EDGES}


@register("meta_classes", f"select table_name, column_name, {classify.case_sql('column_name', 'type', f'({_pairs(_foreign)})', f'({_pairs(_keys)})')} as data_class from (select table_name, column_name, {_duck_type} as type from information_schema.columns where {_in_tables}) as c")
def meta_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, c, classify.classify(c, kind, False, (t, c) in _keys, (t, c) in _foreign)) for t, _, c, kind in _columns_of(spark, sf_dir)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_class string")


@register("meta_fingerprint", f"select substr(sha256(string_agg(table_name || '|' || column_name || '|' || type, chr(10) order by table_name, position)), 1, 32) as fingerprint from (select table_name, ordinal_position as position, column_name, {_duck_type} as type from information_schema.columns where {_in_tables}) as c")
def meta_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    lines = [f"{t}|{c}|{kind}" for t, i, c, kind in sorted(_columns_of(spark, sf_dir))]
    return spark.createDataFrame([(hashlib.sha256("\n".join(lines).encode()).hexdigest()[:32],)], "fingerprint string")


_counts = [(t, k) for t, k in sorted(_keys)] + [("lineitem", "l_orderkey"), ("nation", "n_regionkey")]


@register("meta_candidate_keys", " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, count(*) as n, count(distinct {c}) = count(*) as is_key from {t}" for t, c in _counts))
def meta_candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in _counts:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n"), (F.countDistinct(c) == F.count("*")).alias("is_key")).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "n", "is_key")
        out = one if out is None else out.unionByName(one)
    return out


@register("scan_row_counts", " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in TEST_TABLES))
def scan_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TEST_TABLES:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("scan_enum_labels", "select distinct 'orders.o_orderstatus' as column_name, o_orderstatus as label from orders union all select distinct 'events.event_type', event_type from events union all select distinct 'customer.c_mktsegment', c_mktsegment from customer")
def scan_enum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in (("orders", "o_orderstatus"), ("events", "event_type"), ("customer", "c_mktsegment")):
        one = table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("column_name"), F.col(c).alias("label")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


@register("fk_orphans", " union all ".join(f"select '{a}.{b}' as edge, cast((select count(*) from {a} x where {b} is not null and not exists (select 1 from {p} y where y.{q} = x.{b} and y.{q} % 7 <> 3)) as bigint) as n" for a, b, p, q in TEST_EDGES))
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge against a parent that lacks some keys, so that there are orphans to find."""
    out = None
    for a, b, p, q in TEST_EDGES:
        parent = table(spark, sf_dir, p).filter(F.col(q) % 7 != 3)
        one = verify.orphans(table(spark, sf_dir, a), [b], parent, [q]).agg(F.count("*").alias("n")).select(F.lit(f"{a}.{b}").alias("edge"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("fk_fanout", "select o_custkey as parent_key, count(*) as children, count(distinct o_orderstatus) as kinds from orders group by o_custkey")
def fk_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parent_key")).agg(F.count("*").alias("children"), F.countDistinct("o_orderstatus").alias("kinds"))


@register("fk_fill", "select c.c_custkey, coalesce(max(o.o_orderkey), -1) as last_order from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey")
def fk_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deferred column filled by keyed update: customer's last order."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("o", F.lit(-1)).alias("last_order"))


@register("self_reference_check", "select n.n_nationkey, m.n_name as manager from nation n join nation m on n.n_regionkey = m.n_nationkey")
def self_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.alias("n").join(n.alias("m"), F.col("n.n_regionkey") == F.col("m.n_nationkey")).select("n.n_nationkey", F.col("m.n_name").alias("manager"))


@register("dup_composite_key", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def dup_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("next_keys", "select 'customer' as table_name, max(c_custkey) + 1 as next_key from customer union all select 'orders', max(o_orderkey) + 1 from orders union all select 'part', max(p_partkey) + 1 from part")
def next_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")):
        one = table(spark, sf_dir, t).agg((F.max(c) + 1).alias("next_key")).select(F.lit(t).alias("table_name"), "next_key")
        out = one if out is None else out.unionByName(one)
    return out


@register("verify_rules", "select 'enum' as rule, count(*) as n from lineitem where l_returnflag not in ('A', 'N') union all select 'check', count(*) from lineitem where not (l_quantity between 1 and 40) union all select 'notnull', count(*) from lineitem where l_tax is null union all select 'length', count(*) from part where length(p_name) > 20 union all select 'like', count(*) from pages where url not like 'https://%'")
def verify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part, pages = (table(spark, sf_dir, t) for t in ("lineitem", "part", "pages"))
    found = {"enum": verify.outside(lines, "l_returnflag", ["A", "N"]), "check": verify.failing(lines, F.col("l_quantity").between(1, 40)), "notnull": verify.nulls(lines, "l_tax"), "length": part.filter(F.length("p_name") > 20), "like": pages.filter(~F.col("url").like("https://%"))}
    out = None
    for rule, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _checksums(d: Spark) -> str:
    card, iban, masked = G.credit_card(_cell(d, "card")), G.iban(_cell(d, "iban")), _mask(d).iban("v")
    return (
        f"select count(*) as n, cast(sum(case when {verify.luhn_valid('card', d)} then 1 else 0 end) as bigint) as cards, cast(sum(case when {verify.luhn_valid('twisted', d)} then 1 else 0 end) as bigint) as twisted_cards, cast(sum(case when {verify.iban_valid('iban', d)} then 1 else 0 end) as bigint) as ibans, cast(sum(case when {verify.iban_valid('masked', d)} then 1 else 0 end) as bigint) as masked_ibans "
        f"from (select card, concat(substr(card, 1, 15), '0') as twisted, iban, masked from (select card, iban, {masked} as masked from (select {card} as card, {iban} as iban, concat('DE893704004405', lpad(cast(__row as {d.strings()}), 8, '0')) as v from (select s_suppkey as __row from supplier) as a) as b) as c) as e"
    )


both("verify_checksums", ["supplier"], _checksums)

# --- graph and plans --------------------------------------------------------------------------------------
_test_edges = ", ".join(f"({text(a)}, {text(p)})" for a, _, p, _ in TEST_EDGES)


def _test_graph() -> Graph:
    from seedplane.model import Column, ForeignKey, Schema, Table

    tables = {}
    for t in TEST_TABLES:
        fks = tuple(ForeignKey(f"{a}_{b}_fkey", a, (b,), p, (q,)) for a, b, p, q in TEST_EDGES if a == t)
        tables[t] = Table(t, tuple(Column(fk.columns[0], "int8", nullable=False) for fk in fks), (), (), (), fks)
    return Graph(Schema("public", tables))


@register("graph_edges", f"select * from (values {_test_edges}) as t(child, parent)")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(fk.child, fk.parent) for fk in _test_graph().edges], "child string, parent string")


_nodes = ", ".join(f"({text(t)})" for t in TEST_TABLES)


@register("graph_levels", f"with recursive edges(child, parent) as (values {_test_edges}), nodes(t) as (values {_nodes}), walk(t, d) as (select t, 0 from nodes union all select child, d + 1 from walk join edges on parent = t) select t as table_name, cast(max(d) as bigint) as depth from walk group by t")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = _test_graph().order()
    return spark.createDataFrame([(t, order.depth[t]) for t in order.tables], "table_name string, depth long")


@register("graph_degrees", f"with edges(child, parent) as (values {_test_edges}), nodes(t) as (values {_nodes}) select t as table_name, (select count(distinct child) from edges where parent = t) as referenced_by, (select count(distinct parent) from edges where child = t) as refers_to from nodes")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _test_graph()
    return spark.createDataFrame([(t, len(g.children[t]), len(g.parents[t])) for t in g.names], "table_name string, referenced_by long, refers_to long")


@register("graph_closure", f"with recursive edges(child, parent) as (values {_test_edges}), need(t) as (select 'lineitem' union select parent from need join edges on child = t) select t as table_name from need")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(closure(_test_graph().schema, {"lineitem"}))], "table_name string")


#: What the commerce schema's plan has to be, worked out by hand from the rules.
GOLDEN_ROWS = {
    "category": 40, "country": 40, "price_list": 120, "promotion": 40, "region": 120, "address": 240, "employee": 240, "supplier": 480, "product": 480, "product_variant": 1440, "price_list_entry": 4320, "warehouse": 240, "inventory": 2880, "customer": 480, "audit_log": 480, "customer_contact": 960, "order_header": 480, "order_line": 1440,
    "payment": 1440, "review": 1440, "shipment": 480, "shipment_item": 2880,
}
GOLDEN_DEPTH = dict(zip(GOLDEN_ROWS, (0, 0, 1, 0, 1, 2, 3, 3, 4, 5, 6, 3, 6, 3, 4, 4, 4, 6, 5, 5, 5, 7), strict=True))
GOLDEN_MASKS = {
    "EMAIL": "customer.email customer_contact.email employee.work_email supplier.contact_email audit_log.actor_email", "PHONE": "customer.phone customer_contact.phone supplier.contact_phone", "NAME": "customer.first_name customer.last_name customer_contact.full_name employee.first_name employee.last_name", "SSN": "customer.national_id",
    "CREDIT_CARD": "payment.card_number", "IBAN": "supplier.iban", "DATE_SHIFT": "customer.date_of_birth", "NUMERIC_JITTER": "address.latitude address.longitude", "PARTIAL": "region.region address.street_address address.city address.postal_code customer.last_login_ip payment.client_ip audit_log.client_ip",
}
PLANNED = Request(scale=40, seed=20260829, fanout_min=1, fanout_max=3, most_per_table=100_000)


def _against(name: str, columns: str, made: Callable[[], list[tuple]], golden: Callable[[], list[tuple]]) -> None:
    values(name, columns, golden)
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(made(), columns)


_plan = lambda: planner.plan(commerce(), PLANNED)
_against("plan_row_counts", "position long, table_name string, rows long", lambda: [(i, t, p.rows[t]) for p in [_plan()] for i, t in enumerate(p.order.tables)], lambda: [(i, t, n) for i, (t, n) in enumerate(GOLDEN_ROWS.items())])
_against("graph_order", "position long, table_name string, depth long", lambda: [(i, t, p.order.depth[t]) for p in [_plan()] for i, t in enumerate(p.order.tables)], lambda: [(i, t, d) for i, (t, d) in enumerate(GOLDEN_DEPTH.items())])
_against("graph_cycle_break", "fk string, members string", lambda: [(fk.name, ",".join(c)) for o in [_plan().order] for fk, c in zip(o.deferred, o.cycles, strict=True)], lambda: [("fk_customer_primary_order", "customer,order_header")])
_against("plan_masking_summary", "column_name string, strategy string", lambda: [(f"{c.table}.{c.name}", c.strategy) for c in _plan().masked()], lambda: [(c, s) for s, cs in GOLDEN_MASKS.items() for c in cs.split()])
_against("plan_roles", "role string, n long", lambda: sorted({(r, sum(c.role == r for c in p.columns)) for p in [_plan()] for r in {c.role for c in p.columns} if "FOREIGN" in r or "SELF" in r or "GENERATED" in r}), lambda: [("DATABASE_GENERATED", 1), ("DEFERRED_FOREIGN_KEY", 1), ("FOREIGN_KEY", 31), ("SELF_REFERENCE", 3)])
_against("meta_sensitive_classes", "data_class string, sensitive boolean, mask string", lambda: [(c, c in SENSITIVE, planner.DEFAULT_MASK.get(c, "HASH") if c in SENSITIVE else "PRESERVE") for c in DATA_CLASSES], lambda: [(c, c in SENSITIVE, planner.DEFAULT_MASK.get(c, "PRESERVE")) for c in DATA_CLASSES])
_against(
    "check_bounds", "check_text string, column_name string, low string, high string, members string",
    lambda: [(x, c, str(b.closed(2)[0]) if b.low is not None else None, str(b.closed(2)[1]) if b.high is not None else None, ",".join(b.members) if b.members else None) for x in ("(quantity > 0)", "((rating >= 1) AND (rating <= 5))", "(price >= (0)::numeric)", "kind = ANY (ARRAY['A'::text, 'B'::text])") for c, b in bounds([x]).items()],
    lambda: [("(quantity > 0)", "quantity", "0.01", None, None), ("((rating >= 1) AND (rating <= 5))", "rating", "1.00", "5.00", None), ("(price >= (0)::numeric)", "price", "0.00", None, None), ("kind = ANY (ARRAY['A'::text, 'B'::text])", "kind", None, None, "A,B")],
)
_rules = (MaskRule("*", "*", "HASH"), MaskRule("customer", "*", "TOKENIZE"), MaskRule("*", "email", "REDACT"), MaskRule("public.customer", "email", "EMAIL"))
_against(
    "mask_rule_precedence", "column_name string, strategy string",
    lambda: [(f"{t}.{c}", planner.matching_rule(_rules, t, c).strategy) for t, c in (("public.customer", "email"), ("public.customer", "phone"), ("public.orders", "email"), ("public.orders", "note"))],
    lambda: [("public.customer.email", "EMAIL"), ("public.customer.phone", "TOKENIZE"), ("public.orders.email", "REDACT"), ("public.orders.note", "HASH")],
)

# --- control plane: status boards, newest first, upserts, sweeps -------------------------------------------
both(
    "stats_dashboard", ["orders"],
    lambda d: "select count(*) as total, count(case when o_orderstatus = 'F' then 1 end) as finished, count(case when o_orderstatus = 'O' then 1 end) as open_, count(case when o_orderstatus = 'P' then 1 end) as pending, coalesce(cast(round(sum(o_totalprice)) as bigint), 0) as spent, coalesce(cast(round(avg(case when o_orderstatus = 'F' then o_totalprice end)) as bigint), 0) as average from orders",
)
both("status_counts", ["events"], lambda d: "select event_type, count(*) as n from events group by event_type")
both("recent_topn", ["orders"], lambda d: "select o_orderkey, o_custkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 50")
both("latest_per_target", ["events"], lambda d: "select user_id, event_id, event_type from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) as x where place = 1")
both("reapable_topn", ["orders"], lambda d: "select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1997-01-01 00:00:00' order by o_orderdate, o_orderkey limit 50")
both("orphan_sweep", ["customer", "orders"], lambda d: "select c_custkey from customer where c_custkey % 2 = 0 and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")


@register("upsert_masking", "select coalesce(n.k, o.k) as column_key, coalesce(n.strategy, o.strategy) as strategy from (select c_custkey as k, 'HASH' as strategy from customer where c_custkey % 3 <> 0) o full outer join (select c_custkey as k, 'EMAIL' as strategy from customer where c_custkey % 2 = 0) n on n.k = o.k")
def upsert_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("column_key"))
    old, new = k.filter("column_key % 3 <> 0").withColumn("strategy", F.lit("HASH")), k.filter("column_key % 2 = 0").withColumn("strategy", F.lit("EMAIL"))
    return control.upserted(old, new, ["column_key"])


@register("insert_if_absent", "select s_suppkey as k from supplier union select c_custkey from customer where c_custkey < 150")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    wanted = table(spark, sf_dir, "customer").filter("c_custkey < 150").select(F.col("c_custkey").alias("k"))
    return control.inserted_if_absent(there, wanted, ["k"])


@register("lease_terms", "select o_orderkey, cast(case when o_custkey % 5 = 0 then 240 else least(o_custkey % 3000, 1440) end as integer) as minutes, least(o_orderdate + interval 30 hours + interval 4 hours, o_orderdate + interval 28 hours) as renewed, o_orderstatus = 'O' and o_custkey % 9 < 6 as may_renew from orders")
def lease_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("asked", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 3000))
    o = o.withColumn("asked", F.when(F.col("asked") > 0, F.col("asked")).otherwise(F.when(F.col("o_custkey") % 5 != 0, F.lit(0))))
    terms, state = control.Terms(), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED")
    minutes = F.when(F.col("asked") == 0, F.lit(0)).otherwise(terms.granted(F.col("asked"))).cast("int")
    return o.select("o_orderkey", minutes.alias("minutes"), terms.renewed(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 hours")).alias("renewed"), control.may_renew(state, F.col("o_custkey") % 9).alias("may_renew"))


@register("lease_close", "select o_orderkey as lease_id, case when o_orderkey % 3 = 0 and o_orderstatus = 'O' then 'EXPIRED' when o_orderstatus = 'O' then 'ACTIVE' else 'RELEASED' end as state from orders")
def lease_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("RELEASED").alias("state"))
    return control.closed(leases, leases.filter("lease_id % 3 = 0"), "EXPIRED")


@register("job_progress", "select event_id, cast(floor(least(100, (case event_type when 'click' then 30 when 'view' then 60 else 86 end + case event_type when 'click' then 30 when 'view' then 26 else 6 end * greatest(0, least(1, (event_id % 130) / 100.0::double))) * 100 / 100) + 0.5) as integer) as percent from events")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "click", "GENERATING").when(F.col("event_type") == "view", "SEEDING").otherwise("VERIFYING")
    return table(spark, sf_dir, "events").select("event_id", control.overall_percent(phase, (F.col("event_id") % 130) / F.lit(100.0)).alias("percent"))


@register("safe_names", "select page_id, case when regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' then 'dataset' else substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) end as name, case when trim(list_extract(string_split(url, '/'), -1)) = '' then 'snapshot.zip' else list_extract(string_split(url, '/'), -1) end as file_name from pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", control.slug(F.col("url"), "-", 40, "dataset").alias("name"), control.file_name(F.col("url")).alias("file_name"))


_read_back = "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 100000"
both("export_read_back", ["orders"], lambda d: _read_back)


_quoted = lambda c: f"coalesce('\"' || replace(cast({c} as varchar), '\"', '\"\"') || '\"', '')"


@register("export_csv_lines", f"select c_custkey, concat_ws(',', {_quoted('c_custkey')}, {_quoted('c_name')}, {_quoted('case when c_custkey % 5 = 0 then null else c_mktsegment end')}) as line from customer")
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", csv_line(["c_custkey", "c_name", "segment"]).alias("line"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: customers and their orders, masked, still joined."""
    m = Masker(SPARK, KEY, SALT)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(m.tokenize("c_name")).alias("customer"), F.expr(m.partial("c_mktsegment")).alias("segment"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(m.date_shift("o_orderdate", "concat('public.orders#', cast(o_orderkey as string))")).alias("shifted"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("customer", "segment").agg(F.count("*").alias("orders"), F.max("shifted").alias("latest"))
