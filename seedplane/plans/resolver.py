"""Which generator makes a column's values: checks first, then enum, array, unique text, class, type."""

from __future__ import annotations

from decimal import Decimal

from seedplane.functions import corpora as W
from seedplane.functions import generators as G
from seedplane.functions.generators import Cell
from seedplane.model import Column, SchemaError, Table

from .checks import bounds

TEXTUAL = ("text", "varchar", "bpchar", "char", "citext", "name")
KINDS = {"int2": "smallint", "int4": "int", "int8": "bigint"}


def value(table: Table, column: Column, c: Cell) -> str:
    """The column's SQL expression, nullable columns with their share of NULLs."""
    unique = table.is_unique(column.name)
    made = G.fit(_made(table, column, c, unique), column.length) if column.type in TEXTUAL else _made(table, column, c, unique)
    return G.nullable(c, made) if column.nullable and not unique else made


def _made(table: Table, column: Column, c: Cell, unique: bool) -> str:
    check = bounds(table.checks).get(column.name)
    if check is not None:
        if check.members:
            return G.enum_label(c, list(check.members))
        low, high = check.closed(0 if column.type in KINDS else column.scale or 2)
        if column.type in KINDS:
            low = int(low) if low is not None else min(0, int(high))
            return G.int_in_range(c, low, int(high) if high is not None else low + 1000, KINDS[column.type])
        p, s = column.precision or 12, column.scale or 2
        low = low if low is not None else Decimal(0)
        return G.decimal_in_range(c, str(low), str(high if high is not None else min(low + 10_000, Decimal(10 ** (p - s) - 1))), p, s)
    if column.labels:
        return G.enum_label(c, list(column.labels))
    if column.element:
        return G.int_array(c) if column.element in KINDS else G.text_array(c)
    if unique and column.type in TEXTUAL:
        return G.email(c, True, column.length) if column.data_class == "EMAIL" else G.unique_text(c, column.length)
    by_class = _by_class(column, c)
    return by_class if by_class is not None else _by_type(column, c, unique)


def _by_class(column: Column, c: Cell) -> str | None:
    n = column.length
    decimal = lambda: G.decimal(c, column.precision or 12, column.scale or 2)
    lists = {"CITY": W.CITIES, "REGION": W.REGIONS, "COUNTRY": W.COUNTRY_CODES if n and n <= 3 else W.COUNTRIES, "COMPANY": W.COMPANIES, "JOB_TITLE": W.JOBS, "DEPARTMENT": W.DEPARTMENTS, "PRODUCT_NAME": W.PRODUCTS, "CURRENCY_CODE": W.CURRENCIES, "STATUS_FLAG": W.STATUSES, "GIVEN_NAME": W.GIVEN, "FAMILY_NAME": W.FAMILY}
    kind = column.data_class
    if kind in lists:
        return G.corpus(c, lists[kind])
    if kind in ("CREATED_TIMESTAMP", "UPDATED_TIMESTAMP", "TIMESTAMP", "DATE"):
        back, ahead = {"CREATED_TIMESTAMP": (365, 0), "UPDATED_TIMESTAMP": (180, 0)}.get(kind, (365, 90))
        return G.date(c, back, ahead) if column.type == "date" else G.time(c) if column.type in ("time", "timetz") else G.timestamp(c, back, ahead)
    if kind == "QUANTITY":
        return {"numeric": decimal, "float4": lambda: f"cast({G.real(c, 100)} as float)", "float8": lambda: G.real(c), "int8": lambda: G.integer(c, bound=10**9, kind="bigint"), "int2": lambda: G.integer(c, bound=30_000, kind="smallint")}.get(column.type, lambda: G.integer(c, bound=500))()
    if kind == "DURATION":
        return {"interval": lambda: G.interval(c), "time": lambda: G.time(c), "timetz": lambda: G.time(c), "numeric": decimal}.get(column.type, lambda: G.duration_ms(c))()
    if kind in ("SURROGATE_KEY", "FOREIGN_KEY", "UNKNOWN", "ENUM_LABEL"):
        return None
    return {
        "FULL_NAME": lambda: G._cat(c.pick(W.GIVEN), "' '", c.pick(W.FAMILY, 1)), "USERNAME": lambda: G.username(c), "EMAIL": lambda: G.email(c, False, n), "PHONE": lambda: G.phone(c), "SSN": lambda: G.ssn(c), "NATIONAL_ID": lambda: G.ssn(c), "CREDIT_CARD": lambda: G.credit_card(c), "IBAN": lambda: G.iban(c),
        "DATE_OF_BIRTH": lambda: G.birth_date(c), "STREET_ADDRESS": lambda: G.street(c), "POSTAL_CODE": lambda: c.pad(c.below(100_000), 5), "LATITUDE": lambda: G.degrees(c, 90), "LONGITUDE": lambda: G.degrees(c, 180), "IP_ADDRESS": lambda: G.ipv4(c), "MAC_ADDRESS": lambda: G.mac(c),
        "USER_AGENT": lambda: G.generic_text(c), "URL": lambda: G.url(c), "PASSWORD_HASH": lambda: G.opaque(c, "$2b$12$", 53), "API_TOKEN": lambda: G.opaque(c, "tfk_", 32), "MONETARY_AMOUNT": lambda: G.real(c) if column.type.startswith("float") else G.money(c, column.precision or 12, column.scale if column.scale is not None else 2),
        "PERCENTAGE": lambda: G.percentage(c), "BOOLEAN_FLAG": lambda: G.boolean(c, 30), "SLUG": lambda: G.slug(c), "TITLE": lambda: G.title(c), "FREE_TEXT": lambda: G.free_text(c, n), "JSON_DOCUMENT": lambda: G.json_document(c), "BINARY_BLOB": lambda: G.blob(c),
    }[kind]()


def _by_type(column: Column, c: Cell, unique: bool) -> str:
    t = column.type
    if t in KINDS:
        return G.integer(c, unique, {"int2": 30_000, "int4": 10**6, "int8": 10**9}[t], KINDS[t])
    made = {
        "bool": lambda: G.boolean(c), "numeric": lambda: G.decimal(c, column.precision or 12, column.scale or 2), "float4": lambda: f"cast({G.real(c, 100)} as float)", "float8": lambda: G.real(c), "money": lambda: G.money(c, 19, 2), "uuid": lambda: G.uuid(c), "date": lambda: G.date(c), "timestamp": lambda: G.timestamp(c),
        "timestamptz": lambda: G.timestamp(c), "time": lambda: G.time(c), "timetz": lambda: G.time(c), "interval": lambda: G.interval(c), "json": lambda: G.json_document(c), "jsonb": lambda: G.json_document(c), "bytea": lambda: G.blob(c), "inet": lambda: G.ipv4(c), "cidr": lambda: G.ipv4(c), "macaddr": lambda: G.mac(c), "macaddr8": lambda: G.mac(c),
    }.get(t, (lambda: G.generic_text(c)) if t in TEXTUAL else None)
    if made is not None:
        return made()
    if column.nullable:
        return "null"
    raise SchemaError(f"{column.name}: no generator for type {t}")
