"""Schema, request and plan as frozen dataclasses, and the vocabulary of classes, roles and strategies."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

SENSITIVE = frozenset(
    "GIVEN_NAME FAMILY_NAME FULL_NAME USERNAME EMAIL PHONE SSN NATIONAL_ID CREDIT_CARD IBAN DATE_OF_BIRTH STREET_ADDRESS CITY REGION POSTAL_CODE LATITUDE LONGITUDE IP_ADDRESS MAC_ADDRESS PASSWORD_HASH API_TOKEN".split()
)
#: The semantic classes in their order.
DATA_CLASSES = (
    "GIVEN_NAME FAMILY_NAME FULL_NAME USERNAME EMAIL PHONE SSN NATIONAL_ID CREDIT_CARD IBAN DATE_OF_BIRTH STREET_ADDRESS CITY REGION POSTAL_CODE COUNTRY LATITUDE LONGITUDE IP_ADDRESS MAC_ADDRESS USER_AGENT URL PASSWORD_HASH API_TOKEN "
    "COMPANY JOB_TITLE DEPARTMENT PRODUCT_NAME CURRENCY_CODE MONETARY_AMOUNT QUANTITY PERCENTAGE ENUM_LABEL STATUS_FLAG BOOLEAN_FLAG CREATED_TIMESTAMP UPDATED_TIMESTAMP TIMESTAMP DATE DURATION SLUG TITLE FREE_TEXT JSON_DOCUMENT BINARY_BLOB SURROGATE_KEY FOREIGN_KEY UNKNOWN"
).split()


class Role(str, Enum):
    DATABASE_GENERATED = "DATABASE_GENERATED"
    PRIMARY_KEY = "PRIMARY_KEY"
    FOREIGN_KEY = "FOREIGN_KEY"
    SELF_REFERENCE = "SELF_REFERENCE"
    DEFERRED_FOREIGN_KEY = "DEFERRED_FOREIGN_KEY"
    DANGLING_FOREIGN_KEY = "DANGLING_FOREIGN_KEY"
    VALUE = "VALUE"


class SchemaError(ValueError):
    """A request or schema that can't be planned."""


class CyclicSchemaError(SchemaError):
    """A foreign-key cycle without a nullable edge to break it at."""

    def __init__(self, members: list[str]):
        super().__init__("foreign keys form a cycle that no nullable edge breaks: " + ", ".join(members))
        self.members = members


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # the base type's name, such as varchar or int4
    nullable: bool = True
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    labels: tuple[str, ...] = ()
    element: str | None = None
    generated: str | None = None  # the expression, as SQL over the row's other columns
    data_class: str = "UNKNOWN"

    @property
    def shown(self) -> str:
        if self.length:
            return f"{self.type}({self.length})"
        return f"{self.type}({self.precision},{self.scale})" if self.precision and self.type == "numeric" else self.type + ("[]" if self.element else "")


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    def __post_init__(self):
        if len(self.columns) != len(self.parent_columns):
            raise SchemaError(f"{self.name}: {len(self.columns)} columns refer to {len(self.parent_columns)}")

    @property
    def to_self(self) -> bool:
        return self.child == self.parent


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ("id",)
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    fks: tuple[ForeignKey, ...] = ()

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def owner(self, column: str) -> ForeignKey | None:
        return next((fk for fk in self.fks if column in fk.columns), None)

    def is_unique(self, column: str) -> bool:
        return (column,) in self.uniques or self.key == (column,)

    def nullable(self, columns: tuple[str, ...], every: bool) -> bool:
        facts = [self.column(c).nullable for c in columns]
        return all(facts) if every else any(facts)


@dataclass(frozen=True)
class Schema:
    name: str
    tables: dict[str, Table]

    def qualified(self, table: str) -> str:
        return f"{self.name}.{table}"


@dataclass(frozen=True)
class MaskRule:
    table: str
    column: str
    strategy: str
    options: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Request:
    scale: int = 100
    seed: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rows: dict[str, int] = field(default_factory=dict)
    rules: tuple[MaskRule, ...] = ()
    fanout_min: int = 1
    fanout_max: int = 5
    most_per_table: int = 1_000_000
    most_in_all: int = 20_000_000
    ttl_minutes: int = 240

    def __post_init__(self):
        if not 1 <= self.scale <= 1_000_000:
            raise SchemaError("scale must be within 1 and 1000000")
        if not 5 <= self.ttl_minutes <= 1440:
            raise SchemaError("ttl must be within 5 and 1440 minutes")
