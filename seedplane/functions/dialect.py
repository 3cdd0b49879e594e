"""The few places where Spark SQL and DuckDB spell the same scalar function differently.

Generators and masks are written once as SQL text over these; Spark compiles the text into native
expressions (whole-stage code where it can), and DuckDB runs its twin as the oracle.
"""

from __future__ import annotations


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Spark:
    name = "spark"

    def hash52(self, key: str) -> str:
        return f"cast(conv(substr(md5({key}), 1, 13), 16, 10) as bigint)"

    def hex_int(self, digits: str) -> str:
        return f"cast(conv({digits}, 16, 10) as bigint)"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def at(self, array: str, index: str) -> str:
        return f"element_at({array}, cast({index} as int))"

    def base36(self, number: str) -> str:
        return f"lower(conv(cast({number} as string), 10, 36))"

    def chars(self, value: str, body: str) -> str:
        """body sees c (a character) and i (from 1)."""
        return f"case when {value} = '' then '' else array_join(transform(split({value}, ''), (c, i0) -> {body.replace('{i}', '(i0 + 1)')}), '') end"

    def fold(self, array: str, body: str) -> str:
        """Integer fold from 0; body sees a and b."""
        return f"aggregate({array}, 0, (a, b) -> {body})"

    def let(self, value: str, name: str, body: str) -> str:
        """body, which sees value under a name, so that it is worked out once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def split(self, value: str) -> str:
        return f"split({value}, '')"

    def map(self, array: str, body: str) -> str:
        return f"transform({array}, (c, i0) -> {body.replace('{i}', '(i0 + 1)')})"

    def numbers(self, n: str) -> str:
        """1..n; empty for 0."""
        return f"case when {n} > 0 then sequence(1, cast({n} as int)) else cast(array() as array<int>) end"

    def joined(self, array: str, by: str) -> str:
        return f"array_join({array}, {text(by)})"

    def date_plus(self, date: str, days: str) -> str:
        return f"date_add({date}, cast({days} as int))"

    def stamp(self, days: str, seconds: str) -> str:
        return f"(timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast({days} as int), 0, 0, cast({seconds} as decimal(18, 6))))"

    def stamp_plus_days(self, stamp: str, days: str) -> str:
        return f"({stamp} + make_dt_interval(cast({days} as int), 0, 0, cast(0 as decimal(18, 6))))"

    def sha256_of_bytes(self, data: str) -> str:
        return f"sha2({data}, 256)"

    def bytes_of(self, value: str) -> str:
        return f"encode({value}, 'UTF-8')"

    def bytes_concat(self, *parts: str) -> str:
        return f"concat({', '.join(parts)})"

    def matches(self, value: str, pattern: str) -> str:
        return f"regexp_like({value}, {text(pattern.replace(chr(92), chr(92) * 2))})"

    def replaced(self, value: str, pattern: str, by: str) -> str:
        return f"regexp_replace({value}, {text(pattern.replace(chr(92), chr(92) * 2))}, {text(by)})"

    def strings(self) -> str:
        return "string"


class Duck(Spark):
    name = "duckdb"

    def hash52(self, key: str) -> str:
        return f"('0x' || substr(md5({key}), 1, 13))::bigint"

    def hex_int(self, digits: str) -> str:
        return f"('0x' || {digits})::bigint"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def at(self, array: str, index: str) -> str:
        return f"list_extract({array}, ({index})::integer)"

    def base36(self, number: str) -> str:
        return f"lower(to_base({number}, 36))"

    def chars(self, value: str, body: str) -> str:
        return f"case when {value} = '' then '' else array_to_string(list_transform(string_split({value}, ''), lambda c, i: {body.replace('{i}', 'i')}), '') end"

    def fold(self, array: str, body: str) -> str:
        return f"list_reduce(list_concat([0], {array}), lambda a, b: {body})"

    def let(self, value: str, name: str, body: str) -> str:
        return f"list_extract(list_transform([{value}], lambda {name}: {body}), 1)"

    def split(self, value: str) -> str:
        return f"string_split({value}, '')"

    def map(self, array: str, body: str) -> str:
        return f"list_transform({array}, lambda c, i: {body.replace('{i}', 'i')})"

    def numbers(self, n: str) -> str:
        return f"range(1, ({n})::integer + 1)"

    def joined(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {text(by)})"

    def date_plus(self, date: str, days: str) -> str:
        return f"({date} + ({days})::integer)"

    def stamp(self, days: str, seconds: str) -> str:
        return f"(timestamp '2026-01-01 00:00:00' + to_days(({days})::integer) + to_seconds({seconds}))"

    def stamp_plus_days(self, stamp: str, days: str) -> str:
        return f"({stamp} + to_days(({days})::integer))"

    def sha256_of_bytes(self, data: str) -> str:
        return f"sha256({data})"

    def bytes_of(self, value: str) -> str:
        return f"encode({value})"

    def bytes_concat(self, *parts: str) -> str:
        return "(" + " || ".join(parts) + ")"

    def matches(self, value: str, pattern: str) -> str:
        return f"regexp_matches({value}, {text(pattern)})"

    def replaced(self, value: str, pattern: str, by: str) -> str:
        return f"regexp_replace({value}, {text(pattern)}, {text(by)}, 'g')"

    def strings(self) -> str:
        return "varchar"


SPARK, DUCK = Spark(), Duck()
