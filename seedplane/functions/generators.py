"""Deterministic value generators: one SQL expression per cell of (dataset seed, table, column, row).

A cell's draws are 52-bit numbers from md5 over its coordinates, the attempt and the draw's number, so a
value depends on nothing else: not on partitioning, order of execution, or how many rows are asked for.
Nothing here uses rand(), uuid() or the clock; dates count from 2026-01-01.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from . import corpora as W
from .dialect import Spark, text

EPOCH = "date'2026-01-01'"


@dataclass(frozen=True)
class Cell:
    d: Spark
    seed: int
    table: str
    column: str
    row: str = "__row"
    attempt: str = "0"

    def draw(self, n: int | str = 0) -> str:
        name = lambda x: x.replace("\\", "\\\\").replace("|", "\\p")
        return self.d.hash52(f"concat_ws('|', {text(f'{self.seed}|{name(self.table)}|{name(self.column)}')}, cast({self.row} as {self.d.strings()}), cast({self.attempt} as {self.d.strings()}), {f"'{n}'" if isinstance(n, int) else n})")

    def below(self, bound: int | str, n: int | str = 0) -> str:
        return f"({self.draw(n)} % {bound})"

    def pick(self, words: list[str], n: int | str = 0) -> str:
        return self.d.at(self.d.array([text(w) for w in words]), f"{self.below(len(words), n)} + 1")

    def s(self, number: str) -> str:
        return f"cast({number} as {self.d.strings()})"

    def pad(self, number: str, width: int) -> str:
        return f"lpad({self.s(number)}, {width}, '0')"

    def other(self, column: str) -> Cell:
        return replace(self, column=column)


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def luhn_sum(d: Spark, digits: str) -> str:
    """Luhn sum modulo 10 of a digit string, its last digit counting once."""
    value = "cast(c as int)"
    each = d.map(d.split(f"reverse({digits})"), f"case when {{i}} % 2 = 1 then {value} when {value} > 4 then {value} * 2 - 9 else {value} * 2 end")
    return f"({d.fold(each, 'a + b')} % 10)"


def mod97(d: Spark, expanded: str) -> str:
    return d.fold(d.map(d.split(expanded), "cast(c as int)"), "(a * 10 + b) % 97")


def iban_of(d: Spark, country: str, bban: str) -> str:
    """country and digits with the right check digits."""
    code = f"concat(cast(ascii(substr({country}, 1, 1)) - 55 as {d.strings()}), cast(ascii(substr({country}, 2, 1)) - 55 as {d.strings()}))"
    return _cat(country, f"lpad(cast(98 - {mod97(d, _cat(bban, code, text('00')))} as {d.strings()}), 2, '0')", bban)


def digits(c: Cell, n: int, draw: int) -> str:
    parts, left, k = [], n, draw
    while left:
        take = min(left, 12)
        parts.append(c.pad(c.below(10**take, k), take))
        left, k = left - take, k + 1
    return parts[0] if len(parts) == 1 else _cat(*parts)


def fit(value: str, length: int | None) -> str:
    return f"substr({value}, 1, {length})" if length else value


def email(c: Cell, unique: bool = False, length: int | None = None) -> str:
    mark = c.d.base36(c.row if unique else c.below(10**6, 3))
    domain = W.DOMAINS[0]
    if length is None:
        return _cat(f"lower({c.pick(W.GIVEN)})", "'.'", f"lower({c.pick(W.FAMILY, 1)})", mark, "'@'", c.pick(W.DOMAINS, 2))
    name = _cat(f"lower({c.pick(W.GIVEN)})", "'.'", f"lower({c.pick(W.FAMILY, 1)})")
    return _cat(f"substr({name}, 1, cast(greatest(1, {length - len(domain) - 1} - length({mark})) as int))", mark, text("@" + domain))


def unique_text(c: Cell, length: int | None = None) -> str:
    length = length or 32
    mark = c.d.base36(c.row)
    if length >= 12:
        return _cat(f"substr({c.pick(W.WORDS)}, 1, cast(greatest(1, {length - 1} - length({mark})) as int))", "'-'", mark)
    return f"lpad({mark}, {length}, '0')"


def username(c: Cell, unique: bool = False, length: int | None = None) -> str:
    return unique_text(c, length) if unique else fit(_cat(f"lower({c.pick(W.GIVEN)})", "'_'", c.pick(W.WORDS, 1), c.s(c.below(1000, 2))), length)


def phone(c: Cell) -> str:
    return _cat("'+1 ('", c.s(f"{c.below(700)} + 200"), "') '", c.s(f"{c.below(700, 1)} + 200"), "'-'", c.pad(c.below(10**4, 2), 4))


def ssn(c: Cell) -> str:
    return _cat(c.s(f"{c.below(100)} + 900"), "'-'", c.pad(f"{c.below(99, 1)} + 1", 2), "'-'", c.pad(f"{c.below(9999, 2)} + 1", 4))


def credit_card(c: Cell) -> str:
    body = _cat("'4'", digits(c, 14, 0))
    return _cat(body, c.s(f"(10 - {luhn_sum(c.d, _cat(body, text('0')))}) % 10"))


def iban(c: Cell) -> str:
    out = "case " + c.below(len(W.BBAN))
    for i, (country, n) in enumerate(W.BBAN.items()):
        out += f" when {i} then {iban_of(c.d, text(country), digits(c, n, 1))}"
    return out + " end"


def street(c: Cell, length: int | None = None) -> str:
    return fit(_cat(c.s(f"{c.below(9999)} + 1"), "' '", c.pick(W.STREETS, 1), "' '", c.pick(W.STREET_TYPES, 2)), length)


def free_text(c: Cell, length: int | None = None) -> str:
    n = 24 if length is None else max(3, min(48, length // 8))
    word = c.d.at(c.d.array([text(w) for w in W.WORDS]), f"{c.below(len(W.WORDS), f'cast(c as {c.d.strings()})')} + 1")
    body = c.d.joined(c.d.map(c.d.numbers(str(n)), word), " ")
    return fit(_cat(f"upper(substr({body}, 1, 1))", f"substr({body}, 2)", "'.'"), length)


def title(c: Cell, length: int | None = None) -> str:
    first = c.pick(W.WORDS)
    return fit(_cat(f"upper(substr({first}, 1, 1))", f"substr({first}, 2)", "' '", c.pick(W.WORDS, 1)), length)


def opaque(c: Cell, prefix: str, n: int) -> str:
    blocks = [f"md5(concat_ws('|', 'opaque', {c.s(c.draw(k))}))" for k in range(-(-n // 32))]
    return _cat(text(prefix), f"substr({_cat(*blocks, text(''))}, 1, {n})")


def integer(c: Cell, unique: bool = False, bound: int = 10**6, kind: str = "int") -> str:
    return f"cast({c.row} + 1 as {kind})" if unique else f"cast({c.below(bound)} + 1 as {kind})"


def money(c: Cell, precision: int = 12, scale: int = 2) -> str:
    top = 10 ** (precision - scale)
    cents = f"(case when {c.below(10)} < 9 then {c.below(50_000, 1)} else {c.below(1_500_000, 1)} end)"
    return f"cast(cast({cents} % {top * 100} as decimal(18, 0)) / 100 as decimal({precision}, {scale}))"


def decimal(c: Cell, precision: int, scale: int) -> str:
    return f"cast(cast({c.below(10 ** min(precision, 9) - 1)} as decimal(18, 0)) / {10**scale} as decimal({precision}, {scale}))"


def percentage(c: Cell) -> str:
    return f"cast(cast({c.below(10_001)} as decimal(18, 0)) / 100 as decimal(5, 2))"


def real(c: Cell, bound: int = 1000) -> str:
    return f"round({c.below(bound * 100)} / cast(100 as double), 2)"


def degrees(c: Cell, most: int) -> str:
    return f"cast(cast({c.below(2 * most * 10**6 + 1)} - {most * 10**6} as decimal(18, 0)) / 1000000 as decimal(9, 6))"


def boolean(c: Cell, percent: int = 50) -> str:
    return f"({c.below(100)} < {percent})"


def date(c: Cell, back: int = 365, ahead: int = 90) -> str:
    return c.d.date_plus(EPOCH, f"{c.below(back + ahead + 1)} - {back}")


def birth_date(c: Cell) -> str:
    return c.d.date_plus(EPOCH, f"-({18 * 365} + {c.below(62 * 365)})")


def timestamp(c: Cell, back: int = 365, ahead: int = 90) -> str:
    return c.d.stamp(f"{c.below(back + ahead + 1)} - {back}", c.below(86_400, 1))


def time(c: Cell) -> str:
    s = c.below(86_400)
    part = lambda x: f"lpad({c.s(f'cast(floor({x}) as bigint)')}, 2, '0')"
    return _cat(part(f"{s} / 3600"), "':'", part(f"({s} % 3600) / 60"), "':'", part(f"{s} % 60"))


def interval(c: Cell) -> str:
    return _cat(c.s(f"{c.below(90)} + 1"), "' days '", c.s(c.below(24, 1)), "' hours'")


def duration_ms(c: Cell) -> str:
    return f"({c.below(600_000)} + 10)"


def uuid(c: Cell) -> str:
    h = f"md5(concat_ws('|', 'uuid', {c.s(c.draw())}))"
    return _cat(f"substr({h}, 1, 8)", "'-'", f"substr({h}, 9, 4)", "'-4'", f"substr({h}, 14, 3)", "'-'", c.d.at(c.d.array(["'8'", "'9'", "'a'", "'b'"]), f"{c.below(4, 1)} + 1"), f"substr({h}, 18, 3)", "'-'", f"substr({h}, 21, 12)")


def json_document(c: Cell) -> str:
    return _cat("'{\"tier\":\"'", c.pick(W.STATUSES), "'\",\"score\":'", c.s(c.below(1000, 1)), "',\"'", c.pick(W.WORDS, 2), "'\":true,\"tag\":\"'", c.pick(W.WORDS, 3), "'\"}'")


def ipv4(c: Cell) -> str:
    return _cat(c.pick(W.TEST_NETS[1:]), c.s(f"{c.below(254, 1)} + 1"))


def mac(c: Cell) -> str:
    h = f"substr(md5(concat_ws('|', 'mac', {c.s(c.draw())})), 1, 10)"
    return _cat("'02'", *[x for i in range(5) for x in ("':'", f"substr({h}, {2 * i + 1}, 2)")])


def url(c: Cell) -> str:
    return _cat("'https://'", c.pick(W.DOMAINS), "'/'", c.pick(W.WORDS, 1), "'/'", c.pick(W.WORDS, 2))


def slug(c: Cell, unique: bool = False, length: int | None = None) -> str:
    return unique_text(c, length) if unique else fit(_cat(c.pick(W.WORDS), "'-'", c.pick(W.WORDS, 1)), length)


def generic_text(c: Cell) -> str:
    return _cat(c.pick(W.WORDS), "'-'", c.s(c.below(100_000, 1)))


def text_array(c: Cell) -> str:
    word = c.d.at(c.d.array([text(w) for w in W.WORDS]), f"{c.below(len(W.WORDS), f'cast(c as {c.d.strings()})')} + 1")
    return c.d.map(c.d.numbers(c.below(5)), word)


def int_array(c: Cell) -> str:
    return c.d.map(c.d.numbers(c.below(5)), f"cast({c.below(1000, f'cast(c as {c.d.strings()})')} as int)")


def blob(c: Cell, n: int = 64) -> str:
    return f"unhex({opaque(c, '', 2 * n)})"


def int_in_range(c: Cell, low: int, high: int, kind: str = "int") -> str:
    return f"cast({low} + {c.below(high - low + 1)} as {kind})"


def decimal_in_range(c: Cell, low: str, high: str, precision: int, scale: int) -> str:
    unit = 10**scale
    a, b = round(float(low) * unit), round(float(high) * unit)
    return f"cast(cast({a} + {c.below(b - a + 1)} as decimal(18, 0)) / {unit} as decimal({precision}, {scale}))"


def nullable(c: Cell, value: str, percent: int = 12) -> str:
    """NULL for about ``percent`` of the rows; its draw is no other's."""
    return f"(case when {c.below(100, -1)} < {percent} then null else {value} end)"


def enum_label(c: Cell, labels: list[str]) -> str:
    return c.pick(labels)


def corpus(c: Cell, words: list[str], length: int | None = None) -> str:
    return fit(c.pick(words), length)
