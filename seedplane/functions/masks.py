"""Keyed, deterministic, format-preserving masks as SQL expressions.

Every mask draws from HMAC-SHA-256 over length-prefixed parts (salt, column, value), built from sha2 itself,
so it runs natively and equals any other HMAC. NULL stays NULL under every strategy. An empty column part,
the default, masks a value alike wherever it stands, so joins survive.

The pads are literals in the plan and as good as the key: redact plans (``spark.sql.redaction.string.regex``)
and never log them with a production key.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from . import corpora as W
from .dialect import Spark, text
from .generators import _cat, iban_of, luhn_sum


@dataclass(frozen=True)
class Masker:
    d: Spark
    key: str
    salt: str = ""
    column: str = ""

    def __post_init__(self):
        if not self.key.strip():
            raise ValueError("masking needs a key")

    def _part(self, value: str) -> str:
        length = f"octet_length({self.d.bytes_of(value)})" if self.d.name == "duckdb" else f"octet_length({value})"
        # hex() of a small number: four bytes, big-endian
        return self.d.bytes_concat(f"unhex(lpad(hex({length}), 8, '0'))", self.d.bytes_of(value))

    def hmac(self, *parts: str) -> str:
        key = self.key.encode()
        key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        pad = lambda x: f"unhex('{bytes(b ^ x for b in key).hex()}')"
        inner = self.d.sha256_of_bytes(self.d.bytes_concat(pad(0x36), *[self._part(p) for p in parts]))
        return self.d.sha256_of_bytes(self.d.bytes_concat(pad(0x5C), f"unhex({inner})"))

    def digest(self, value: str, purpose: str = "") -> str:
        return self.hmac(text(self.salt), text(self.column + purpose), value)

    def number(self, digest: str, bound: int, at: int = 0) -> str:
        return f"({self.d.hex_int(f'substr({digest}, {at * 12 % 52 + 1}, 12)')} % {bound})"

    def s(self, x: str) -> str:
        return f"cast({x} as {self.d.strings()})"

    def keep_null(self, value: str, masked: str) -> str:
        return f"(case when {value} is null then null else {masked} end)"

    def pick(self, words: list[str], digest: str, at: int) -> str:
        return self.d.at(self.d.array([text(w) for w in words]), f"{self.number(digest, len(words), at)} + 1")

    def _nibbles(self, digest: str, i: str) -> str:
        """Two hex digits of a digest by place, as a number."""
        return self.d.hex_int(f"substr({digest}, cast((({i}) * 2 - 2) % 64 + 1 as int), 2)")

    # strategies
    def preserve(self, v: str) -> str:
        return v

    def nullify(self, v: str) -> str:
        return f"cast(null as {self.d.strings()})"

    def redact(self, v: str) -> str:
        return self.keep_null(v, "'[REDACTED]'")

    def hash(self, v: str, length: int = 32) -> str:
        return self.keep_null(v, f"substr({self.digest(v)}, 1, {min(64, max(4, length))})")

    def tokenize(self, v: str) -> str:
        return self.keep_null(v, _cat("'tok_'", f"substr({self.digest(v)}, 1, 16)"))

    def filler(self, v: str) -> str:
        """Digits for digits, letters of the same case for letters, all else kept."""
        n = self._nibbles("h", "{i}")
        letter = lambda letters: f"substr('{letters}', cast({n} % 26 + 1 as int), 1)"
        body = f"case when {self.d.matches('c', '^[0-9]$')} then {self.s(f'{n} % 10')} when {self.d.matches('c', '^[a-z]$')} then {letter('abcdefghijklmnopqrstuvwxyz')} when {self.d.matches('c', '^[A-Z]$')} then {letter('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} else c end"
        return self.keep_null(v, self.d.let(self.digest(v), "h", self.d.chars(v, body)))

    def network(self, v: str) -> str:
        h = "h"
        return self.d.let(self.digest(v), h, (
            f"(case when {self.d.matches(v, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')} then {_cat(self.pick(W.TEST_NETS, h, 0), self.s(f'{self.number(h, 254, 1)} + 1'))} "
            f"when {self.d.matches(v, '^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$')} then {_cat(text('02'), *[x for i in range(5) for x in (text(':'), f'lpad({self.s(self.number(h, 100, i))}, 2, {text("0")})')])} "
            f"when {self.d.matches(v, '^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$')} then {_cat(text('2001:db8::'), f'substr({h}, 1, 4)', text(':'), f'substr({h}, 5, 4)')} end)"
        ))

    def partial(self, v: str, prefix: int = 1, suffix: int = 1) -> str:
        whole = "w"
        middle = _cat(f"substr({v}, 1, {prefix})", f"substr({whole}, {prefix + 1}, cast(length({v}) - {prefix + suffix} as int))", f"substr({v}, cast(length({v}) - {suffix - 1} as int))" if suffix else "''")
        kept = self.d.let(self.filler(v), whole, f"case when length({v}) <= {prefix + suffix} then {whole} else {middle} end")
        return self.keep_null(v, f"coalesce({self.network(v)}, {kept})")

    def email(self, v: str, preserve_domain: bool = False) -> str:
        h = "h"
        domain = f"substr({v}, cast(strpos({v}, '@') + 1 as int))" if self.d.name == "duckdb" else f"substr({v}, instr({v}, '@') + 1)"
        return self.keep_null(v, self.d.let(self.digest(v), h, _cat(f"lower({self.pick(W.GIVEN, h, 0)})", "'.'", f"lower({self.pick(W.FAMILY, h, 1)})", self.s(self.number(h, 100_000, 2)), "'@'", domain if preserve_domain else self.pick(W.DOMAINS, h, 3))))

    def name(self, v: str) -> str:
        h = "h"
        given, family = self.pick(W.GIVEN, h, 0), self.pick(W.FAMILY, h, 1)
        return self.keep_null(v, self.d.let(self.digest(v), h, f"case when trim({v}) like '% %' then {_cat(given, text(' '), family)} else {given} end"))

    def _digits(self, v: str) -> str:
        """64 keyed digits; places beyond come round again."""
        return self.d.let(self.digest(v, ":digits"), "h", self.d.chars("h", f"{self.s(f'{self._nibbles("h", "{i}")} % 10')}"))

    def _redigited(self, v: str, made: str) -> str:
        place = f"length({self.d.replaced(f'substr({v}, 1, cast({{i}} as int))', '[^0-9]', '')})"
        return self.d.chars(v, f"case when {self.d.matches('c', '^[0-9]$')} then substr({made}, cast(({place} - 1) % 64 + 1 as int), 1) else c end")

    def phone(self, v: str) -> str:
        first = f"case when substr(g, 1, 1) = '0' then {_cat(text('5'), 'substr(g, 2)')} else g end"
        return self.keep_null(v, self.d.let(self.d.let(self._digits(v), "g", first), "m", self._redigited(v, "m")))

    def ssn(self, v: str) -> str:
        h = "h"
        dash = f"case when {v} like '%-%' then '-' else '' end"
        return self.keep_null(v, self.d.let(self.digest(v), h, _cat(self.s(f"{self.number(h, 100, 0)} + 900"), dash, f"lpad({self.s(f'{self.number(h, 99, 1)} + 1')}, 2, '0')", dash, f"lpad({self.s(f'{self.number(h, 9999, 2)} + 1')}, 4, '0')")))

    def credit_card(self, v: str) -> str:
        plain = self.d.replaced(v, "[^0-9]", "")
        n = f"length({plain})"
        body = _cat(f"substr({plain}, 1, 1)", f"substr({self._digits(v)}, 1, cast({n} - 2 as int))")
        made = self.d.let(body, "b0", _cat("b0", self.s(f"(10 - {luhn_sum(self.d, _cat('b0', text('0')))}) % 10")))
        return self.keep_null(v, f"case when {n} < 4 then {self.filler(v)} else {self.d.let(made, 'm', self._redigited(v, 'm'))} end")

    def iban(self, v: str) -> str:
        plain = self.d.replaced(v, " ", "")
        return self.keep_null(v, self.d.let(f"substr({self._digits(v)}, 1, cast(length({plain}) - 4 as int))", "g", iban_of(self.d, f"upper(substr({plain}, 1, 2))", "g")))

    def date_shift(self, v: str, row_key: str, most: int = 365, stamp: bool = True) -> str:
        """All dates of one row move together, by -most..most days."""
        days = f"({self.number(self.digest(row_key, ':shift'), 2 * most + 1)} - {most})"
        return self.keep_null(v, self.d.stamp_plus_days(v, days) if stamp else self.d.date_plus(v, days))

    def jitter(self, v: str, percent: int = 15, scale: int = 2, value_text: str | None = None) -> str:
        unit = f"({self.number(self.digest(value_text or self.s(v), ':jitter'), 1 << 30)} / cast({1 << 30} as double))"
        return self.keep_null(v, f"round({v} * (1 + ({unit} * 2 - 1) * {percent} / cast(100 as double)), {scale})")
