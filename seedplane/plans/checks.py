"""Bounds and memberships out of CHECK constraint texts.

Every comparison of a column with a number is taken as holding, also beside OR (then with a warning).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

COMPARED = re.compile(r"\(?\"?(\w+)\"?\)?(?:::\w+)?\s*(>=|<=|>|<|=)\s*\(?'?(-?\d+(?:\.\d+)?)'?\)?(?:::\w+)?")
BETWEEN = re.compile(r"\"?(\w+)\"?\s+BETWEEN\s+(-?\d+(?:\.\d+)?)\s+AND\s+(-?\d+(?:\.\d+)?)", re.I)
ANY = re.compile(r"\(?\"?(\w+)\"?\)?(?:::\w+)?\s*(?:=\s*ANY\s*\(+\s*ARRAY\s*\[|IN\s*\()(.*?)[\])]", re.I | re.S)


@dataclass
class Bounds:
    low: Decimal | None = None
    high: Decimal | None = None
    low_open: bool = False
    high_open: bool = False
    members: tuple[str, ...] | None = None

    def at_least(self, x: Decimal, open_: bool = False) -> None:
        if self.low is None or x > self.low or (x == self.low and open_):
            self.low, self.low_open = x, open_

    def at_most(self, x: Decimal, open_: bool = False) -> None:
        if self.high is None or x < self.high or (x == self.high and open_):
            self.high, self.high_open = x, open_

    def closed(self, scale: int = 0) -> tuple[Decimal | None, Decimal | None]:
        """Inclusive bounds at a scale: an open bound moves by one unit of the last place."""
        unit = Decimal(1).scaleb(-scale)
        up = lambda x, open_: (x.quantize(unit, "ROUND_FLOOR") + unit) if open_ else x.quantize(unit, "ROUND_CEILING")
        down = lambda x, open_: (x.quantize(unit, "ROUND_CEILING") - unit) if open_ else x.quantize(unit, "ROUND_FLOOR")
        return None if self.low is None else up(self.low, self.low_open), None if self.high is None else down(self.high, self.high_open)


def bounds(checks: list[str] | tuple[str, ...], warnings: list[str] | None = None) -> dict[str, Bounds]:
    out: dict[str, Bounds] = {}
    for check in checks:
        if warnings is not None and re.search(r"\bOR\b", check, re.I):
            warnings.append(f"OR is read as AND in: {check}")
        for name, low, high in BETWEEN.findall(check):
            out.setdefault(name, Bounds()).at_least(Decimal(low))
            out[name].at_most(Decimal(high))
        for name, op, number in COMPARED.findall(check):
            b, x = out.setdefault(name, Bounds()), Decimal(number)
            if op in (">", ">=", "="):
                b.at_least(x, op == ">")
            if op in ("<", "<=", "="):
                b.at_most(x, op == "<")
        for name, listed in ANY.findall(check):
            labels = tuple(re.findall(r"'((?:[^']|'')*)'", listed))
            if labels:
                out.setdefault(name, Bounds()).members = labels
    return out


def as_spark(check: str) -> str:
    """The check in Spark's SQL: casts by :: dropped, = ANY (ARRAY[...]) as IN (...)."""
    plain = re.sub(r"::\w+(?:\s+varying)?(?:\[\])?", "", check)
    return re.sub(r"=\s*ANY\s*\(+\s*ARRAY\s*\[(.*?)\]\s*\)+", r"IN (\1)", plain, flags=re.I | re.S)
