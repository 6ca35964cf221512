"""Version constraints: expressions to intervals. A query's own few expressions are parsed on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from theoremill.operators.audits import in_range, version_key

_PART = re.compile(r'\s*(?:(>=|<=|!=|=|>|<)\s*"?([\w.+~-]+)"?|(&|\|)|(\()|(\)))')


@dataclass(frozen=True)
class Interval:
    """Versions between two bounds; a bound of None is open."""

    low: str | None = None
    low_in: bool = True
    high: str | None = None
    high_in: bool = True


def parse_constraint(text: str) -> list[Interval]:
    """Intervals whose union satisfies ``text``: comparisons joined by & (binds tighter) and |, with brackets.
    An empty text allows all; malformed ones raise ValueError."""
    parts, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"no version constraint: {text[at:]}")
        parts.append(m)
        at = m.end()

    def either(k: int) -> tuple[list[Interval], int]:
        out, k = both(k)
        while k < len(parts) and parts[k][3] == "|":
            more, k = both(k + 1)
            out = out + more
        return out, k

    def both(k: int) -> tuple[list[Interval], int]:
        out, k = one(k)
        while k < len(parts) and parts[k][3] == "&":
            more, k = one(k + 1)
            out = [i for a in out for b in more for i in [_meet(a, b)]]
        return out, k

    def one(k: int) -> tuple[list[Interval], int]:
        if k >= len(parts):
            raise ValueError("a comparison is missing")
        m = parts[k]
        if m[4]:
            out, k = either(k + 1)
            if k >= len(parts) or not parts[k][5]:
                raise ValueError("a bracket is missing")
            return out, k + 1
        sign, version = m[1], m[2]
        if not sign:
            raise ValueError("a comparison is missing")
        made = {
            "=": [Interval(version, True, version, True)],
            ">=": [Interval(low=version)],
            ">": [Interval(low=version, low_in=False)],
            "<=": [Interval(high=version)],
            "<": [Interval(high=version, high_in=False)],
            "!=": [Interval(high=version, high_in=False), Interval(low=version, low_in=False)],
        }
        return made[sign], k + 1

    if not parts:
        return [Interval()]
    out, end = either(0)
    if end != len(parts):
        raise ValueError("unexpected bracket or comparison")
    return out


def _key(version: str) -> tuple:
    """Orders versions as audits.version_key does."""
    code = {"~": (0, 0, ""), "+": (2, 0, "")}
    return (*[code.get(p) or ((4, int(p), "") if p.isdigit() else (3, 0, p)) for p in re.findall(r"\d+|[A-Za-z]+|[~+]", version)], (1, 0, ""))


def _meet(a: Interval, b: Interval) -> Interval:
    """The intersection; it may be empty."""
    low = max([(_key(i.low), not i.low_in, i) for i in (a, b) if i.low is not None], key=lambda x: x[:2], default=None)
    high = min([(_key(i.high), i.high_in, i) for i in (a, b) if i.high is not None], key=lambda x: x[:2], default=None)
    return Interval(low and low[2].low, low[2].low_in if low else True, high and high[2].high, high[2].high_in if high else True)


def satisfies(version: Column, intervals: list[Interval]) -> Column:
    """Whether a version lies in any of the intervals."""
    key, out = version_key(version), F.lit(False)
    bound = lambda v: F.lit(None).cast("string") if v is None else version_key(F.lit(v))
    for i in intervals:
        out = out | in_range(key, bound(i.low), F.lit(i.low_in), bound(i.high), F.lit(i.high_in))
    return out
