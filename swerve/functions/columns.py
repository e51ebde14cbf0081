"""Column functions: labels, rules, angles, clocks, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(c: Column, lo: float, hi: float) -> Column:
    """Left-closed, right-open."""
    return (c >= lo) & (c < hi)


def band(c: Column, edges: list[float], names: list[str] | None = None) -> Column:
    """Left-closed band label; the last edge opens a band without end; below the first there is none."""
    names = names or [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)] + [f"{edges[-1]:g}+"]
    out = F.when(c >= edges[-1], names[-1])
    for k in range(len(edges) - 2, -1, -1):
        out = out.when(c >= edges[k], names[k])
    return out


def axis_index(c: Column, edges: list[float]) -> Column:
    """Bin number of a value on an axis whose last bin is right-open; -1 outside."""
    out = F.when(c.isNull() | (c < edges[0]) | (c >= edges[-1]), -1)
    for k in range(1, len(edges)):
        out = out.when(c < edges[k], k - 1)
    return out


def first_rule(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first rule that holds; a rule that is null doesn't hold."""
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return out.otherwise(default) if default is not None else out


def tri_state(c: Column) -> Column:
    """true, false or null from text; nothing else becomes false."""
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(c, F.lit(hi))))


def clock_seconds(c: Column) -> Column:
    """MM:SS or H:MM:SS as seconds; null for anything else."""
    p = F.split(c, ":")
    n = lambda k: F.get(p, F.lit(k)).try_cast("int")
    return F.when(F.size(p) == 2, n(0) * 60 + n(1)).when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))


def elapsed(quarter: Column, clock: Column) -> Column:
    """Seconds of the game that have run; from the fifth quarter on, overtime of 600 s."""
    return F.when(quarter >= 5, 3600 + (quarter - 5) * 600 + 600 - clock).otherwise((quarter - 1) * 900 + 900 - clock)


def wrap(deg: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def heading(vx: Column, vy: Column) -> Column:
    """Degrees, 0 along +y, clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(vx, vy)), F.lit(360.0))


def ratio(n: Column, d: Column, eps: float = 1e-9) -> Column:
    return F.when(F.abs(d) > eps, n / d)


def name_key(c: Column) -> Column:
    """Surname: lower-case letters of the last part that is no generational suffix."""
    parts = F.filter(F.split(F.lower(c), " "), lambda p: ~p.isin("jr", "sr", "ii", "iii", "iv", ""))
    return F.regexp_replace(F.element_at(parts, -1), "[^a-z]", "")


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) fixed by the given values."""
    cols = [p if isinstance(p, Column) else F.lit(p) if isinstance(p, int) else F.col(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)
