"""Unit conversion with factors folded into the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> (dimension as length and mass exponents, factor to metre and kilogram).
UNITS = {
    "1": ((0, 0), 1.0),
    "percent": ((0, 0), 0.01),
    "m": ((1, 0), 1.0),
    "cm": ((1, 0), 0.01),
    "mm": ((1, 0), 0.001),
    "km": ((1, 0), 1000.0),
    "in": ((1, 0), 0.0254),
    "ft": ((1, 0), 0.3048),
    "m2": ((2, 0), 1.0),
    "ha": ((2, 0), 10000.0),
    "acre": ((2, 0), 4046.8564224),
    "ft2": ((2, 0), 0.09290304),
    "kg": ((0, 1), 1.0),
    "short_ton": ((0, 1), 907.18474),
    "lb": ((0, 1), 0.45359237),
}


def parse(unit: str) -> tuple[tuple[int, int], float]:
    """Dimension and factor of a unit such as `ft2/acre` or `1/ft`."""
    over, _, under = unit.partition("/")
    if over not in UNITS or under and under not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    (a, b), f = UNITS[over]
    (c, d), g = UNITS[under or "1"]
    return (a - c, b - d), f / g


def factor(source: str, target: str) -> float:
    """What a value in `source` is multiplied by to be in `target`."""
    (dim, f), (want, g) = parse(source), parse(target)
    if dim != want:
        raise ValueError(f"{source!r} and {target!r} measure different things")
    return f / g


def convert(value: Column, source: str, target: str) -> Column:
    return value if source == target else value * F.lit(factor(source, target))


def added(a: tuple[Column, str], b: tuple[Column, str], out: str) -> Column:
    """A sum in the unit `out`; each operand is converted first."""
    return convert(*a, out) + convert(*b, out)


def product(a: tuple[Column, str], b: tuple[Column, str], out: str, divide: bool = False) -> Column:
    """A product (or quotient) in the unit `out`: one factor, by the units of both operands."""
    (d1, f1), (d2, f2), (want, g) = parse(a[1]), parse(b[1]), parse(out)
    sign = -1 if divide else 1
    if tuple(x + sign * y for x, y in zip(d1, d2)) != want:
        raise ValueError(f"{a[1]!r} and {b[1]!r} do not give {out!r}")
    value = F.try_divide(a[0], b[0]) if divide else a[0] * b[0]
    return value * F.lit(f1 * f2**sign / g)
