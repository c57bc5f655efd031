"""Predicates, rule-based edits and band algebra as Column expressions.

A missing value never matches, except that `ne` matches it for tree attributes; grid conditions
exclude missing cells throughout (nodata_excluded).
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import factor

COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "lt": "__lt__", "ge": "__ge__", "le": "__le__"}
LIMITS = {"dbh": (0.0, None), "height": (0.0, None), "crown_ratio": (0.0, 1.0)}


@dataclass(frozen=True)
class Condition:
    """attribute operator value; value a number or, for eq, ne and in, a list; unit of the value, if it isn't the column's."""

    attribute: str
    operator: str
    value: object
    unit: str | None = None
    column_unit: str | None = None


@dataclass(frozen=True)
class Action:
    attribute: str
    modifier: str
    value: float | None = None


@dataclass(frozen=True)
class Rule:
    actions: tuple[Action, ...]
    conditions: tuple[Condition, ...] = field(default=())


def predicate(c: Condition, nodata_excluded: bool = False) -> Column:
    col, value = F.col(c.attribute), c.value
    if c.unit and c.column_unit and c.unit != c.column_unit:
        k = factor(c.unit, c.column_unit)
        value = [v * k for v in value] if isinstance(value, list | tuple) else value * k
    if isinstance(value, list | tuple):
        if c.operator not in ("eq", "ne", "in"):
            raise ValueError(f"a list of values needs eq, ne or in, not {c.operator}")
        test = ~col.isin(*value) if c.operator == "ne" else col.isin(*value)
    else:
        test = getattr(col, COMPARE[c.operator])(F.lit(value))
    return F.coalesce(test, F.lit(c.operator == "ne" and not nodata_excluded))


def expression(text: str, allowed: tuple[str, ...] = ("dbh", "height", "crown_ratio")) -> Column:
    """Boolean text over the allowed names: comparisons, and/or/not, arithmetic; no calls, no attributes."""
    tree = ast.parse(text, mode="eval")
    ok = (ast.Expression, ast.BoolOp, ast.BinOp, ast.UnaryOp, ast.Compare, ast.Name, ast.Constant, ast.Load, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
    for node in ast.walk(tree):
        if not isinstance(node, ok) or isinstance(node, ast.Name) and node.id not in allowed or isinstance(node, ast.Constant) and not isinstance(node.value, int | float):
            raise ValueError(f"not allowed in an expression: {ast.dump(node)[:60]}")
    ops = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}

    def sql(n) -> str:
        if isinstance(n, ast.BoolOp):
            return "(" + (" AND " if isinstance(n.op, ast.And) else " OR ").join(map(sql, n.values)) + ")"
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, ast.BitAnd | ast.BitOr):
                return f"({sql(n.left)} {'AND' if isinstance(n.op, ast.BitAnd) else 'OR'} {sql(n.right)})"
            return f"({sql(n.left)} {ops[type(n.op)]} {sql(n.right)})"
        if isinstance(n, ast.UnaryOp):
            return f"({'NOT' if isinstance(n.op, ast.Not | ast.Invert) else '-'} {sql(n.operand)})"
        if isinstance(n, ast.Compare):
            sides = [n.left, *n.comparators]
            return "(" + " AND ".join(f"{sql(a)} {ops[type(o)]} {sql(b)}" for a, o, b in zip(sides, n.ops, sides[1:])) + ")"
        return n.id if isinstance(n, ast.Name) else f"CAST({n.value!r} AS DOUBLE)"

    return F.coalesce(F.expr(sql(tree.body)), F.lit(False))


def mask(conditions, default: bool, nodata_excluded: bool = False) -> Column:
    """All conditions; without any, `default` (trees: all rows, grids: none)."""
    return reduce(lambda a, b: a & b, (predicate(c, nodata_excluded) for c in conditions)) if conditions else F.lit(default)


def _changed(col: Column, a: Action) -> Column:
    v = F.lit(a.value)
    return {"replace": v, "multiply": col * v, "divide": col / v, "add": col + v, "subtract": col - v}[a.modifier]


def edit_trees(df: DataFrame, rules) -> DataFrame:
    """Rules in order, each seeing the last one's result. `remove` drops the masked rows; other actions
    change masked rows and clamp those to the attribute's limits."""
    for rule in rules:
        if [a.modifier for a in rule.actions] == ["remove"]:
            df = df.filter(~mask(rule.conditions, True))
            continue
        df = df.withColumn("mask_", mask(rule.conditions, True))
        for a in rule.actions:
            low, high = LIMITS.get(a.attribute, (None, None))
            new = _changed(F.col(a.attribute), a)
            new = new if low is None else F.when(new < low, F.lit(low)).otherwise(new)
            new = new if high is None else F.when(new > high, F.lit(high)).otherwise(new)
            df = df.withColumn(a.attribute, F.when(F.col("mask_"), new).otherwise(F.col(a.attribute)))
        df = df.drop("mask_")
    return df


def edit_cells(df: DataFrame, rules) -> DataFrame:
    """As edit_trees for bands: clamped at 0 unless replaced; rules without conditions change nothing."""
    for rule in rules:
        df = df.withColumn("mask_", mask(rule.conditions, False))
        for a in rule.actions:
            new = _changed(F.col(a.attribute), a)
            new = new if a.modifier == "replace" else F.when(new < 0, F.lit(0.0)).otherwise(new)
            df = df.withColumn(a.attribute, F.when(F.col("mask_"), new).otherwise(F.col(a.attribute)))
        df = df.drop("mask_")
    return df


def compute(op: str, *bands: Column) -> Column:
    """Band algebra: any missing operand makes a missing result; division by zero gives missing."""
    present = reduce(lambda a, b: a & b, (b.isNotNull() for b in bands))
    total = reduce(lambda a, b: a + b, bands)
    made = {
        "add": lambda: total,
        "subtract": lambda: bands[0] - bands[1],
        "multiply": lambda: reduce(lambda a, b: a * b, bands),
        "divide": lambda: F.try_divide(bands[0], bands[1]),
        "average": lambda: total / F.lit(float(len(bands))),
        "max": lambda: F.greatest(*bands),
        "min": lambda: F.least(*bands),
    }[op]()
    return F.when(present, made)


def checked(value: Column, used: Column) -> Column:
    """Raises where a used cell is infinite or NaN."""
    bad = used & (F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
    return F.when(bad, F.raise_error(F.lit("a computed cell is not finite"))).otherwise(value)


def guarded(op: str, *bands: Column, used: Column | None = None, otherwise: Column | None = None) -> Column:
    """Band algebra where `used` holds (all cells without it), `otherwise` elsewhere. A used cell whose operands
    are there must come out finite: a zero denominator, an infinity or NaN raises; one that the conditions
    exclude never does."""
    used = F.lit(True) if used is None else F.coalesce(used, F.lit(False))
    present = reduce(lambda a, b: a & b, (b.isNotNull() for b in bands))
    value = compute(op, *bands).cast("double")
    lost = used & present & value.isNull()  # a division by zero
    value = F.when(lost, F.raise_error(F.lit("a computed cell is not finite"))).otherwise(checked(value, used))
    return F.when(used, value).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)


def descaled(value: Column, nodata: float, scale: float) -> Column:
    """Stored integers to values; the declared nodata and -9999 are missing."""
    return F.when(~value.isin(nodata, -9999), value / F.lit(float(scale)))


def value_of(value) -> Column:
    """What `else` gives: a number or text, {"band": name}, {"label": a fuel label} or {"op": ..., "of": [values]}."""
    if not isinstance(value, dict):
        return F.lit(value)
    if "band" in value:
        return F.col(value["band"])
    return F.lit(value["label"]) if "label" in value else compute(value["op"], *map(value_of, value["of"]))


def uniform(cells: DataFrame, bands: dict[str, int | float]) -> DataFrame:
    """Constant bands: whole numbers as int, others as float."""
    return cells.withColumns({k: F.lit(v).cast("int" if isinstance(v, int) else "float") for k, v in bands.items()})


def apply_pending(df: DataFrame, ledger: DataFrame, attribute: str) -> tuple[DataFrame, DataFrame]:
    """Rules of ledger(seq, status, modifier, value) that are pending, in their order; and the ledger with them
    applied, to be appended once the edited table is written. A rule is never applied twice."""
    pending = ledger.filter("status = 'pending'").orderBy("seq").collect()  # a handful of rules, not data
    out = edit_trees(df, [Rule((Action(attribute, r["modifier"], r["value"]),)) for r in pending])
    return out, ledger.withColumn("status", F.when(F.col("status") == "pending", "applied").otherwise(F.col("status")))
