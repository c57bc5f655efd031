"""Fuel-model labels and codes, band keys, weeks, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First code and number of models of each group of the forty fuel models.
GROUPS = {"NB": (91, (1, 2, 3, 8, 9)), "GR": (101, range(1, 10)), "GS": (121, range(1, 5)), "SH": (141, range(1, 10)), "TU": (161, range(1, 6)), "TL": (181, range(1, 10)), "SB": (201, range(1, 5))}


def fuel_codes() -> dict[str, int]:
    """Label -> code, such as GR1 -> 101."""
    return {f"{g}{k}": first + k - 1 for g, (first, members) in GROUPS.items() for k in members}


def code_of(label: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fuel_codes().items() for x in pair))
    return F.try_element_at(table, F.upper(F.trim(label)))


def label_of(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in fuel_codes().items() for x in (v, k)))
    return F.try_element_at(table, code)


def band_key(column: Column) -> Column:
    """`fuel_load_1hr` -> `fuel_load.1hr`: the last underscore splits the class from the variable."""
    return F.regexp_replace(column, "_([^_]+)$", ".$1")


def iso_week(ts: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def next_week(ts: Column) -> Column:
    return F.date_trunc("week", ts) + F.expr("INTERVAL 7 DAYS")
