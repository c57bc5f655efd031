"""Which datasets to read for a region, and the part of it that each contributes.

A region is a set of equal cells; `held(cell, name)` says which of them lie in a dataset's footprint and
`catalogue(name, density)` names all datasets there are. A cell goes to the first chosen dataset that holds it,
so contributions are disjoint and their shares add up to the coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import spatial

# The share of a region from which one dataset alone will do, and the least share worth a dataset.
COMPLETE, ENOUGH = 0.99, 1e-4


class UnknownDataset(ValueError):
    """A pinned name that the catalogue does not have."""


class OutsideRegion(ValueError):
    """A pinned dataset that holds no cell of the region."""


def in_order(chosen: DataFrame) -> DataFrame:
    """chosen(name, density, n) of spatial.greedy_choice with `place`, 0 for the first."""
    return files.numbered(chosen, [], [F.desc("n"), F.desc("density"), F.desc("name")], "place")


def automatic(held: DataFrame, catalogue: DataFrame, total: int, complete: float = COMPLETE, enough: float = ENOUGH) -> DataFrame:
    """(name, place): the densest of the datasets that hold nearly all of the region (ties: the greater name),
    else one after the other by what it adds."""
    whole = held.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= complete * total).join(catalogue, "name")
    best = whole.agg(F.max(F.struct("density", "name")).alias("b")).select("b.name").first()[0]  # null densities last
    if best is not None:
        return held.sparkSession.createDataFrame([(best, 0)], "name string, place long")
    return in_order(spatial.greedy_choice(held, catalogue, enough, total)).select("name", "place")


def pinned(held: DataFrame, catalogue: DataFrame, pins: list[str], total: int, enough: float = ENOUGH) -> DataFrame:
    """(name, place): the pinned names in the order given. One that adds less than a share `enough` of the region to
    those before it is left out; when less than that is uncovered, the rest are."""
    spark = held.sparkSession
    order = spark.createDataFrame([(n, k) for k, n in enumerate(pins)], "name string, place long")
    known = {r.name for r in F.broadcast(order).join(catalogue, "name", "left_semi").collect()}  # of the pins given
    lost = [n for n in pins if n not in known]
    if lost:
        raise UnknownDataset(f"{lost[0]} is not in the catalogue")
    # Cells with the same pins over them are one row; what a pin adds is a sum over these.
    sets = held.join(F.broadcast(order), "name").groupBy("cell").agg(F.array_sort(F.collect_list("place")).alias("places")).groupBy("places").agg(F.count("*").alias("n"))
    sets = files.written(sets, "pins")
    met = {r.place for r in sets.select(F.explode("places").alias("place")).distinct().collect()}
    outside = [n for k, n in enumerate(pins) if k not in met]
    if outside:
        raise OutsideRegion(f"{outside[0]} holds no cell of the region")
    chosen, left = [], total
    for k, name in enumerate(pins):
        if left < enough * total:
            break
        own = F.array_contains("places", F.lit(k).cast("long"))
        taken = F.arrays_overlap("places", F.array(*(F.lit(c).cast("long") for c, _ in chosen))) if chosen else F.lit(False)
        adds = sets.filter(own & ~taken).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if adds and adds >= enough * total:
            chosen.append((k, name))
            left -= adds
    return spark.createDataFrame([(n, k) for k, (_, n) in enumerate(chosen)], "name string, place long")


def contributions(held: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cell, name, place): each covered cell once, under the first chosen dataset that holds it."""
    return held.join(chosen, "name").groupBy("cell").agg(F.min(F.struct("place", "name")).alias("f")).select("cell", "f.name", "f.place")


def select_datasets(region: DataFrame, held: DataFrame, catalogue: DataFrame, cell_area: float, pins: list[str] | None = None, complete: float = COMPLETE, enough: float = ENOUGH) -> DataFrame:
    """(name, place, cells, share, density, expected_points) of the datasets chosen for region(cell): with pins those,
    in their order, else by coverage. Nothing covers the region: no rows."""
    total = region.count()
    if pins:  # no other name is asked for below
        held = held.filter(F.col("name").isin(pins))
    own = files.written(held.select("cell", "name").distinct().join(region.select("cell").distinct(), "cell", "left_semi"), "held")
    names = catalogue.select("name", F.col("density").cast("double").alias("density"))
    chosen = pinned(own, names, pins, total, enough) if pins else automatic(own, names, total, complete, enough)
    parts = contributions(own, chosen).groupBy("name", "place").agg(F.count("*").alias("cells")).join(names, "name")
    return parts.select("name", "place", "cells", (F.col("cells") / F.lit(total)).alias("share"), "density", F.floor(F.col("density") * F.col("cells") * F.lit(cell_area)).cast("long").alias("expected_points"))


def coverage_share(selection: DataFrame) -> DataFrame:
    """One row: the share of the region that the selection covers, and all expected points."""
    return selection.agg(F.least(F.lit(1.0), F.round(F.coalesce(F.sum("share"), F.lit(0.0)), 6)).alias("covered"), F.coalesce(F.sum("expected_points"), F.lit(0)).alias("expected_points"))
