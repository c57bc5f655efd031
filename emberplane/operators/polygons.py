"""Polygons as tables of edges and arrays of corners: exact areas, clipping to a box, filling of cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spatial

CORNER = "struct<x: double, y: double>"


def edges_of_rings(rings: DataFrame, id: str = "id", ring: str = "ring") -> DataFrame:
    """(id, x1, y1, x2, y2) of rings(id, ring: array of corners), closed; holes are further rings of an id."""
    r = F.col(ring)
    pairs = F.zip_with(r, following(r), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return rings.filter(F.size(r) > 0).select(F.col(id).alias("id"), F.explode(pairs).alias("e")).select("id", "e.*")


def condition_edges(spark: SparkSession, conditions: list[tuple[str, list[list[tuple[float, float]]]]]) -> DataFrame:
    """(part, x1, y1, x2, y2) of the polygons of [(how, rings)], numbered from 1."""
    rows = [(k, *map(float, e)) for k, (_, rings) in enumerate(conditions, 1) for ring in rings for e in spatial.edges_of(ring)]
    return spark.createDataFrame(rows, "part int, x1 double, y1 double, x2 double, y2 double")


def in_strips(edges: DataFrame, strip: float) -> DataFrame:
    """Edges that are not level, cut at the strips of a height: with `strip_`, and pointing up."""
    k = F.lit(float(strip))
    up = F.col("y1") < F.col("y2")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    e = edges.filter("y1 <> y2").withColumns({"xa_": pick("x1", "x2"), "ya_": pick("y1", "y2"), "xb_": pick("x2", "x1"), "yb_": pick("y2", "y1")})
    e = e.withColumn("strip_", F.explode(F.sequence(F.floor(F.col("ya_") / k), F.ceil(F.col("yb_") / k) - 1)))
    low, high = F.greatest(F.col("ya_"), F.col("strip_") * k), F.least(F.col("yb_"), (F.col("strip_") + 1) * k)
    at = lambda y: F.when(y == F.col("yb_"), F.col("xb_")).otherwise(F.col("xa_") + (y - F.col("ya_")) * (F.col("xb_") - F.col("xa_")) / (F.col("yb_") - F.col("ya_")))
    rest = [c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    return e.select(*rest, "strip_", at(low).alias("x1"), low.alias("y1"), at(high).alias("x2"), high.alias("y2"))


def strip_area(part: np.ndarray, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, holds: list[bool]) -> float:
    """The area of what lies inside of part 0 and, by `holds`, inside or outside of parts 1, 2, ...

    Between two neighbouring heights at which an edge starts, ends or crosses another one nothing crosses, so the
    pieces between edges are trapezoids: their middle width times their height."""
    if not len(part):
        return 0.0
    x0, y0 = xa.min(), ya.min()
    xa, xb, ya, yb = xa - x0, xb - x0, ya - y0, yb - y0
    slope = (xb - xa) / (yb - ya)
    levels = [ya, yb]
    for k in range(len(part)):  # where edge k meets the later ones
        with np.errstate(divide="ignore", invalid="ignore"):
            y = ((xa[k + 1 :] - slope[k + 1 :] * ya[k + 1 :]) - (xa[k] - slope[k] * ya[k])) / (slope[k] - slope[k + 1 :])
        levels.append(y[np.isfinite(y) & (y > np.maximum(ya[k], ya[k + 1 :])) & (y < np.minimum(yb[k], yb[k + 1 :]))])
    levels = np.unique(np.concatenate(levels))
    total = 0.0
    for low, high in zip(levels[:-1], levels[1:], strict=True):
        y = (low + high) / 2
        live = np.flatnonzero((ya <= low) & (yb >= high))
        x = xa[live] + (y - ya[live]) * slope[live]
        order = np.argsort(x, kind="stable")
        x, own = x[order], part[live][order]
        inside = np.cumsum(own == 0) % 2 == 1
        for k, within in enumerate(holds, 1):
            inside &= (np.cumsum(own == k) % 2 == 1) == within
        total += (high - low) * float((np.diff(x) * inside[:-1]).sum())
    return total


def exact_areas(domains: DataFrame, conditions: list[tuple[str, list[list[tuple[float, float]]]]], strip: float, most_ha: float | None = None) -> DataFrame:
    """domains(id, x1, y1, x2, y2: their edges) to (id, area_ha[, too_large]): what of each lies within polygons ("within",
    "intersects") and outside of others ("outside"), exact.

    Edges are cut into strips of a height; a task sums the trapezoids of one domain in one strip, so a domain with
    very many edges lies in many tasks. Conditions meet only strips in which the domain lies. A domain of no area is 0."""
    for how, _ in conditions:
        if how not in ("within", "intersects", "outside"):
            raise ValueError(f"no spatial condition {how!r}")
    holds = [how != "outside" for how, _ in conditions]
    own = in_strips(domains, strip).withColumn("part", F.lit(0))
    others = in_strips(condition_edges(domains.sparkSession, conditions), strip)
    met = own.select("id", "strip_").distinct().join(others, "strip_")
    kind = domains.schema["id"].dataType.simpleString()

    def summed(key, table):
        a = strip_area(*(table.column(c).to_numpy() for c in ("part", "x1", "y1", "x2", "y2")), holds)
        return pa.table({"id": table.column("id").slice(0, 1), "area": pa.array([a])})

    parts = own.unionByName(met).groupBy("id", "strip_").applyInArrow(summed, f"id {kind}, area double")
    area = parts.groupBy("id").agg((F.sum("area") / 10_000).alias("area_ha"))
    out = domains.select("id").distinct().join(area, "id", "left").withColumn("area_ha", F.coalesce("area_ha", F.lit(0.0)))
    return out if most_ha is None else out.withColumn("too_large", F.col("area_ha") > most_ha)


def beyond(axis: str, sign: int, bound: float) -> Callable[[Column], Column]:
    """What of a ring lies on one side of a line along the other axis (sign 1: above the bound)."""
    other = "y" if axis == "x" else "x"
    none = F.array().cast(f"array<{CORNER}>")

    def inside(p: Column) -> Column:
        return sign * (p[axis] - bound) >= 0

    def crossing(a: Column, b: Column) -> Column:
        at = {axis: F.lit(bound), other: a[other] + (F.lit(bound) - a[axis]) * (b[other] - a[other]) / (b[axis] - a[axis])}
        return F.struct(at["x"].alias("x"), at["y"].alias("y"))

    def kept(a: Column, b: Column) -> Column:
        both = F.when(inside(b), F.array(b)).otherwise(none)
        return F.when(inside(a) == inside(b), both).when(inside(b), F.array(crossing(a, b), b)).otherwise(F.array(crossing(a, b)))

    return lambda ring: F.flatten(F.zip_with(ring, following(ring), kept))


def following(ring: Column) -> Column:
    """The ring from its second corner on, back to the first."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def clipped(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """The corners of what of a ring lies in a box, side by side: each edge keeps its end where that is in, and the place
    where it crosses the side. Empty where nothing does. Parts of a ring with bays stay joined along the box's sides."""
    for side in (("x", 1, float(box[0])), ("x", -1, float(box[2])), ("y", 1, float(box[1])), ("y", -1, float(box[3]))):
        # The array of one gives the ring a name, so that it is not worked out anew for each use.
        ring = F.transform(F.array(ring), beyond(*side))[0]
    return ring


def clip_rings(rings: DataFrame, box: tuple[float, float, float, float], ring: str = "ring") -> DataFrame:
    """rings with their ring cut to a box; those with nothing in it go."""
    fields = F.transform(F.col(ring), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return rings.withColumn(ring, clipped(fields, box)).filter(F.size(ring) > 2)


def filled_cells(edges: DataFrame, cell: float) -> DataFrame:
    """edges(id, x1, y1, x2, y2) of polygons, holes included, to (id, row, col) of the cells (rows north from 0) whose centres
    lie inside, by scanlines: on the line through a row's centres the crossings with edges, in order, bound what is inside
    in pairs. A row of the table before the last step is one line of one polygon."""
    k = F.lit(float(cell))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low / k - 0.5), F.ceil(high / k - 0.5) - 1  # centres in [low, high)
    lines = edges.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    at = F.col("x1") + ((F.col("row") + 0.5) * k - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    spans = lines.select("id", "row", at.alias("x")).groupBy("id", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # the crossings of one line
    spans = spans.withColumn("s", F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1))).select("id", "row", F.col("xs")[F.col("s") * 2].alias("a"), F.col("xs")[F.col("s") * 2 + 1].alias("b"))
    west, east = F.ceil(F.col("a") / k - 0.5), F.ceil(F.col("b") / k - 0.5) - 1
    cells = spans.filter(west <= east).withColumn("col", F.explode(F.sequence(west, east)))
    return cells.select("id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


#: The bands of a fuel type, each with its value on a layer.
BANDS = {"loading": "fuel_loading * percent_cover / 100", "height": "fuel_height", "live_fuel_moisture": "live_fuel_moisture", "dead_fuel_moisture": "dead_fuel_moisture", "heat_of_combustion": "heat_of_combustion"}


def layer_bands(layers: DataFrame, edges: DataFrame, cell: float, how: str = "mean") -> DataFrame:
    """layers(id, fuel_type, fuel_loading, percent_cover, fuel_height, live_fuel_moisture, dead_fuel_moisture, heat_of_combustion) and
    their edges to (row, col, fuel_type) with five bands: layers of one type over a cell are combined by mean, max or min."""
    agg = {"mean": F.avg, "max": F.max, "min": F.min}
    if how not in agg:
        raise ValueError(f"no overlap method {how!r}: one of {sorted(agg)}")
    on = filled_cells(edges, cell).join(layers.select("id", "fuel_type", *(F.expr(v).cast("double").alias(b) for b, v in BANDS.items())), "id")
    return on.groupBy("row", "col", "fuel_type").agg(*(agg[how](b).alias(b) for b in BANDS))
