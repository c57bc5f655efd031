"""Reprojection of many points by a quadratic per tile, where that stays within a tolerance of the exact map."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

Map = Callable[[Column, Column], tuple[Column, Column]]
FIT, CHECK = 5, 11  # nodes across a tile for the fit and, in other places too, for its check
MOST = 100_000  # tiles whose fits are broadcast; more are joined by a shuffle


def terms(u: Column, v: Column) -> list[Column]:
    return [F.lit(1.0), u, v, u * u, u * v, v * v]


def nodes(tiles: DataFrame, across: int) -> DataFrame:
    """tiles(tile, x0, y0, half) with a row per node: its number, (u, v) in [-1, 1] and its place."""
    out = tiles.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(across * across - 1))))
    unit = lambda k: k * (2.0 / (across - 1)) - 1.0
    out = out.withColumns({"u": unit(F.col("node") % across), "v": unit(F.floor(F.col("node") / across))})
    return out.withColumns({"x": F.col("x0") + F.col("u") * F.col("half"), "y": F.col("y0") + F.col("v") * F.col("half")})


def fitted(tiles: DataFrame, exact: Map, tolerance: float) -> DataFrame:
    """tiles(tile, x0, y0, half) with `fit_`: the coefficients of both quadratics, null where they miss the exact map by more than
    the tolerance at a node of the check, or where it has no finite value.

    All tiles have the same nodes in (u, v), so a coefficient is a fixed weighted sum of the nodes' values: one aggregation."""
    axis = np.linspace(-1, 1, FIT)
    u, v = axis[np.arange(FIT * FIT) % FIT], axis[np.arange(FIT * FIT) // FIT]
    weights = np.linalg.pinv(np.stack([np.ones(u.size), u, v, u * u, u * v, v * v], axis=1))
    at = nodes(tiles, FIT)
    px, py = exact(F.col("x"), F.col("y"))
    at = at.withColumns({"px": px, "py": py})
    # Values are taken from the first node's, so that sums keep their digits.
    base = at.filter("node = 0").select("tile", F.col("px").alias("bx"), F.col("py").alias("by"))
    weight = lambda j: F.element_at(F.array(*map(F.lit, weights[j].tolist())), F.col("node") + 1)
    sums = [F.sum(weight(j) * (F.col(p) - F.col(b))).alias(f"{p[1]}{j}_") for p, b in (("px", "bx"), ("py", "by")) for j in range(6)]
    fit = at.join(base, "tile").groupBy("tile", "x0", "y0", "half", "bx", "by").agg(*sums)
    fit = fit.withColumn("fit_", F.struct("x0", "y0", "half", "bx", "by", *(f"{c}{j}_" for c in "xy" for j in range(6))))
    check = nodes(fit, CHECK)
    gx, gy = evaluated(F.col("fit_"), F.col("u"), F.col("v"))
    px, py = exact(F.col("x"), F.col("y"))
    miss = F.sqrt((gx - px) * (gx - px) + (gy - py) * (gy - py))
    good = check.groupBy("tile").agg(F.bool_and(F.coalesce((miss <= tolerance) & ~F.isnan(miss), F.lit(False))).alias("good"))
    return fit.join(good, "tile").select("tile", F.when(F.col("good"), F.col("fit_")).alias("fit_"))


def evaluated(fit: Column, u: Column, v: Column) -> tuple[Column, Column]:
    own = lambda c: sum((fit[f"{c}{j}_"] * t for j, t in enumerate(terms(u, v)) if j), fit[f"{c}0_"])
    return fit["bx"] + own("x"), fit["by"] + own("y")


def reprojected(points: DataFrame, tile: Column, exact: Map, tolerance: float = 1e-4) -> DataFrame:
    """points(x, y) with px, py by the quadratic of their tile, by the exact map where a tile's fails (or has a single place), and
    `approximated`, which of the two it was. A tile is the square around its own points, so none is extrapolated."""
    p = points.withColumn("tile", tile)
    ends = p.groupBy("tile").agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    half = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) / 2
    tiles = ends.select("tile", ((F.col("minx") + F.col("maxx")) / 2).alias("x0"), ((F.col("miny") + F.col("maxy")) / 2).alias("y0"), half.alias("half")).filter("half > 0 AND NOT isnan(half)")
    fits = files.written(fitted(tiles, exact, tolerance), "fits")
    p = p.join(F.broadcast(fits) if fits.count() <= MOST else fits, "tile", "left")
    fit = F.col("fit_")
    gx, gy = evaluated(fit, (F.col("x") - fit["x0"]) / fit["half"], (F.col("y") - fit["y0"]) / fit["half"])
    # The exact map of null is null, and greatest skips nulls: both coordinates are made side by side, so that what they share
    # is computed once, which Spark does not do within the branches of a condition.
    px, py = exact(*(F.when(fit.isNull(), F.col(c)) for c in "xy"))
    return p.withColumns({"px": F.greatest(gx, px), "py": F.greatest(gy, py), "approximated": fit.isNotNull()}).drop("fit_")
