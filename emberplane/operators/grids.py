"""Lookups, focal operators, resampling and lattices on cell tables (row, col, bands)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

BLOCK = 256


def lookup(cells: DataFrame, code: str, dim: DataFrame, nodata: int | None = None, strict: bool = False, base: int | None = None) -> DataFrame:
    """Attach the columns of dim(code, ...), a fixed model table; nodata codes get nulls. strict: a code that
    the table lacks is an error; with `base`, only one whose code div base is no code's of the table."""
    if strict:
        lost = unknown_codes(cells, code, dim, nodata)
        if base:
            known = dim.select(F.expr(f"{code} DIV {base}").alias("base_")).distinct()
            lost = lost.withColumn("base_", F.expr(f"{code} DIV {base}")).join(F.broadcast(known), "base_", "left_anti")
        some = sorted(r[0] for r in lost.select(code).limit(20).collect())
        if some:
            raise ValueError(f"codes that the table lacks: {some}")
    value = F.col(code) if nodata is None else F.when(F.col(code) != nodata, F.col(code))
    return cells.withColumn(code, value).join(F.broadcast(dim), code, "left")


def unknown_codes(cells: DataFrame, code: str, dim: DataFrame, nodata: int | None = None) -> DataFrame:
    """Distinct codes that the table lacks."""
    have = cells.select(code).distinct().filter(F.col(code).isNotNull())
    return (have if nodata is None else have.filter(F.col(code) != nodata)).join(F.broadcast(dim.select(code)), code, "left_anti")


def bounds(cells: DataFrame) -> tuple[int, int, int, int]:
    """Least and greatest row and col."""
    return tuple(v or 0 for v in cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first())


def focal(cells: DataFrame, value: str, reach: int, work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], made: str, size: tuple[int, int, int, int], present: bool = True) -> DataFrame:
    """(row, col, made...) by `work` on blocks of BLOCK x BLOCK cells and a ring of `reach` cells around.

    A cell goes to its own block and to the few whose ring it lies in, so a shuffle moves little more
    than the table, and a task holds one block at a time, whatever the table's size. work gets the block's
    part of the lattice (size: its least and greatest row and col) as an array, NaN where a cell is missing
    or null, and an array of which cells are there; it returns an array for each column of `made`, in whose
    cells NaN is null. present: only cells that are there are returned, else all of the lattice.
    """
    fields, block = [x.split() for x in made.split(", ")], BLOCK

    def near(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / block).cast("int"), F.floor((F.col(c) + reach) / block).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        br, bc = (table.column(c)[0].as_py() * block for c in ("br_", "bc_"))
        r0, r1, c0, c1 = max(br - reach, size[0]), min(br + block - 1 + reach, size[1]), max(bc - reach, size[2]), min(bc + block - 1 + reach, size[3])
        a, there = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan), np.zeros((r1 - r0 + 1, c1 - c0 + 1), bool)
        table = table.filter(pc.is_valid(table.column("row")))
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        a[row - r0, col - c0] = table.column("value_").to_numpy()
        there[row - r0, col - c0] = True
        out = work(a, there)
        own = np.zeros_like(there)
        own[max(br, size[0]) - r0 : min(br + block - 1, size[1]) - r0 + 1, max(bc, size[2]) - c0 : min(bc + block - 1, size[3]) - c0 + 1] = True
        r, c = np.nonzero(own & there if present else own)
        columns = [pa.array(np.asarray(out[n][r, c], float), pa.float64(), from_pandas=True).cast({"double": pa.float64(), "int": pa.int32(), "boolean": pa.int8()}[t]).cast({"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in fields]
        return pa.table([pa.array((r + r0).astype(np.int32)), pa.array((c + c0).astype(np.int32)), *columns], ["row", "col", *(n for n, _ in fields)])

    last = [F.lit(size[k] // block) for k in (0, 1, 2, 3)]
    dealt = cells.select("row", "col", F.col(value).cast("double").alias("value_")).withColumn("br_", F.explode(near("row"))).withColumn("bc_", F.explode(near("col")))
    dealt = dealt.filter(F.col("br_").between(last[0], last[1]) & F.col("bc_").between(last[2], last[3]))
    if not present:
        # A row without a cell for each block, so that blocks far from any cell are there, too.
        down, across = (size[k + 1] // block - size[k] // block + 1 for k in (0, 2))
        every = cells.sparkSession.range(down * across).select(F.expr(f"CAST(id DIV {across} AS INT)").alias("br_"), F.expr(f"CAST(id % {across} AS INT)").alias("bc_"))
        dealt = dealt.unionByName(every.select(F.col("br_") + last[0], F.col("bc_") + last[2]).toDF("br_", "bc_"), allowMissingColumns=True)
    return dealt.groupBy("br_", "bc_").applyInArrow(run, f"row int, col int, {made}")


def shifted(a: np.ndarray, dr: int, dc: int, fill: float | None = np.nan) -> np.ndarray:
    """a as seen from each cell dr rows and dc columns on; beyond the edge `fill`, or with None the nearest cell."""
    if fill is None:
        return a[np.clip(np.arange(a.shape[0]) + dr, 0, a.shape[0] - 1)][:, np.clip(np.arange(a.shape[1]) + dc, 0, a.shape[1] - 1)]
    out = np.full_like(a, fill)
    r, c = max(0, a.shape[0] - abs(dr)), max(0, a.shape[1] - abs(dc))
    if r and c:
        out[max(-dr, 0) : max(-dr, 0) + r, max(-dc, 0) : max(-dc, 0) + c] = a[max(dr, 0) : max(dr, 0) + r, max(dc, 0) : max(dc, 0) + c]
    return out


def ring(reach: int, circle: bool = False, centre: bool = True) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if (centre or r or c) and (not circle or r * r + c * c <= reach * reach)]


def majority(a: np.ndarray, there: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Per cell the 5x5 window's most frequent value: its own if that is unlisted and no other is more
    frequent, else the most frequent unlisted one (ties: the higher), else its own. Edges repeat the nearest."""
    open_ = ~np.isin(a, listed) & ~np.isnan(a)
    seen, free = ([shifted(x, r, c, None) for r, c in ring(2)] for x in (a, open_))
    count = [(~np.isnan(x)).astype(np.uint8) for x in seen]
    for i, x in enumerate(seen):  # each pair once
        for j in range(i):
            same = x == seen[j]
            count[i] += same
            count[j] += same
    best, rank = a.copy(), np.full(a.shape, -np.inf)
    for x, n, f in zip(seen, count, free, strict=True):
        own_rank = np.where(f, n * 1e9 + x, -np.inf)
        above = own_rank > rank
        best[above], rank[above] = x[above], own_rank[above]
    keep = (count[len(count) // 2] == np.max(count, 0)) & ~np.isin(a, listed) & there
    return np.where(keep, a, best)


def refill_majority(cells: DataFrame, code: str, replace: list[int], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Listed codes by the majority of 5x5 windows. Each round filters the whole working grid; rounds end when
    no listed code is left or none could be replaced; only cells that were listed at first take the result.
    written: makes a copy of a round that outlives its tasks (a written table); copies of earlier rounds are removed."""
    size, listed = bounds(cells), np.array(replace, float)
    work = lambda a, there: {"code_": majority(a, there, listed)}
    now, left = cells.select("row", "col", F.col(code).alias("code_")), cells.filter(F.col(code).isin(replace)).count()
    while left:
        old, now = now, written(focal(now, "code_", 2, work, "code_ int", size))
        files.discard(old)
        was, left = left, now.filter(F.col("code_").isin(replace)).count()
        if left == was:
            break
    out = cells.join(now.withColumnRenamed("code_", "new_"), ["row", "col"], "left")
    return out.withColumn(code, F.when(F.col(code).isin(replace), F.coalesce("new_", code)).otherwise(F.col(code))).drop("new_")


def slope_aspect(dem: DataFrame, z: str, cell: float) -> DataFrame:
    """Degrees, by central differences, one-sided at the lattice's edges; y runs along rows. Null where a
    cell that the difference needs is missing or null."""
    size = bounds(dem)

    def work(a, there):
        out = {}
        for name, axis in (("dx", 1), ("dy", 0)):
            step = (axis == 0, axis == 1)
            after, before = shifted(a, step[0], step[1]), shifted(a, -step[0], -step[1])
            g, n = (after - before) / (2 * cell), a.shape[axis]
            at = lambda k: (k, slice(None)) if axis == 0 else (slice(None), k)  # noqa: B023, E731
            # A block's own ring is one cell wide, so only the lattice's edges are edges of cells that count.
            g[at(0)], g[at(-1)] = ((after - a)[at(0)] / cell, (a - before)[at(-1)] / cell) if n > 1 else (np.nan, np.nan)
            out[name] = g
        return out

    d = focal(dem, z, 1, work, "dx double, dy double", size)
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    aspect = F.degrees(F.atan2(-F.col("dx"), F.col("dy")))
    return d.select("row", "col", slope.alias("slope"), F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect"))


def fill_gaps(cells: DataFrame, value: str, most: int, size: tuple[int, int, int, int] | None = None) -> DataFrame:
    """All cells of the lattice: known ones, and gaps filled ring by ring with the mean of the known cells of
    their 3x3 window (edges repeat the nearest), `most` rings at most; null beyond."""

    def work(a, there):
        a = a.copy()
        for _ in range(most):
            seen = [shifted(a, r, c, None) for r, c in ring(1)]
            known = np.sum([~np.isnan(x) for x in seen], 0)
            fill = np.isnan(a) & (known > 0)
            if not fill.any():
                break
            a[fill] = np.sum([np.nan_to_num(x) for x in seen], 0)[fill] / known[fill]
        return {value: a}

    if size is None and cells.isEmpty():
        return cells.select("row", "col", F.col(value).cast("double").alias(value))
    return focal(cells, value, most + 1, work, f"{value} double", size or bounds(cells), present=False)


def drop_spikes(cells: DataFrame, value: str, reach: int, threshold: float) -> DataFrame:
    """Null where a cell is more than the threshold above all its neighbours (it needs one)."""

    def work(a, there):
        top = np.full_like(a, np.nan)
        for r, c in ring(reach, centre=False):
            top = np.fmax(top, shifted(a, r, c))
        return {value: np.where(a - top > threshold, np.nan, a)}

    return cells.drop(value).join(focal(cells, value, reach, work, f"{value} double", bounds(cells)), ["row", "col"])


def local_maxima(cells: DataFrame, value: str, reach: int, lowest: float, highest: float) -> DataFrame:
    """Cells that are their circular window's highest, between the limits; above the highest counts as 0."""

    def work(a, there):
        v = np.where(there & ~(a <= highest), 0.0, a)
        top = v
        for r, c in ring(reach, circle=True, centre=False):
            top = np.fmax(top, shifted(v, r, c))
        return {value: np.where((v == top) & (v >= lowest), v, np.nan)}

    return focal(cells, value, reach, work, f"{value} double", bounds(cells)).filter(F.col(value).isNotNull())


def variable_maxima(cells: DataFrame, value: str, reach: int, ratio: float, offset: float, cell: float, lowest: float) -> DataFrame:
    """Like local_maxima with a window of height * ratio + offset metres across for each cell."""

    def work(a, there):
        radius, beaten = (a * ratio + offset) / (2 * cell), ~(a >= lowest)
        for r, c in ring(reach, centre=False):
            beaten = beaten | (r * r + c * c <= radius * radius) & (shifted(a, r, c) > a)
        return {value: np.where(beaten, np.nan, a)}

    return focal(cells, value, reach, work, f"{value} double", bounds(cells)).filter(F.col(value).isNotNull())


def bilinear(points: DataFrame, grid: DataFrame, value: str, cell: float, x0: float, y1: float, rows: int, cols: int) -> DataFrame:
    """points(x, y, ...) with `value` between the four cell centres around, clipped at the border.

    The four corners are put in one row per cell first, so that points are joined once."""
    fx, fy = (F.col("x") - x0) / cell - 0.5, (y1 - F.col("y")) / cell - 0.5
    p = points.withColumns({"fx_": F.greatest(F.lit(0.0), F.least(F.lit(cols - 1.0), fx)), "fy_": F.greatest(F.lit(0.0), F.least(F.lit(rows - 1.0), fy))})
    p = p.withColumns({"c_": F.least(F.floor("fx_"), F.lit(cols - 2)).cast("int"), "r_": F.least(F.floor("fy_"), F.lit(rows - 2)).cast("int")})
    p = p.withColumns({"wx_": F.col("fx_") - F.col("c_"), "wy_": F.col("fy_") - F.col("r_")})
    places = [("a_", 0, 0), ("b_", 0, 1), ("d_", 1, 0), ("e_", 1, 1)]
    sent = grid.select(F.col(value).alias("v_"), F.explode(F.array(*(F.struct((F.col("row") - dr).alias("r_"), (F.col("col") - dc).alias("c_"), F.lit(n).alias("n_")) for n, dr, dc in places))).alias("o")).select("v_", "o.*")
    p = p.join(sent.groupBy("r_", "c_").agg(*(F.max(F.when(F.col("n_") == n, F.col("v_"))).alias(n) for n, _, _ in places)), ["r_", "c_"], "left")
    z = (F.col("a_") * (1 - F.col("wx_")) + F.col("b_") * F.col("wx_")) * (1 - F.col("wy_")) + (F.col("d_") * (1 - F.col("wx_")) + F.col("e_") * F.col("wx_")) * F.col("wy_")
    return p.withColumn(value, z).drop("fx_", "fy_", "c_", "r_", "wx_", "wy_", "a_", "b_", "d_", "e_")


@dataclass(frozen=True)
class Lattice:
    """Upper left corner, cell size and number of rows and columns."""

    x0: float
    y1: float
    cell: float
    rows: int
    cols: int


#: Methods that weigh the source cells around a target's centre: how many on each side, and the weight at a distance in cells.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda t: 1 - t),
    "cubic": (2, lambda t: F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).otherwise(-0.5 * t * t * t + 2.5 * t * t - 4 * t + 2)),
    "cubic_spline": (2, lambda t: F.when(t <= 1, (3 * t * t * t - 6 * t * t + 4) / 6).otherwise((2 - t) * (2 - t) * (2 - t) / 6)),
    "lanczos": (3, lambda t: F.when(t == 0, 1.0).otherwise(3 * F.sin(t * math.pi) * F.sin(t * math.pi / 3) / (t * t * math.pi**2))),
}


def method_of(band: str, kind: str, overrides: dict[str, str] | None = None, alignment: str | None = None) -> str:
    """A band's own method, else the alignment's, else nearest for categorical and bilinear for other bands."""
    return (overrides or {}).get(band) or alignment or ("nearest" if kind == "categorical" else "bilinear")


def resample(cells: DataFrame, value: str, source: Lattice, target: Lattice, method: str) -> DataFrame:
    """cells(row, col, value) of one lattice on any other in the same coordinates: (row, col, value) of the
    target cells that get one. nearest and the kernels look from a target's centre (what is missing drops out
    of the weights); other methods take the source cells that a target cell meets, average, sum and rms by
    the share of their area, the rest alike."""
    known = cells.filter(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v_"))
    ratio = target.cell / source.cell
    if method == "nearest" or method in KERNELS:
        reach, weight = KERNELS.get(method, (0, None))
        spots = cells.sparkSession.range(target.rows * target.cols).select(F.expr(f"CAST(id DIV {target.cols} AS INT)").alias("tr_"), F.expr(f"CAST(id % {target.cols} AS INT)").alias("tc_"))
        fx = (F.col("tc_") + 0.5) * ratio + (target.x0 - source.x0) / source.cell
        fy = (F.col("tr_") + 0.5) * ratio + (source.y1 - target.y1) / source.cell
        if method == "nearest":
            return spots.select("tr_", "tc_", F.floor(fy).cast("int").alias("row"), F.floor(fx).cast("int").alias("col")).join(known, ["row", "col"]).select(F.col("tr_").alias("row"), F.col("tc_").alias("col"), F.col("v_").alias(value))
        spots = spots.withColumns({"fx_": fx - 0.5, "fy_": fy - 0.5})
        around = lambda f: F.explode(F.sequence(F.floor(f).cast("int") - (reach - 1), F.floor(f).cast("int") + reach))
        spots = spots.withColumn("row", around("fy_")).withColumn("col", around("fx_"))
        spots = spots.withColumn("w_", weight(F.abs(F.col("fy_") - F.col("row"))) * weight(F.abs(F.col("fx_") - F.col("col"))))
        out = spots.join(known, ["row", "col"]).groupBy(F.col("tr_").alias("row"), F.col("tc_").alias("col"))
        return out.agg(F.try_divide(F.sum(F.col("w_") * F.col("v_")), F.sum("w_")).alias(value)).filter(F.col(value).isNotNull())
    left, top = F.col("col") / ratio + (source.x0 - target.x0) / target.cell, F.col("row") / ratio + (target.y1 - source.y1) / target.cell
    k = known.withColumns({"l_": left, "t_": top})
    met = lambda c: F.explode(F.sequence(F.floor(c).cast("int"), F.ceil(F.col(c) + 1 / ratio).cast("int") - 1))
    k = k.withColumn("tr_", met("t_")).withColumn("tc_", met("l_"))
    share = lambda a, t: F.least(F.col(a) + 1 / ratio, F.col(t) + 1) - F.greatest(F.col(a), F.col(t))
    k = k.withColumn("w_", share("l_", "tc_") * share("t_", "tr_") * (ratio * ratio)).filter((F.col("w_") > 1e-9) & F.col("tr_").between(0, target.rows - 1) & F.col("tc_").between(0, target.cols - 1))
    k = k.select(F.col("tr_").alias("row"), F.col("tc_").alias("col"), "v_", "w_")
    if method == "mode":
        n = k.groupBy("row", "col", "v_").agg(F.round(F.sum("w_"), 9).alias("w_"))
        most = n.groupBy("row", "col").agg(F.max("w_").alias("most_"))
        return n.join(most, ["row", "col"]).filter("w_ = most_").groupBy("row", "col").agg(F.min("v_").alias(value))
    v, w = F.col("v_"), F.col("w_")
    agg = {
        "average": F.sum(v * w) / F.sum(w), "sum": F.sum(v * w), "rms": F.sqrt(F.sum(v * v * w) / F.sum(w)), "min": F.min(v), "max": F.max(v),
        "median": F.percentile(v, F.lit(0.5)), "q1": F.percentile(v, F.lit(0.25)), "q3": F.percentile(v, F.lit(0.75)),
    }[method]
    return k.groupBy("row", "col").agg(agg.alias(value))


def resample_down(cells: DataFrame, value: str, times: int, method: str) -> DataFrame:
    """Cells `times` as large, by average, sum, min, max, median, q1, q3, rms or mode (ties: the lower)."""
    key = [F.expr(f"CAST(floor(CAST({c} AS DOUBLE) / {times}) AS INT)").alias(c) for c in ("row", "col")]
    v = F.col(value)
    if method == "mode":
        n = cells.filter(v.isNotNull()).groupBy(*key, v.alias(value)).agg(F.count("*").alias("k"))
        return n.groupBy("row", "col").agg(F.max(F.struct("k", (-v).alias("m"))).alias("b")).select("row", "col", (-F.col("b.m")).alias(value))
    agg = {"average": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "rms": F.sqrt(F.avg(v * v)), "median": F.percentile(v, F.lit(0.5)), "q1": F.percentile(v, F.lit(0.25)), "q3": F.percentile(v, F.lit(0.75))}[method]
    return cells.groupBy(*key).agg(agg.alias(value))


def mosaic(tiles: DataFrame, value: str) -> DataFrame:
    """tiles(seq, row, col, value): per cell the first tile's value that is there."""
    return tiles.filter(F.col(value).isNotNull()).groupBy("row", "col").agg(F.min_by(value, "seq").alias(value))


def bare_ground(cells: DataFrame, value: str, cell: float, windows: tuple[int, ...] = (3, 5, 9, 17, 33), slope: float = 1.0, least: float = 0.15, most: float = 2.5) -> DataFrame:
    """(row, col, ground): the surface opened by ever wider windows. An opening is taken where it lowers the
    surface by more than the window's tolerance, so that a wide window doesn't flatten a ridge. Missing
    cells take no part."""

    def extreme(a, reach, best, none):
        a = np.where(np.isnan(a), none, a)
        for dr, dc in ((1, 0), (0, 1)):
            seen = [shifted(a, k * dr, k * dc, none) for k in range(-reach, reach + 1)]
            a = best.reduce(seen)
        return a

    def work(a, there):
        ground, before = a.copy(), 1
        for w in windows:
            limit = least if w <= 3 else min(slope * (w - before) * cell + least, most)
            low = np.where(np.isnan(ground), np.nan, extreme(ground, w // 2, np.minimum, np.inf))
            opened = extreme(low, w // 2, np.maximum, -np.inf)
            ground, before = np.where(ground - opened > limit, opened, ground), w
        return {"ground": ground}

    return focal(cells, value, sum(w - 1 for w in windows), work, "ground double", bounds(cells))


def distance_to_known(cells: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """cells(row, col) with the distance in cells to the nearest known one, `cap` where none is nearer."""
    both = cells.select("row", "col").join(known.select("row", "col").distinct().withColumn("k_", F.lit(1.0)), ["row", "col"], "left")

    def work(a, there):
        far = float(2 * cap + 2)
        along = np.where(np.isnan(a), far, 0.0)
        for k in range(1, cap + 1):
            along = np.minimum(along, np.minimum(shifted(np.where(np.isnan(a), far, 0.0), 0, k, far), shifted(np.where(np.isnan(a), far, 0.0), 0, -k, far)) + k)
        best = along * along
        for k in range(1, cap + 1):
            best = np.minimum(best, np.minimum(shifted(along * along, k, 0, far * far), shifted(along * along, -k, 0, far * far)) + k * k)
        return {"distance": np.minimum(np.sqrt(best), float(cap))}

    return focal(both, "k_", cap, work, "distance double", bounds(both))


def plot_surface(cells: DataFrame, plot: str, lattice: Lattice, nodata: int | None = None) -> DataFrame:
    """(row, col, x, y, plot_id): a plot at the centre of every cell of the lattice. Cells that are missing,
    null or nodata are plots 0 without stems, so that nothing spreads over empty ground."""
    own = cells.select("row", "col", (F.col(plot) if nodata is None else F.when(F.col(plot) != nodata, F.col(plot))).alias("plot_"))
    every = cells.sparkSession.range(lattice.rows * lattice.cols).select(F.expr(f"CAST(id DIV {lattice.cols} AS INT)").alias("row"), F.expr(f"CAST(id % {lattice.cols} AS INT)").alias("col"))
    x, y = lattice.x0 + (F.col("col") + 0.5) * lattice.cell, lattice.y1 - (F.col("row") + 0.5) * lattice.cell
    return every.join(own, ["row", "col"], "left").select("row", "col", x.alias("x"), y.alias("y"), F.coalesce("plot_", F.lit(0)).cast("int").alias("plot_id"))


def nearest_plot(stems: DataFrame, surface: DataFrame, lattice: Lattice) -> DataFrame:
    """stems(x, y, ...) with the plot_id of the nearest plot of plot_surface and the distance to it. Every cell
    has its plot at the centre, so the nearest is that of a stem's own cell: an equi-join. A stem on the lattice's
    edge or up to a cell beyond takes the nearest cell at the edge; those farther out have no plot."""
    row, col = F.floor((F.lit(lattice.y1) - F.col("y")) / lattice.cell).cast("int"), F.floor((F.col("x") - lattice.x0) / lattice.cell).cast("int")
    held = lambda c, n: F.when(c.between(-1, n), F.greatest(F.lit(0), F.least(F.lit(n - 1), c)))
    own = {"row": held(row, lattice.rows), "col": held(col, lattice.cols)}
    p = surface.select("row", "col", F.col("x").alias("px_"), F.col("y").alias("py_"), "plot_id")
    far = F.sqrt((F.col("x") - F.col("px_")) * (F.col("x") - F.col("px_")) + (F.col("y") - F.col("py_")) * (F.col("y") - F.col("py_")))
    return stems.withColumns(own).join(p, ["row", "col"]).withColumn("distance", far).drop("row", "col", "px_", "py_")
