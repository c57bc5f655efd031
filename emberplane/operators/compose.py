"""Grids with their lattices: checked joins of cells, crops, bands for export, the input stack of a fire model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import Lattice


class Misaligned(ValueError):
    """Grids whose cells are not the same places."""


@dataclass(frozen=True)
class Grid:
    """cells(row, col, bands), where they lie, and the reference system of that."""

    cells: DataFrame
    lattice: Lattice
    crs: str | None

    @property
    def bands(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("row", "col")]


def check_aligned(grids: dict[str, Grid]) -> None:
    """All grids have a reference system, the same one, the same shape and the same place (to 1e-9); bands, and two dimensions."""
    for name, g in grids.items():
        if not g.bands:
            raise Misaligned(f"{name} has no bands")
        if "k" in g.cells.columns:
            raise Misaligned(f"{name} has layers; only grids of two dimensions are composed")
    first = next(iter(grids.values()))
    for name, g in grids.items():
        if g.crs is None or g.crs != first.crs:
            raise Misaligned(f"{name} has another reference system" if g.crs else f"{name} has no reference system")
        if (g.lattice.rows, g.lattice.cols) != (first.lattice.rows, first.lattice.cols):
            raise Misaligned(f"{name} has another shape")
        if any(abs(getattr(g.lattice, c) - getattr(first.lattice, c)) > 1e-9 for c in ("x0", "y1", "cell")):
            raise Misaligned(f"{name} lies in another place")


def aligned(grids: dict[str, Grid]) -> DataFrame:
    """(row, col, name_band ...): cell for cell, of all cells that any grid has; missing bands are null."""
    check_aligned(grids)
    out = None
    for name, g in grids.items():
        own = g.cells.select("row", "col", *(F.col(b).alias(f"{name}_{b}") for b in g.bands))
        out = own if out is None else out.join(own, ["row", "col"], "full")
    return out


def offset(lattice: Lattice, target: Lattice) -> tuple[int, int]:
    """Rows and columns from a lattice's corner to that of a target which it must hold whole, in whole cells."""
    if abs(lattice.cell - target.cell) > 1e-9:
        raise Misaligned(f"cells of {lattice.cell} and {target.cell}")
    down, right = (lattice.y1 - target.y1) / lattice.cell, (target.x0 - lattice.x0) / lattice.cell
    if max(abs(down - round(down)), abs(right - round(right))) > 1e-6:
        raise Misaligned("the corners are not whole cells apart")
    down, right = round(down), round(right)
    if down < 0 or right < 0 or down + target.rows > lattice.rows or right + target.cols > lattice.cols:
        raise Misaligned("the target is not covered")
    return down, right


def cropped(grid: Grid, target: Lattice) -> DataFrame:
    """The cells of a grid on a target lattice that it covers, numbered from the target's corner."""
    down, right = offset(grid.lattice, target)
    moved = grid.cells.withColumns({"row": (F.col("row") - down).cast("int"), "col": (F.col("col") - right).cast("int")})
    return moved.filter(F.col("row").between(0, target.rows - 1) & F.col("col").between(0, target.cols - 1))


def chosen_bands(grid: DataFrame, bands: list[str] | None) -> DataFrame:
    """The cells with some bands, in their order (None: all); an unknown band is an error that names those there are."""
    known = [c for c in grid.columns if c not in ("row", "col")]
    lost = [b for b in bands or [] if b not in known]
    if lost:
        raise ValueError(f"no band {lost[0]!r}: there are {known}")
    return grid.select("row", "col", *(bands or known))


def uniform_nodata(bands: DataFrame) -> DataFrame:
    """bands(grid, band, nodata) to (grid, is_uniform, nodata): whether a grid's bands share one value for no data. NaN is like NaN, none is
    like none; the value is null where they differ."""
    same = F.count_distinct(F.coalesce(F.col("nodata").cast("string"), F.lit("none"))) == 1
    return bands.groupBy("grid").agg(same.alias("is_uniform"), F.max("nodata").alias("nodata")).withColumn("nodata", F.when(F.col("is_uniform"), F.col("nodata")))


def fire_stack(canopy: DataFrame, surface: DataFrame, dz: float, moisture: str = "max") -> DataFrame:
    """canopy(k, j, i, density, moisture[, savr]) and surface(j, i, load, depth, moisture[, savr]), moistures in percent, to
    (k, j, i, rho, moisture, depth[, size]).

    The lowest layer adds the surface's load over its height. Its moisture is the greater of both ("max") or their mean by
    density ("mean"; 0 without fuel), its surface-to-volume ratio always the mean by density. Depth is the surface's and 0
    above. Size is 2 / ratio, 0 where that is not positive. A missing cell or value counts as 0."""
    if moisture not in ("max", "mean"):
        raise ValueError(f"no way {moisture!r} to merge moistures")
    savr = "savr" in canopy.columns and "savr" in surface.columns
    low = surface.select(F.lit(0).alias("k"), "j", "i", *(F.col(c).alias(f"{c}_s") for c in ("load", "depth", "moisture", *(("savr",) if savr else ()))))
    both = canopy.join(low, ["k", "j", "i"], "full")
    v = lambda c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    own, add = v("density"), v("load_s") / dz
    mean = lambda a, b: F.when(own + add > 0, (own * a + add * b) / (own + add)).otherwise(0.0)
    ground = F.col("k") == 0
    wet, wet_s = v("moisture") / 100, v("moisture_s") / 100
    out = {
        "rho": own + add, "moisture": F.when(~ground, wet).otherwise(F.greatest(wet, wet_s) if moisture == "max" else mean(wet, wet_s)), "depth": F.when(ground, v("depth_s")).otherwise(0.0),
    }
    if savr:
        ratio = F.when(~ground, v("savr")).otherwise(mean(v("savr"), v("savr_s")))
        out["size"] = F.coalesce(F.when(ratio > 0, F.try_divide(F.lit(2.0), ratio)), F.lit(0.0))
    return both.select("k", "j", "i", *(c.alias(n) for n, c in out.items()))


def first_match(cells: DataFrame, code: str, table: DataFrame, key: str, value: str, nodata: int) -> DataFrame:
    """cells with `value` of their code from a table that may have a key several times: then the least value counts. No code, one
    under 1 and one that the table lacks get nodata."""
    one = table.filter(F.col(key) >= 1).groupBy(key).agg(F.min(value).alias(value)).withColumnRenamed(key, code)
    return cells.join(one, code, "left").withColumn(value, F.coalesce(value, F.lit(nodata)))


def upload_lattice(cells: DataFrame, names: list[str], crs: str, domain_crs: str, box: tuple[float, float, float, float]) -> Lattice:
    """The lattice of uploaded cells(x, y: centres, bands by position), which must be square cells of one band for each name, in the
    domain's reference system, and meet its box."""
    bands = [c for c in cells.columns if c not in ("x", "y")]
    if len(bands) != len(names):
        raise ValueError(f"{len(bands)} bands for {len(names)} names")
    if crs != domain_crs:
        raise ValueError(f"the upload is in {crs}, the domain in {domain_crs}")
    seen = {}
    for c in "xy":
        places = cells.select(c).distinct()  # as many as the lattice has columns or rows
        step = places.select((F.lead(c).over(_along(c)) - F.col(c)).alias("d"))
        seen[c] = (*places.agg(F.min(c), F.max(c)).first(), step.agg(F.min("d")).first()[0])
    dx, dy = seen["x"][2], seen["y"][2]
    if dx is None or dy is None or abs(dx - dy) > 1e-6 * max(dx, dy):
        raise ValueError(f"cells of {dx} by {dy} are not square")
    rows, cols = (round((hi - lo) / dx) + 1 for lo, hi, _ in (seen["y"], seen["x"]))
    lattice = Lattice(seen["x"][0] - dx / 2, seen["y"][1] + dx / 2, dx, rows, cols)
    if lattice.x0 >= box[2] or lattice.x0 + cols * dx <= box[0] or lattice.y1 <= box[1] or lattice.y1 - rows * dx >= box[3]:
        raise ValueError("the upload does not meet the domain")
    return lattice


def _along(c: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(F.floor(F.col(c) / 1e5)).orderBy(c)  # neighbours across a seam of 100 km are not needed for the least step
