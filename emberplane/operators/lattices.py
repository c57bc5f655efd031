"""Lattice alignment, compatibility, tiles and octree nodes as rule columns over metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial

MAX_CELLS = 50_000_000


def destination(boxes: DataFrame, how: str, resolution: float, buffer_cells: int, native: float = 30.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """boxes(id, minx, miny, maxx, maxy) to lattices(id, x0, y1, cols, rows, cell). `domain` starts at the
    box's upper left corner, `grid` on multiples of the cell from `origin`, `native` likewise at the source's own cell."""
    cell = F.lit(float(native if how == "native" else resolution))
    pad = cell * buffer_cells
    x0, y1, x1, y0 = F.col("minx") - pad, F.col("maxy") + pad, F.col("maxx") + pad, F.col("miny") - pad
    if how != "domain":
        ox, oy = map(F.lit, origin)
        x0, x1 = F.floor((x0 - ox) / cell) * cell + ox, F.ceil((x1 - ox) / cell) * cell + ox
        y0, y1 = F.floor((y0 - oy) / cell) * cell + oy, F.ceil((y1 - oy) / cell) * cell + oy
    return boxes.select("id", x0.alias("x0"), y1.alias("y1"), F.ceil((x1 - x0) / cell).cast("int").alias("cols"), F.ceil((y1 - y0) / cell).cast("int").alias("rows"), cell.alias("cell"))


def fault(tol: float = 1e-6, most: int = MAX_CELLS) -> Column:
    """Why a grid (x0, y1, cols, rows, cell, crs) doesn't fit the target lattice (t_...), or null:
    crs, cell, offset, coverage, cells; the first that fails."""
    shift = lambda a, b: (F.col(a) - F.col(b)) / F.col("t_cell")
    whole = lambda c: F.abs(c - F.rint(c)) <= tol
    dx, dy = shift("t_x0", "x0"), shift("y1", "t_y1")
    covers = (dx >= -tol) & (dy >= -tol) & (dx + F.col("t_cols") <= F.col("cols") + tol) & (dy + F.col("t_rows") <= F.col("rows") + tol)
    return (
        F.when(F.col("crs") != F.col("t_crs"), "crs").when(F.abs(F.col("cell") - F.col("t_cell")) > tol, "cell").when(~(whole(dx) & whole(dy)), "offset")
        .when(~covers, "coverage").when(F.col("t_cols").cast("long") * F.col("t_rows") > most, "cells")
    )


def contract_fault(contract: dict[str, tuple[str | None, int]], tol: float = 1e-6) -> Column:
    """Why the band of a grid (role, band, bands: unit by key, dims, z_cell, nz, z0) can't fill its role of an export,
    or null: role, band, unit, dimensions, vertical (t_z_cell, t_nz, t_z0); the first that fails.

    contract: by role the unit that its band needs (None: any) and the number of dimensions. Heights are
    never resampled, so a grid of three dimensions must have the layers of the target."""
    of = lambda k: F.create_map(*(F.lit(v) for role, needed in contract.items() for v in (role, needed[k])))[F.col("role")]
    missing = lambda c: ~F.coalesce(c, F.lit(False))
    near = lambda c: F.abs(F.col(c) - F.col(f"t_{c}")) <= tol
    return (
        F.when(missing(F.col("role").isin(*contract)), "role").when(missing(F.map_contains_key("bands", F.col("band"))), "band")
        .when(of(0).isNotNull() & missing(F.col("bands")[F.col("band")] == of(0)), "unit").when(missing(F.col("dims") == of(1)), "dimensions")
        .when((F.col("dims") == 3) & missing(near("z_cell") & near("z0") & (F.col("nz") == F.col("t_nz"))), "vertical")
    )


def tile_span(low: Column, high: Column, origin: float, tile: float) -> tuple[Column, Column]:
    """First and last tile of an interval."""
    return F.floor((low - origin) / F.lit(float(tile))), F.floor((high - origin) / F.lit(float(tile)))


def tile_size(extent: Column, target: int) -> Column:
    """A power of two between 2 and 128 metres that cuts the extent into about `target` tiles."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(1), F.least(F.lit(7), F.round(F.log2(extent / F.lit(float(target)))).cast("int"))))


def node_bounds(size: float, depth: Column, *place: Column) -> list[tuple[Column, Column]]:
    """Low and high of an octree node along each axis, of a root cube from 0 to `size`."""
    step = F.lit(float(size)) / F.pow(F.lit(2.0), depth)
    return [(p * step, (p + 1) * step) for p in place]


def ring_trimmed(cells: DataFrame, rows: int, cols: int, ring: int) -> DataFrame:
    """Without the outer `ring` cells that derivatives needed, numbered from 0 again."""
    inner = cells.filter(F.col("row").between(ring, rows - ring - 1) & F.col("col").between(ring, cols - ring - 1))
    return inner.withColumns({"row": F.col("row") - ring, "col": F.col("col") - ring})


def region_area_ha(cells: DataFrame, region: Column, cell: float) -> DataFrame:
    """Hectares of the cells whose centre lies in the region; right to the cells on its boundary."""
    return cells.filter(region).agg((F.count("*") * F.lit(cell * cell / 10_000)).alias("area_ha"))


def region_areas(domains: DataFrame, conditions: list[tuple[str, list]], cell: float, most_ha: float | None = None) -> DataFrame:
    """domains(id, minx, miny, maxx, maxy) with area_ha, the hectares of the domain that meet all conditions
    (within, intersects or outside, with a polygon's rings), and with a limit whether it is too_large.

    Cells count by their centres, so the area is right to the cells on the boundary; each domain makes its own
    cells only and they are counted before the shuffle. A domain without such a cell has an area of 0."""
    x, y = ((F.col(c) + 0.5) * cell for c in ("col", "row"))
    kept = boxes_on_cells(domains.select("id", "minx", "miny", "maxx", "maxy"), cell)
    for how, rings in conditions:
        if how not in ("within", "intersects", "outside"):
            raise ValueError(f"no spatial condition {how!r}")
        hit = spatial.inside(x, y, rings)
        kept = kept.filter(~hit if how == "outside" else hit)
    area = kept.groupBy("id").agg((F.count("*") * F.lit(cell * cell / 10_000)).alias("area_ha"))
    out = domains.join(area, "id", "left").withColumn("area_ha", F.coalesce("area_ha", F.lit(0.0)))
    return out if most_ha is None else out.withColumn("too_large", F.col("area_ha") > most_ha)


def boxes_on_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """(row, col, ...) of the cells (rows north from 0) whose centres a box covers; each box makes its own cells only."""
    span = lambda a, b: F.sequence(F.ceil(F.col(a) / cell - 0.5), F.floor(F.col(b) / cell - 0.5))
    some = boxes.filter((F.ceil(F.col("minx") / cell - 0.5) <= F.floor(F.col("maxx") / cell - 0.5)) & (F.ceil(F.col("miny") / cell - 0.5) <= F.floor(F.col("maxy") / cell - 0.5)))
    return some.withColumn("row", F.explode(span("miny", "maxy"))).withColumn("col", F.explode(span("minx", "maxx")))


def layers_on_cells(boxes: DataFrame, cell: float, how: str = "mean") -> DataFrame:
    """boxes(fuel_type, fuel_loading, percent_cover, ...) to (row, col, fuel_type, fuel_loading): the cover's
    share of the loading, boxes of one type over a cell combined by mean, max or min."""
    agg = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    return boxes_on_cells(boxes, cell).groupBy("row", "col", "fuel_type").agg(agg(F.col("fuel_loading") * F.col("percent_cover") / 100).alias("fuel_loading"))


def chunk_of(row: Column, col: Column, chunk: int, cols: int) -> Column:
    """Number of the chunk that a cell lies in, along rows."""
    across = -(-cols // chunk)
    return (F.floor(row / chunk) * across + F.floor(col / chunk)).cast("int")


def chunk_metadata(rows: DataFrame, number: str, chunk: int, lattice, layers: tuple[int, int] | None = None) -> DataFrame:
    """rows with the offset, the shape cut at the lattice's edge and the upper left corner of the chunk of a
    number; with layers (how many, how many a chunk) also k0 and depth."""
    across, down = -(-lattice.cols // chunk), -(-lattice.rows // chunk)
    n = F.col(number) % (across * down)
    row0, col0 = F.floor(n / across).cast("int") * chunk, (n % across).cast("int") * chunk
    out = {"row0": row0, "col0": col0, "height": F.least(F.lit(chunk), lattice.rows - row0), "width": F.least(F.lit(chunk), lattice.cols - col0), "x0": lattice.x0 + col0 * F.lit(lattice.cell), "y1": lattice.y1 - row0 * F.lit(lattice.cell)}
    if layers:
        k0 = F.floor(F.col(number) / (across * down)).cast("int") * layers[1]
        out |= {"k0": k0, "depth": F.least(F.lit(layers[1]), layers[0] - k0)}
    return rows.withColumns(out)


def chunk_sparse(cells: DataFrame, value: str, chunk: int, rows: int, cols: int, fill: float, order: str = "C") -> DataFrame:
    """(chunk_row, chunk_col, flat, value) of the cells that differ from the fill; flat counts along rows (C) or columns (F) of the chunk."""
    r, c = F.col("row") % chunk, F.col("col") % chunk
    wide, high = F.least(F.lit(chunk), cols - F.floor(F.col("col") / chunk) * chunk), F.least(F.lit(chunk), rows - F.floor(F.col("row") / chunk) * chunk)
    flat = r * wide + c if order == "C" else c * high + r
    return cells.filter(F.col(value) != fill).select(F.floor(F.col("row") / chunk).cast("int").alias("chunk_row"), F.floor(F.col("col") / chunk).cast("int").alias("chunk_col"), flat.alias("flat"), value)


def chunk_dense(cells: DataFrame, value: str, chunk: int, rows: int, cols: int, fill: float, order: str = "C") -> DataFrame:
    """(chunk_row, chunk_col, data): all values of each chunk of the lattice in C or F order, missing ones as the fill.
    Cells beyond the lattice have no place in a chunk and go.

    The places of a chunk and its values are sorted once; nothing is looked up per cell."""
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    known = cells.filter(F.col(value).isNotNull() & inside).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).alias("v_"), F.lit(0).alias("none_"))
    across = F.lit(cols)
    every = cells.sparkSession.range(rows * cols).select(F.call_function("div", F.col("id"), across).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.lit(fill).cast(cells.schema[value].dataType).alias("v_"), F.lit(1).alias("none_"))
    place = F.struct(F.col("row"), F.col("col")) if order == "C" else F.struct(F.col("col"), F.col("row"))
    both = known.unionByName(every).select(F.floor(F.col("row") / chunk).cast("int").alias("chunk_row"), F.floor(F.col("col") / chunk).cast("int").alias("chunk_col"), place.alias("at_"), "none_", "v_")
    # A known value comes right before the fill of its place.
    one = both.groupBy("chunk_row", "chunk_col", "at_").agg(F.min(F.struct("none_", "v_")).alias("f"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("at_", F.col("f.v_").alias("v")))), lambda e: e["v"])  # a chunk's cells
    return one.groupBy("chunk_row", "chunk_col").agg(data.alias("data"))


def stacked(bands: DataFrame, roles: dict[str, float], offset: tuple[int, int], rows: int, cols: int) -> DataFrame:
    """bands(row, col, a column per role) cropped to a lattice that starts `offset` cells in, as int16: the value
    times the role's factor, rounded half to even and clipped; missing ones -9999. A role that is not there is an error."""
    missing = [r for r in roles if r not in bands.columns]
    if missing:
        raise ValueError(f"no bands for {missing}")
    stored = lambda r, k: F.coalesce(F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(F.col(r) * k))), F.lit(-9999.0)).cast("smallint").alias(r)
    moved = bands.withColumns({"row": (F.col("row") - offset[0]).cast("int"), "col": (F.col("col") - offset[1]).cast("int")})
    return moved.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).select("row", "col", *(stored(r, k) for r, k in roles.items()))


def padded(boxes: DataFrame, resolution: float) -> DataFrame:
    """boxes with their bounds moved outward to multiples of the resolution."""
    k = F.lit(float(resolution))
    return boxes.withColumns({**{c: (F.floor(F.col(c) / k) * k) for c in ("minx", "miny")}, **{c: (F.ceil(F.col(c) / k) * k) for c in ("maxx", "maxy")}})


def cells_of(boxes: DataFrame, resolution: float) -> DataFrame:
    """boxes with a row (row, col, centre x, y) for each cell of a lattice anchored at the lower left corner; a cell at least."""
    k = F.lit(float(resolution))
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / k).cast("int"))
    out = boxes.withColumns({"rows_": n("miny", "maxy"), "cols_": n("minx", "maxx")})
    out = out.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows_") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols_") - 1)))
    return out.withColumns({"x": F.col("minx") + (F.col("col") + 0.5) * k, "y": F.col("miny") + (F.col("rows_") - F.col("row") - 0.5) * k}).drop("rows_", "cols_")


def coverage_status(regions: DataFrame, parts: DataFrame, cell: float) -> DataFrame:
    """regions(id, product, box) and parts(product, box) to (id, status): full, partial or none by the cells whose
    centres lie in a region and in some part of its product; no_such_product where it has no part."""
    want = boxes_on_cells(regions, cell).select("id", "product", "row", "col")
    have = boxes_on_cells(parts, cell).select("product", "row", "col").distinct().withColumn("had_", F.lit(1))
    seen = want.join(have, ["product", "row", "col"], "left").groupBy("id", "product").agg(F.count("*").alias("all_"), F.count("had_").alias("had_"))
    known = parts.select("product").distinct().withColumn("known_", F.lit(True))
    out = regions.select("id", "product").join(seen, ["id", "product"], "left").join(known, "product", "left")
    return out.select("id", F.when(F.col("known_").isNull(), "no_such_product").when(F.coalesce("had_", F.lit(0)) == 0, "none").when(F.col("had_") == F.col("all_"), "full").otherwise("partial").alias("status"))
