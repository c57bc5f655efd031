"""Geometry as Column expressions: polygons are arrays of edges, regions are boxes, lines have a width."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files


# Estimated widths in metres of roads and waterways by class.
ROAD_WIDTHS = {
    "motorway": 30, "motorway_link": 30, "trunk": 25, "trunk_link": 25, "primary": 20, "primary_link": 20, "secondary": 15, "secondary_link": 15,
    "tertiary": 10, "tertiary_link": 10, "unclassified": 8, "residential": 6, "service": 5, "track": 6, "path": 1,
}
WATER_WIDTHS = {"river": 15, "canal": 10, "stream": 5, "drain": 2, "ditch": 2}


def edges_of(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Edges of a closed ring."""
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]


def crossed(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether an odd number of edges (holes are rings too) cross the line from a point to the east. Half-open: of polygons
    that share an edge exactly one has a point on it."""
    hits = F.lit(0)
    for ring in rings:
        for x1, y1, x2, y2 in edges_of(ring):
            if y1 != y2:
                at = F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
                hits = hits + F.when(((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < at), 1).otherwise(0)
    return hits % 2 == 1


def inside(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a point is strictly within a polygon."""
    return crossed(x, y, rings) & ~on_boundary(x, y, rings)


def on_boundary(x: Column, y: Column, rings) -> Column:
    out = F.lit(False)
    for ring in rings:
        for x1, y1, x2, y2 in edges_of(ring):
            cross = (x - F.lit(x1)) * F.lit(y2 - y1) - (y - F.lit(y1)) * F.lit(x2 - x1)
            out = out | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return out


def condition(x: Column, y: Column, rings, how: str) -> Column:
    """within, intersects (boundary included) or outside."""
    touched = inside(x, y, rings) | on_boundary(x, y, rings)
    return {"within": inside(x, y, rings), "intersects": touched, "outside": ~touched}[how]


def distance2(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    """Squared distance to a polyline."""
    out = None
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        dx, dy = x2 - x1, y2 - y1
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.lit(x1)) * F.lit(dx) + (y - F.lit(y1)) * F.lit(dy)) / F.lit(dx * dx + dy * dy)))
        d = F.pow(x - F.lit(x1) - t * F.lit(dx), 2) + F.pow(y - F.lit(y1) - t * F.lit(dy), 2)
        out = d if out is None else F.least(out, d)
    return out


def buffered(x: Column, y: Column, rings, metres: float) -> Column:
    """Inside a polygon or within `metres` of its boundary."""
    return inside(x, y, rings) | (distance2(x, y, rings[0] + rings[0][:1]) <= metres * metres)


def edge_meets(x: Column, y: Column, half: float, edge: tuple[float, float, float, float]) -> Column:
    """Whether an edge meets the square around (x, y): the shares of the edge within the square's x and y overlap."""
    x1, y1, x2, y2 = edge
    low, high = F.lit(0.0), F.lit(1.0)
    for start, d, c in ((x1, x2 - x1, x), (y1, y2 - y1, y)):
        if d == 0:
            high = F.when((F.lit(start) >= c - half) & (F.lit(start) <= c + half), high).otherwise(F.lit(-1.0))
        else:
            a, b = (c - half - F.lit(start)) / F.lit(d), (c + half - F.lit(start)) / F.lit(d)
            low, high = F.greatest(low, F.least(a, b)), F.least(high, F.greatest(a, b))
    return low <= high


def box_touched(x: Column, y: Column, half: float, rings) -> Column:
    """Whether a square cell (by its centre) is touched: its centre is inside, or an edge meets the square."""
    out = inside(x, y, rings)
    for ring in rings:
        for edge in edges_of(ring):
            out = out | edge_meets(x, y, half, edge)
    return out


def box_within(x: Column, y: Column, half: float, rings) -> Column:
    """Whether a square cell (by its centre) lies strictly within a polygon: its centre does, and no edge meets the square."""
    met = F.lit(False)
    for ring in rings:
        for edge in edges_of(ring):
            met = met | edge_meets(x, y, half, edge)
    return inside(x, y, rings) & ~met


def segments_meet(a: Column, b: Column, edge: tuple[float, float, float, float]) -> Column:
    """Whether the segment from point a to point b (structs x, y) has a point in common with a fixed edge."""
    x1, y1, x2, y2 = map(float, edge)
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    sides = turn(F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2), a.x, a.y) * turn(F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2), b.x, b.y)
    other = turn(a.x, a.y, b.x, b.y, F.lit(x1), F.lit(y1)) * turn(a.x, a.y, b.x, b.y, F.lit(x2), F.lit(y2))
    near = (F.greatest(a.x, b.x) >= min(x1, x2)) & (F.least(a.x, b.x) <= max(x1, x2)) & (F.greatest(a.y, b.y) >= min(y1, y2)) & (F.least(a.y, b.y) <= max(y1, y2))
    return near & (sides <= 0) & (other <= 0)


def ring_area(ring: Column) -> Column:
    """Area of a ring, an array of points (x, y) that need not be closed."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda s, t: s + t)) / 2


def domain_fault(boundary: list[list[tuple[float, float]]], most: float = 16e6) -> Column:
    """Why a domain (crs, ring: array of points x, y) is refused, or null: crs (no authority and code), area (none),
    boundary (not wholly within it: each point inside, no edge meeting one of its edges), too_large (the bounds
    cover more than `most` square metres); the first that fails."""
    ring = F.col("ring")
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def meets(side):
        met = F.lit(False)
        for part in boundary:
            for edge in edges_of(part):
                met = met | segments_meet(side.a, side.b, edge)
        return met

    held = F.forall(ring, lambda p: inside(p.x, p.y, boundary)) & ~F.exists(sides, meets)
    span = lambda k: F.array_max(F.transform(ring, lambda p: p[k])) - F.array_min(F.transform(ring, lambda p: p[k]))
    return (
        F.when(~F.coalesce(F.col("crs").rlike(r"^[A-Z]+:\d+$"), F.lit(False)), "crs").when(~F.coalesce(ring_area(ring) > 0, F.lit(False)), "area")
        .when(~F.coalesce(held, F.lit(False)), "boundary").when(span("x") * span("y") > most, "too_large")
    )


def polygon_join(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """points(id, x, y) within edges(feature_id, x1, y1, x2, y2): (id, feature_id).

    A point is inside where an odd number of edges cross the line from it to the east. Edges are cut into
    grid cells of `cell` metres: a point meets only the pieces in its own cell, and for each feature takes
    the parity of the edges that cross its cell's southern border line east of the cell, and of the column of
    pieces between, from one row per feature and cell. A feature's cells are those of the strips it spans, so
    the table of parities grows with the features' area in cells, not with the points.
    """
    k = F.lit(float(cell))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.filter("y1 <> y2").withColumns({"lo_": low, "hi_": high})
    e = e.withColumn("gy_", F.explode(F.sequence(F.floor(F.col("lo_") / k), F.floor(F.col("hi_") / k))))
    # The piece of the edge in its strip: its span of x says in which cells it is looked at.
    xa, xb = at(F.greatest(F.col("lo_"), F.col("gy_") * k)), at(F.least(F.col("hi_"), (F.col("gy_") + 1) * k))
    e = e.withColumns({"gx0_": F.floor((F.least(xa, xb) - 1e-6) / k), "gx1_": F.floor((F.greatest(xa, xb) + 1e-6) / k)})
    span = e.groupBy("feature_id", "gy_").agg(F.min("gx0_").alias("west_"))
    # West of its piece's cells a point lies left of the whole piece: the piece counts where it spans the point's y.
    near = e.withColumn("gx_", F.explode(F.sequence("gx0_", "gx1_"))).select("feature_id", "gx_", "gy_", "x1", "y1", "x2", "y2", "lo_", "hi_", F.lit(False).alias("far_"))
    far = e.join(span, ["feature_id", "gy_"]).filter("gx0_ > west_").withColumn("gx_", F.explode(F.sequence(F.col("west_"), F.col("gx0_") - 1)))
    # Of pieces that cross the whole strip only their parity matters, one row for all of them.
    whole = (F.col("lo_") <= F.col("gy_") * k) & (F.col("hi_") >= (F.col("gy_") + 1) * k)
    through = far.filter(whole).groupBy("feature_id", "gx_", "gy_").agg((F.count("*") % 2).alias("odd_")).filter("odd_ = 1").select("feature_id", "gx_", "gy_")
    none = F.lit(None).cast("double")
    through = through.select("feature_id", "gx_", "gy_", none.alias("x1"), none.alias("y1"), none.alias("x2"), none.alias("y2"), F.lit(float("-inf")).alias("lo_"), F.lit(float("inf")).alias("hi_"), F.lit(True).alias("far_"))
    part = far.filter(~whole).select("feature_id", "gx_", "gy_", "x1", "y1", "x2", "y2", "lo_", "hi_", F.lit(True).alias("far_"))
    pieces = near.unionByName(part).unionByName(through)
    p = points.select("id", "x", "y", F.floor(F.col("x") / k).alias("gx_"), F.floor(F.col("y") / k).alias("gy_"))
    hit = p.join(pieces, ["gx_", "gy_"]).filter((F.col("y") >= F.col("lo_")) & (F.col("y") < F.col("hi_")) & (F.col("far_") | (F.col("x") < at(F.col("y")))))
    return hit.groupBy("id", "feature_id").agg(F.count("*").alias("k")).filter("k % 2 = 1").select("id", "feature_id")


def buffered_features(lines: DataFrame, widths: dict[str, float], kind: str = "class") -> DataFrame:
    """lines with `half`, half the width of their class, and is_polygon: features of no listed class stay as they are."""
    half = F.element_at(F.create_map(*(F.lit(x) for c, w in widths.items() for x in (c, w / 2))), F.col(kind))
    return lines.withColumn("half", half).withColumn("is_polygon", F.col("half").isNull())


def capsules(lines: DataFrame, widths: dict[str, float], kind: str = "class") -> DataFrame:
    """lines(x1, y1, x2, y2, class) of a listed class, each a segment with a radius `half`."""
    return buffered_features(lines, widths, kind).filter("NOT is_polygon").drop("is_polygon")


def within_capsules(points: DataFrame, shapes: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """points(x, y, keys) within any segment's radius. Shapes are dealt to the grid cells of their bounds, points
    to their own, so that only those of one cell meet, and a point is kept at the first that is near. Of shapes on
    one segment the widest stands for all."""
    k = F.lit(float(cell))
    shapes = shapes.groupBy("x1", "y1", "x2", "y2").agg(F.max("half").alias("half"))
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - F.col("half")) / k), F.floor((F.greatest(a, b) + F.col("half")) / k)))
    s = shapes.select("x1", "y1", "x2", "y2", "half").withColumn("gx_", span("x1", "x2")).withColumn("gy_", span("y1", "y2"))
    p = points.withColumns({"gx_": F.floor(F.col("x") / k), "gy_": F.floor(F.col("y") / k)})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = F.col("x") - F.col("x1") - t * dx, F.col("y") - F.col("y1") - t * dy
    met = (p["gx_"] == s["gx_"]) & (p["gy_"] == s["gy_"]) & (ex * ex + ey * ey <= F.col("half") * F.col("half"))
    return p.join(s, met, "left_semi").select(*points.columns)


def in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """points(x, y, ...) with each of boxes(minx, miny, maxx, maxy, ...) that they lie in, its boundary included. Boxes are dealt
    to the grid cells that they cover, points to their own. Boxes that count once should be given once."""
    k = F.lit(float(cell))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / k), F.floor(F.col(b) / k)))
    b = boxes.withColumn("gx_", span("minx", "maxx")).withColumn("gy_", span("miny", "maxy"))
    p = points.withColumns({"gx_": F.floor(F.col("x") / k), "gy_": F.floor(F.col("y") / k)})
    return p.join(b, ["gx_", "gy_"]).filter(F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))).drop("gx_", "gy_")


def overlaps(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Boxes a(a_id, minx, miny, maxx, maxy) and b(b_id, ...) that meet, with the area in common.

    Both are dealt to the cells of a grid that they cover; a pair counts in the cell of the lower left
    corner of its common box only.
    """
    k = F.lit(float(cell))

    def dealt(df, p):
        out = df.select(*(F.col(c).alias(p + c) for c in ("minx", "miny", "maxx", "maxy")), F.col(f"{p[0]}_id"))
        out = out.withColumn("gx", F.explode(F.sequence(F.floor(F.col(p + "minx") / k), F.floor(F.col(p + "maxx") / k))))
        return out.withColumn("gy", F.explode(F.sequence(F.floor(F.col(p + "miny") / k), F.floor(F.col(p + "maxy") / k))))

    j = dealt(a, "a").join(dealt(b, "b"), ["gx", "gy"])
    x0, y0 = F.greatest("aminx", "bminx"), F.greatest("aminy", "bminy")
    x1, y1 = F.least("amaxx", "bmaxx"), F.least("amaxy", "bmaxy")
    j = j.filter((x0 <= x1) & (y0 <= y1) & (F.floor(x0 / k) == F.col("gx")) & (F.floor(y0 / k) == F.col("gy")))
    return j.select("a_id", "b_id", ((x1 - x0) * (y1 - y0)).alias("area"))


def clip_segments(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """lines(id, x1, y1, x2, y2) cut to a box; what lies outside goes."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high = F.lit(0.0), F.lit(1.0)
    for p, q in ((-dx, F.col("x1") - box[0]), (dx, F.lit(box[2]) - F.col("x1")), (-dy, F.col("y1") - box[1]), (dy, F.lit(box[3]) - F.col("y1"))):
        r = F.try_divide(q, p)
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).when((p == 0) & (q < 0), F.lit(-1.0)).otherwise(high)
    cut = lines.withColumns({"t0_": low, "t1_": high}).filter("t0_ <= t1_")
    at = lambda a, d, t: F.col(a) + F.col(t) * (F.col(d) - F.col(a))
    return cut.select("id", at("x1", "x2", "t0_").alias("x1"), at("y1", "y2", "t0_").alias("y1"), at("x1", "x2", "t1_").alias("x2"), at("y1", "y2", "t1_").alias("y2"))


WGS84_A, WGS84_F, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_S = 2 * math.sqrt(_N) / (1 + _N)


def _wave(xi: Column, eta: Column, terms: list[float], sign: int, m=F) -> tuple[Column, Column]:
    """xi and eta moved by Krueger's series."""
    x, y = eta, xi
    for k, c in enumerate(terms, 1):
        x = x + sign * c * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        y = y + sign * c * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return x, y


def utm(lon: Column, lat: Column, zone: int, terms: int = 4, m=F) -> tuple[Column, Column]:
    """WGS84 longitude and latitude to UTM easting and northing (north), by Krueger's series. With `m` the module math
    of numbers, by the C library's functions, whose last bits differ from Java's."""
    n = _N
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280][:terms]
    phi, lam = m.radians(lat), m.radians(lon - (6 * zone - 183))
    t = m.sinh(m.atanh(m.sin(phi)) - _S * m.atanh(_S * m.sin(phi)))
    x, y = _wave(m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t)), alpha, 1, m)
    return 500000 + UTM_SCALE * _RADIUS * x, UTM_SCALE * _RADIUS * y


def lonlat(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """UTM (north) back to WGS84 longitude and latitude: the inverse series, then the latitude from the conformal one."""
    n = _N
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    eta, xi = _wave(northing / (UTM_SCALE * _RADIUS), (easting - 500000) / (UTM_SCALE * _RADIUS), beta, -1)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, c in enumerate(delta, 1):
        lat = lat + F.lit(c) * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(lat)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 to Web Mercator metres."""
    return F.radians(lon) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WGS84_A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)


def greedy_choice(covered: DataFrame, density: DataFrame, enough: float = 1e-4, total: int | None = None) -> DataFrame:
    """covered(cell, name), density(name, density) to (name, density, n): the names chosen one by one by their
    gain n in cells (ties: denser, then the greater name) until less than a share `enough` of `total` (by default, all covered cells) is left or gained.

    A round takes all names that rank before every name with which they share a cell that is left. Gains
    only fall, and those of the names taken can't before their turn, so the choice is that of one name at
    a time; its order is by n, density and name. The driver sees a count a round."""
    cut = lambda df: files.written(df, "cover")
    total = covered.select("cell").distinct().count() if total is None else total
    left, out = cut(covered.select("cell", "name").distinct().join(density.select("name", "density"), "name")), None
    rank = F.struct("n", "density", "name")
    while True:
        gain = left.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, enough * total))
        ranked = left.join(gain, "name")
        ahead = ranked.groupBy("cell").agg(F.max(rank).alias("ahead"))
        beaten = F.col("ahead.name") != F.col("name")
        won = cut(ranked.join(ahead, "cell").groupBy("name", "density", "n").agg(F.max(beaten).alias("beaten")).filter("NOT beaten").select("name", "density", "n"))
        out = won if out is None else out.unionByName(won)
        if won.isEmpty():
            return out
        old, left = left, cut(left.join(left.join(won.select("name"), "name", "left_semi").select("cell").distinct(), "cell", "left_anti"))
        files.discard(old)


def greedy_cover(covered: DataFrame, density: DataFrame, enough: float = 1e-4) -> list[str]:
    """The names of greedy_choice in their order."""
    return [r["name"] for r in greedy_choice(covered, density, enough).orderBy(F.desc("n"), F.desc("density"), F.desc("name")).collect()]


def _tiles(boxes: DataFrame, step: float) -> DataFrame:
    """boxes(minx, miny, maxx, maxy) with a row for each tile (tx_, ty_: its left and upper edge in steps) that they reach into."""
    k = F.lit(float(step))
    span = lambda a, b, add: F.explode(F.sequence(F.floor(F.col(a) / k) + add, F.ceil(F.col(b) / k) - 1 + add))
    return boxes.withColumn("tx_", span("minx", "maxx", 0)).withColumn("ty_", span("miny", "maxy", 1))


def tile_names(boxes: DataFrame, step: float) -> DataFrame:
    """A row per box and tile of its region, named by upper and left edge, n...e... or n...w... west of 0."""
    east = F.when(F.col("tx_") < 0, F.concat(F.lit("w"), (-F.col("tx_")).cast("string"))).otherwise(F.concat(F.lit("e"), F.col("tx_").cast("string")))
    return _tiles(boxes, step).withColumn("tile", F.concat(F.lit("n"), F.col("ty_").cast("string"), east)).drop("tx_", "ty_")


def degree_tile_names(boxes: DataFrame) -> DataFrame:
    """Tiles of one degree west of 0, named by their north-west corner."""
    return _tiles(boxes, 1.0).withColumn("tile", F.format_string("n%02dw%03d", "ty_", (-F.col("tx_")))).drop("tx_", "ty_")
