"""Queries over polygons: filled layers, exact areas, clipped rings; feature layers by index; reprojection by tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as feature_layers
from ..operators import polygons, reprojection, spatial
from ..registry import query
from ..sources import files, tables
from . import base_sql as B
from .spatial_plans import BOXES, HOLE, SQUARE, boxes

#: Each box as a quadrilateral without level or upright sides; half of them have a triangular hole.
OUTER = [("minx", "miny + 4"), ("maxx - 6", "miny"), ("maxx", "maxy - 3"), ("minx + 5", "maxy")]
INNER = [(f"(minx + maxx) / 2 {a}", f"(miny + maxy) / 2 {b}") for a, b in (("- 4", "- 3"), ("+ 5", "- 2"), ("+ 0", "+ 6"))]


def edges_sql(ring: list[tuple[str, str]], part: int, where: str = "true") -> str:
    pairs = zip(ring, ring[1:] + ring[:1], strict=True)
    return " UNION ALL ".join(f"SELECT id, {part} AS p, {a} AS x1, {b} AS y1, {c} AS x2, {e} AS y2 FROM boxes WHERE {where}" for (a, b), (c, e) in pairs)


def ring_of(corners: list[tuple[str, str]]):
    return F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in corners))


def shapes(spark, d):
    """Edges of the quadrilaterals and their holes."""
    b = boxes(spark, d)
    return polygons.edges_of_rings(b.select("id", ring_of(OUTER).alias("ring"))).unionByName(polygons.edges_of_rings(b.filter("id % 2 = 0").select("id", ring_of(INNER).alias("ring"))))


SHAPES = f"e AS MATERIALIZED ({edges_sql(OUTER, 0)} UNION ALL {edges_sql(INNER, 1, 'id % 2 = 0')})"
VALUES = {
    "fuel_type": "CASE id % 3 WHEN 0 THEN 'shrub' WHEN 1 THEN 'herb' ELSE 'litter' END", "fuel_loading": "CAST(id % 17 AS DOUBLE)", "percent_cover": "CAST(id % 101 AS DOUBLE)", "fuel_height": "CAST(id % 7 AS DOUBLE) / 2",
    "live_fuel_moisture": "CAST(60 + id % 40 AS DOUBLE)", "dead_fuel_moisture": "CAST(5 + id % 9 AS DOUBLE)", "heat_of_combustion": "CAST(18000 + id % 13 * 100 AS DOUBLE)",
}
FILLED = f"""WITH {BOXES}, {SHAPES}, valued AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in VALUES.items())} FROM boxes),
 crossed AS (SELECT id, r.range AS row, x1 + ((r.range + 0.5) * 10 - y1) * (x2 - x1) / (y2 - y1) AS x FROM e, range(100) r WHERE r.range * 10 + 5 >= least(y1, y2) AND r.range * 10 + 5 < greatest(y1, y2)),
 inside AS (SELECT id, row, c.range AS col FROM crossed, range(100) c WHERE x > c.range * 10 + 5 GROUP BY ALL HAVING count(*) % 2 = 1)"""


for how, agg in (("mean", "avg"), ("max", "max"), ("min", "min")):
    @query(f"geo09_polygon_layers_{how}", f"{FILLED} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, fuel_type, {', '.join(f'round({agg}({v}), 7) AS {b}' for b, v in polygons.BANDS.items())} FROM inside JOIN valued USING (id) GROUP BY ALL")
    def _(spark, d, how=how):
        """Five bands per fuel type of polygons with holes, by scanlines."""
        layers = boxes(spark, d).select("id", *(F.expr(v).alias(k) for k, v in VALUES.items()))
        out = polygons.layer_bands(layers, shapes(spark, d), 10.0, how)
        return out.select("row", "col", "fuel_type", *(F.round(b, 7).alias(b) for b in polygons.BANDS))


#: The area of convex polygons e (p = 0, less holes p = 1 within them) in the boxes b: between cuts the width in common is linear.
CONVEX = """cuts AS (SELECT e.id, y1 AS y FROM e JOIN b USING (id) WHERE y1 BETWEEN miny AND maxy UNION SELECT id, miny FROM b UNION SELECT id, maxy FROM b
  UNION SELECT id, y1 + (x - x1) * (y2 - y1) / (x2 - x1) FROM e JOIN (SELECT id, unnest([minx, maxx]) AS x, miny, maxy FROM b) USING (id) WHERE x1 <> x2 AND y1 + (x - x1) * (y2 - y1) / (x2 - x1) BETWEEN miny AND maxy),
 slabs AS (SELECT id, y AS ya, lead(y) OVER (PARTITION BY id ORDER BY y) AS yb FROM cuts),
 spans AS (SELECT s.id, p, ya, yb, min(x1 + ((ya + yb) / 2 - y1) * (x2 - x1) / (y2 - y1)) AS l, max(x1 + ((ya + yb) / 2 - y1) * (x2 - x1) / (y2 - y1)) AS r FROM slabs s JOIN e ON e.id = s.id AND (ya + yb) / 2 > least(y1, y2) AND (ya + yb) / 2 < greatest(y1, y2) GROUP BY s.id, p, ya, yb),
 areas AS (SELECT id, sum((yb - ya) * greatest(0, least(r, maxx) - greatest(l, minx)) * CASE p WHEN 0 THEN 1 ELSE -1 END) AS area FROM spans JOIN b USING (id) GROUP BY id)"""


def fixed_edges_sql() -> str:
    rows = [f"({p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for p, ring in ((0, SQUARE[0]), (1, HOLE)) for a, b, c, e in spatial.edges_of(ring)]
    return f"f(p, x1, y1, x2, y2) AS (VALUES {', '.join(rows)}), b AS (SELECT * FROM boxes), e AS (SELECT id, f.* FROM boxes, f)"


@query("win05_exact_areas", f"WITH {BOXES}, {fixed_edges_sql()}, {CONVEX} SELECT id, round(coalesce(area, 0) / 10000, 8) AS area_ha, coalesce(area, 0) / 10000 > CAST(0.1 AS DOUBLE) AS too_large FROM boxes LEFT JOIN areas USING (id)")
def _(spark, d):
    """Hectares of each domain within one polygon and outside of another, to the square centimetre in the twin's rounding."""
    corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")]
    domains = polygons.edges_of_rings(boxes(spark, d).select("id", ring_of(corners).alias("ring")))
    out = polygons.exact_areas(domains, [("within", SQUARE), ("outside", [HOLE])], 25.0, 0.1)
    return out.select("id", F.round("area_ha", 8).alias("area_ha"), "too_large")


CLIP = (200.0, 100.0, 600.0, 700.0)


@query("geo07_clip_polygons", f"WITH {BOXES}, e AS ({edges_sql(OUTER, 0)}), b AS (SELECT id, 200::DOUBLE AS minx, 100::DOUBLE AS miny, 600::DOUBLE AS maxx, 700::DOUBLE AS maxy FROM boxes), {CONVEX} SELECT id, round(area, 6) AS area FROM areas WHERE area > CAST(1e-9 AS DOUBLE)")
def _(spark, d):
    """Slanted quadrilaterals cut to a box."""
    out = polygons.clip_rings(boxes(spark, d).select("id", ring_of(OUTER).alias("ring")), CLIP)
    return out.select("id", spatial.ring_area(F.col("ring")).alias("area")).filter("area > 1e-9").select("id", F.round("area", 6).alias("area"))


@query("geo07_clip_slanted_segments", f"""WITH {BOXES}, s AS (SELECT id, minx AS x1, miny AS y1, maxx - minx AS dx, maxy - miny AS dy FROM boxes), t AS (SELECT *, greatest(0, (200 - x1) / dx, (100 - y1) / dy) AS t0, least(1, (600 - x1) / dx, (700 - y1) / dy) AS t1 FROM s)
 SELECT id, round(x1 + t0 * dx, 6) AS x1, round(y1 + t0 * dy, 6) AS y1, round(x1 + t1 * dx, 6) AS x2, round(y1 + t1 * dy, 6) AS y2 FROM t WHERE t0 <= t1""")
def _(spark, d):
    lines = boxes(spark, d).select("id", F.col("minx").alias("x1"), F.col("miny").alias("y1"), F.col("maxx").alias("x2"), F.col("maxy").alias("y2"))
    return spatial.clip_segments(lines, CLIP).select("id", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


AREAS = "areas AS (SELECT area, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM (SELECT *, id // 8 % 40 AS area FROM boxes) GROUP BY area)"


@query("src09_layers_by_index", f"WITH {BOXES}, {AREAS}, met AS (SELECT area FROM areas WHERE minx <= 500 AND maxx >= 200 AND miny <= 400 AND maxy >= 100) SELECT id % 60 AS feature, min(id) AS id FROM boxes JOIN met ON area = id // 8 % 40 WHERE area <> 3 AND minx <= 500 AND maxx >= 200 AND miny <= 400 AND maxy >= 100 GROUP BY 1")
def _(spark, d):
    """Features of a box from the layers whose areas meet it; one area of the index has no layer. A feature in several layers comes once."""
    b = boxes(spark, d).withColumns({"area": F.expr("id DIV 8 % 40"), "feature": F.col("id") % 60})
    root = files.shared_path(spark, "layers")
    feature_layers.write_layers(b.filter("area <> 3"), root, "road")
    index = b.groupBy("area").agg(*(f(c).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))))
    return feature_layers.read_layers(spark, root, "road", index, (200.0, 100.0, 500.0, 400.0), "feature", "id").select("feature", "id")


@query("geo10_checked_quadratic", B.trees("SELECT tile, count(*) AS n, true AS within, bool_and(l_linenumber % 2 = 0) AS approximated FROM (SELECT *, CAST(CASE WHEN l_linenumber % 2 = 0 THEN floor((x - 500000) / 100) ELSE -1 END AS INT) AS tile FROM trees) GROUP BY tile"))
def _(spark, d):
    """Web Mercator to UTM by a quadratic per tile: narrow tiles are approximated, one of 600 km is not; all points lie within 0.1 mm of the exact map."""
    even = F.col("l_linenumber") % 2 == 0
    t = tables.trees(spark, d).withColumns({"x": F.lit(-13024400.0) + (F.col("x") - 500000) * F.when(even, 1).otherwise(600), "y": F.lit(5942000.0) + (F.col("y") - 5200000)})
    exact = lambda x, y: spatial.utm(*spatial.from_mercator(x, y), 11)
    tile = F.when(even, F.floor((F.col("x") + 13024400) / 100)).otherwise(-1).cast("int")
    out = reprojection.reprojected(t, tile, exact)
    px, py = exact(F.col("x"), F.col("y"))
    out = out.withColumns({"dx": F.col("px") - px, "dy": F.col("py") - py})  # as columns, so that the map is computed once
    miss = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return out.groupBy("tile").agg(F.count("*").alias("n"), F.bool_and(miss <= 1e-4).alias("within"), F.bool_and("approximated").alias("approximated"))
