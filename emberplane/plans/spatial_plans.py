"""Queries over regions, footprints, lines and tile indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lattices, spatial
from ..registry import query
from ..sources import tables
from . import base_sql as B

BOXES = "boxes AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 900 AS DOUBLE) AS minx, CAST((s_suppkey * 91) % 900 AS DOUBLE) AS miny, CAST((s_suppkey * 37) % 900 + 20 + s_suppkey % 60 AS DOUBLE) AS maxx, CAST((s_suppkey * 91) % 900 + 20 + s_suppkey % 45 AS DOUBLE) AS maxy, s_acctbal AS density FROM supplier)"
SQUARE = [[(300.0, 300.0), (620.0, 310.0), (600.0, 640.0), (310.0, 600.0)]]


def boxes(spark, d):
    return tables.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS id", "CAST((s_suppkey * 37) % 900 AS DOUBLE) AS minx", "CAST((s_suppkey * 91) % 900 AS DOUBLE) AS miny",
        "CAST((s_suppkey * 37) % 900 + 20 + s_suppkey % 60 AS DOUBLE) AS maxx", "CAST((s_suppkey * 91) % 900 + 20 + s_suppkey % 45 AS DOUBLE) AS maxy", "s_acctbal AS density",
    )


def inside_sql(x: str, y: str, ring=SQUARE[0]) -> str:
    hits = [f"CASE WHEN {y} >= {min(y1, y2)} AND {y} < {max(y1, y2)} AND {x} < CAST({x1} AS DOUBLE) + ({y} - {y1}) * CAST({(x2 - x1) / (y2 - y1)!r} AS DOUBLE) THEN 1 ELSE 0 END" for x1, y1, x2, y2 in spatial.edges_of(ring) if y1 != y2]
    return f"(({' + '.join(hits)}) % 2 = 1)"


def centre(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) * 10 + 5)"


@query("geo01_cell_mask", B.cells(f"SELECT row, col FROM cells WHERE {inside_sql(centre('col'), centre('row'))}"))
def _(spark, d):
    return tables.cells(spark, d).select("row", "col").filter(spatial.inside(F.col("col").cast("double") * 10 + 5, F.col("row").cast("double") * 10 + 5, SQUARE))


def touched_sql() -> str:
    """A cell is touched where its centre is inside or an edge enters its square: the shares of the edge within the square's x and y overlap."""
    hits = [inside_sql(centre("col"), centre("row"))]
    for x1, y1, x2, y2 in spatial.edges_of(SQUARE[0]):
        low, high = ["0"], ["1"]
        for a, d, c in ((x1, x2 - x1, "col"), (y1, y2 - y1, "row")):
            ends = [f"({c} * 10 + {k} - {a}) / CAST({d} AS DOUBLE)" for k in (0, 10)]
            low.append(f"least({', '.join(ends)})")
            high.append(f"greatest({', '.join(ends)})")
        hits.append(f"greatest({', '.join(low)}) <= least({', '.join(high)})")
    return " OR ".join(hits)


@query("geo02_cells_touched", B.cells(f"SELECT row, col FROM cells WHERE {touched_sql()}"))
def _(spark, d):
    cells = tables.cells(spark, d)
    return cells.filter(spatial.box_touched(F.col("col").cast("double") * 10 + 5, F.col("row").cast("double") * 10 + 5, 5.0, SQUARE)).select("row", "col")


def corners_sql() -> str:
    """The polygon is convex: a square is within it where its four corners are on the inner side of every edge."""
    return " AND ".join(f"({x2 - x1}) * (row * 10 + {dy} - {y1}) - ({y2 - y1}) * (col * 10 + {dx} - {x1}) > 0" for x1, y1, x2, y2 in spatial.edges_of(SQUARE[0]) for dx in (0, 10) for dy in (0, 10))


@query("geo03_cells_strictly_within", B.cells(f"SELECT row, col FROM cells WHERE {corners_sql()}"))
def _(spark, d):
    return tables.cells(spark, d).filter(spatial.box_within(F.col("col").cast("double") * 10 + 5, F.col("row").cast("double") * 10 + 5, 5.0, SQUARE)).select("row", "col")


ROAD = [(500000.0, 5200100.0), (500500.0, 5200400.0), (501000.0, 5200350.0)]


def near_sql(w: float) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(ROAD, ROAD[1:]):
        dx, dy = x2 - x1, y2 - y1
        t = f"greatest(0, least(1, ((x - {x1}) * {dx} + (y - {y1}) * {dy}) / CAST({dx * dx + dy * dy} AS DOUBLE)))"
        parts.append(f"pow(x - {x1} - {t} * {dx}, 2) + pow(y - {y1} - {t} * {dy}, 2)")
    return f"least({', '.join(parts)}) <= {w * w}"


@query("geo05_trees_on_road", B.trees(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM trees WHERE {near_sql(6.5)}"))
def _(spark, d):
    return tables.trees(spark, d).filter(spatial.distance2(F.col("x"), F.col("y"), ROAD) <= 6.5 * 6.5).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("geo07_clip_segments", f"WITH {BOXES} SELECT id, round(least(maxx, 600), 4) AS x2, round(greatest(minx, 200), 4) AS x1, miny AS y1 FROM boxes WHERE miny BETWEEN 100 AND 700 AND maxx >= 200 AND minx <= 600")
def _(spark, d):
    lines = boxes(spark, d).select("id", F.col("minx").alias("x1"), F.col("miny").alias("y1"), F.col("maxx").alias("x2"), F.col("miny").alias("y2"))
    return spatial.clip_segments(lines, (200.0, 100.0, 600.0, 700.0)).select("id", F.round("x2", 4).alias("x2"), F.round("x1", 4).alias("x1"), "y1")


LONLAT = f"{BOXES}, ll AS (SELECT id, -117 + minx / 300 AS lon, 44 + miny / 300 AS lat FROM boxes)"


def utm_sql() -> str:
    """Meridian arc and the classic series in powers of the distance from the central meridian (another one than the library's)."""
    e2, k0, a = spatial.WGS84_F * (2 - spatial.WGS84_F), 0.9996, 6378137.0
    ep2 = e2 / (1 - e2)
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072]
    return f"""WITH {LONLAT}, p AS (SELECT id, radians(lat) AS f, cos(radians(lat)) * radians(lon + 117) AS A FROM ll),
 q AS (SELECT id, A, f, tan(f) AS tn, pow(tan(f), 2) AS T, {ep2!r} * pow(cos(f), 2) AS C, {a} / sqrt(1 - {e2!r} * pow(sin(f), 2)) AS N, {a} * ({arc[0]!r} * f - {arc[1]!r} * sin(2*f) + {arc[2]!r} * sin(4*f) - {arc[3]!r} * sin(6*f)) AS M FROM p)
 SELECT id, round(500000 + {k0} * N * (A + (1 - T + C) * pow(A, 3) / 6 + (5 - 18*T + T*T + 72*C - 58 * {ep2!r}) * pow(A, 5) / 120), 0) AS easting,
 round({k0} * (M + N * tn * (A*A / 2 + (5 - T + 9*C + 4*C*C) * pow(A, 4) / 24 + (61 - 58*T + T*T + 600*C - 330 * {ep2!r}) * pow(A, 6) / 720)), 0) AS northing FROM q"""


def placed(spark, d):
    return boxes(spark, d).select("id", (F.lit(-117.0) + F.col("minx") / 300).alias("lon"), (F.lit(44.0) + F.col("miny") / 300).alias("lat"))


@query("geo10_utm", utm_sql())
def _(spark, d):
    e, n = spatial.utm(F.col("lon"), F.col("lat"), 11)
    return placed(spark, d).select("id", F.round(e, 0).alias("easting"), F.round(n, 0).alias("northing"))


@query("geo10_utm_and_back", f"WITH {LONLAT} SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM ll")
def _(spark, d):
    e, n = spatial.utm(F.col("lon"), F.col("lat"), 11)
    p = placed(spark, d).select("id", e.alias("e"), n.alias("n"))
    lon, lat = spatial.lonlat(F.col("e"), F.col("n"), 11)
    return p.select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("geo10_mercator", f"WITH {LONLAT} SELECT id, round(6378137 * radians(lon), 4) AS x, round(6378137 * asinh(tan(radians(lat))), 4) AS y FROM ll")
def _(spark, d):
    x, y = spatial.mercator(F.col("lon"), F.col("lat"))
    back = spatial.from_mercator(x, y)
    return placed(spark, d).filter((F.abs(back[0] - F.col("lon")) < 1e-9) & (F.abs(back[1] - F.col("lat")) < 1e-9)).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("geo11_domain_checks", f"WITH {BOXES} SELECT id, (maxx - minx) * (maxy - miny) AS area, (maxx - minx) * (maxy - miny) <= 2500 AS small, CAST(floor((minx / 10 - 120 + 180) / 6) + 1 AS INT) AS zone FROM boxes")
def _(spark, d):
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return boxes(spark, d).select("id", area.alias("area"), (area <= 2500).alias("small"), (F.floor((F.col("minx") / 10 - 120 + 180) / 6) + 1).cast("int").alias("zone"))


BOUNDARY = [(40.5, 33.5), (901.5, 92.5), (863.5, 938.5), (421.5, 640.5), (97.5, 881.5)]


def meets_sql(ring) -> str:
    """An edge meets a box where its shares within the x and the y of the box overlap."""
    hits = []
    for x1, y1, x2, y2 in spatial.edges_of(ring):
        ends = {c: [f"(CAST({b}{c} AS DOUBLE) - {a}) / CAST({v} AS DOUBLE)" for b in ("min", "max")] for c, a, v in (("x", x1, x2 - x1), ("y", y1, y2 - y1))}
        hits.append(f"greatest(0, {', '.join(f'least({a}, {b})' for a, b in ends.values())}) <= least(1, {', '.join(f'greatest({a}, {b})' for a, b in ends.values())})")
    return " OR ".join(hits)


@query("geo11_domain_faults", f"WITH {BOXES} SELECT id, CASE WHEN id % 7 = 0 THEN 'crs' WHEN id % 11 = 0 THEN 'area' WHEN NOT {inside_sql('minx', 'miny', BOUNDARY)} OR {meets_sql(BOUNDARY)} THEN 'boundary' WHEN (maxx - minx) * (maxy - miny) > 2500 THEN 'too_large' END AS fault, CASE WHEN id % 11 = 0 THEN 0 ELSE (maxx - minx) * (maxy - miny) END AS area FROM boxes")
def _(spark, d):
    """Domains are the boxes as rings; some have no code of a reference system, some lie on a line."""
    top = F.when(F.col("id") % 11 == 0, F.col("miny")).otherwise(F.col("maxy"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), y.alias("y"))
    ring = F.array(corner("minx", F.col("miny")), corner("maxx", F.col("miny")), corner("maxx", top), corner("minx", top))
    rings = boxes(spark, d).select("id", F.when(F.col("id") % 7 == 0, "zone 11").otherwise("EPSG:32611").alias("crs"), ring.alias("ring"))
    return rings.select("id", spatial.domain_fault([BOUNDARY], 2500.0).alias("fault"), spatial.ring_area(F.col("ring")).alias("area"))


HOLE = [(401.0, 402.0), (503.0, 409.0), (489.0, 511.0)]


@query("win05_domain_areas", f"WITH {BOXES}, held AS (SELECT id, count(*) AS n FROM boxes, range(250) r, range(250) c WHERE r.range * 4 + 2 BETWEEN miny AND maxy AND c.range * 4 + 2 BETWEEN minx AND maxx AND {inside_sql('(CAST(c.range AS DOUBLE) * 4 + 2)', '(CAST(r.range AS DOUBLE) * 4 + 2)')} AND NOT {inside_sql('(CAST(c.range AS DOUBLE) * 4 + 2)', '(CAST(r.range AS DOUBLE) * 4 + 2)', HOLE)} GROUP BY id) SELECT id, round(coalesce(n, 0) * CAST(0.0016 AS DOUBLE), 6) AS area_ha, coalesce(n, 0) > 62 AS too_large FROM boxes LEFT JOIN held USING (id)")
def _(spark, d):
    """Hectares of each domain within one polygon and outside of another, over a limit of 0.1."""
    out = lattices.region_areas(boxes(spark, d), [("within", SQUARE), ("outside", [HOLE])], 4.0, 0.1)
    return out.select("id", F.round("area_ha", 6).alias("area_ha"), "too_large")


# The unit and the dimensions that each role of a landscape needs.
LANDSCAPE = {
    "elevation": ("m", 2), "slope": ("deg", 2), "aspect": ("deg", 2), "fuel_model": (None, 2), "canopy_cover": ("%", 2), "canopy_height": ("m", 2),
    "canopy_base_height": ("m", 2), "canopy_bulk_density": ("kg/m**3", 2),
}
ROLES = [*LANDSCAPE, "tree_density", "humidity"]


@query("lat05_role_contract", f"WITH {BOXES}, g AS (SELECT id, ['{"', '".join(ROLES)}'][id % 10 + 1] AS role, id % 3 AS k, id % 7 AS l FROM boxes) SELECT id, role, CASE WHEN role = 'humidity' THEN 'role' WHEN k = 2 THEN 'band' WHEN role IN ('slope', 'aspect', 'canopy_cover', 'canopy_bulk_density') OR role = 'tree_density' AND k = 1 THEN 'unit' WHEN (l < 5) = (role = 'tree_density') THEN 'dimensions' WHEN role = 'tree_density' AND l = 6 THEN 'vertical' END AS fault FROM g")
def _(spark, d):
    """Grids with bands in metres and without a unit, of two dimensions or three, against the roles of exports."""
    k, l = F.col("id") % 3, F.col("id") % 7  # noqa: E741
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("id") % 10 + 1).cast("int"))
    band = F.when(k == 0, "b0").when(k == 1, "b1").otherwise("b2")
    bands = F.create_map(F.lit("b0"), F.lit("m"), F.lit("b1"), F.when(role == "tree_density", "deg").otherwise("m"))
    g = boxes(spark, d).select("id", role.alias("role"), band.alias("band"), bands.alias("bands"), F.when(l < 5, 2).otherwise(3).alias("dims"), F.lit(1.0).alias("z_cell"), F.when(l == 6, 9).otherwise(8).alias("nz"), F.lit(0.0).alias("z0"))
    g = g.withColumns({"t_z_cell": F.lit(1.0), "t_nz": F.lit(8), "t_z0": F.lit(0.0)})
    return g.select("id", "role", lattices.contract_fault(LANDSCAPE | {"tree_density": ("m", 3)}).alias("fault"))


@query("geo13_contribution", B.trees(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(id) AS first_id FROM trees t JOIN (WITH {BOXES} SELECT * FROM boxes) b ON t.x - 500000 BETWEEN minx AND maxx AND t.y - 5200000 BETWEEN miny AND maxy GROUP BY ALL"))
def _(spark, d):
    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # Of boxes with the same bounds only the first can be chosen.
    first = boxes(spark, d).groupBy("minx", "miny", "maxx", "maxy").agg(F.min("id").alias("id"))
    t = tables.trees(spark, d).select(*k, (F.col("x") - 500000).alias("x"), (F.col("y") - 5200000).alias("y"))
    return spatial.in_boxes(t, first, 50.0).groupBy(*k).agg(F.min("id").alias("first_id"))


PRODUCTS = "products AS (SELECT s_nationkey AS product, s_suppkey AS part, CAST((s_suppkey * 53) % 800 AS DOUBLE) AS px0, CAST((s_suppkey * 53) % 800 + 120 AS DOUBLE) AS px1, CAST((s_suppkey * 29) % 800 AS DOUBLE) AS py0, CAST((s_suppkey * 29) % 800 + 120 AS DOUBLE) AS py1 FROM supplier)"
CELL_SPAN = "JOIN range(200) a ON a.range * 10 + 5 BETWEEN {y0} AND {y1} JOIN range(200) b ON b.range * 10 + 5 BETWEEN {x0} AND {x1}"


@query("geo14_coverage_status", f"WITH {BOXES}, {PRODUCTS}, want AS (SELECT id, id % 30 AS product, a.range AS r, b.range AS c FROM boxes {CELL_SPAN.format(y0='miny', y1='maxy', x0='minx', x1='maxx')}), have AS (SELECT DISTINCT product, a.range AS r, b.range AS c FROM products {CELL_SPAN.format(y0='py0', y1='py1', x0='px0', x1='px1')}) SELECT id, CASE WHEN min(want.product) NOT IN (SELECT product FROM products) THEN 'no_such_product' WHEN count(h.r) = count(*) THEN 'full' WHEN count(h.r) = 0 THEN 'none' ELSE 'partial' END AS status FROM want LEFT JOIN have h USING (product, r, c) GROUP BY id")
def _(spark, d):
    """How much of each region the parts of its product cover, by the centres of 10 m cells."""
    parts = tables.table(spark, d, "supplier").selectExpr("s_nationkey AS product", "CAST((s_suppkey * 53) % 800 AS DOUBLE) AS minx", "CAST((s_suppkey * 53) % 800 + 120 AS DOUBLE) AS maxx", "CAST((s_suppkey * 29) % 800 AS DOUBLE) AS miny", "CAST((s_suppkey * 29) % 800 + 120 AS DOUBLE) AS maxy")
    return lattices.coverage_status(boxes(spark, d).withColumn("product", F.col("id") % 30), parts, 10.0)


@query("geo15_expected_points", f"WITH {BOXES} SELECT id, CAST(0 AS DOUBLE) + round(density * greatest(0, least(maxx, 500) - greatest(minx, 0)) / (maxx - minx), 4) AS expected FROM boxes")
def _(spark, d):
    share = F.greatest(F.lit(0.0), F.least(F.col("maxx"), F.lit(500.0)) - F.greatest(F.col("minx"), F.lit(0.0))) / (F.col("maxx") - F.col("minx"))
    return boxes(spark, d).select("id", (F.lit(0.0) + F.round(F.col("density") * share, 4)).alias("expected"))


@query("geo16_tile_names", f"WITH {BOXES} SELECT id, 'n' || CAST(n.range + 1 AS BIGINT) || 'e' || CAST(e.range AS BIGINT) AS tile FROM boxes JOIN range(100) n ON n.range BETWEEN floor(miny / 10) AND ceil(maxy / 10) - 1 JOIN range(100) e ON e.range BETWEEN floor(minx / 10) AND ceil(maxx / 10) - 1")
def _(spark, d):
    """All tiles of each region: named by the upper edge and the left edge in steps of the tile."""
    return spatial.tile_names(boxes(spark, d), 10.0).select("id", "tile")


@query("geo16_degree_tile_names", f"WITH {BOXES}, ll AS (SELECT id, -120 + minx / 100 AS w, -120 + maxx / 100 AS e, 40 + miny / 100 AS s, 40 + maxy / 100 AS n FROM boxes) SELECT id, 'n' || CAST(a.range + 1 AS BIGINT) || 'w' || lpad(CAST(-b.range AS VARCHAR), 3, '0') AS tile FROM ll JOIN range(0, 90) a ON a.range BETWEEN floor(s) AND ceil(n) - 1 JOIN range(-180, 0) b ON b.range BETWEEN floor(w) AND ceil(e) - 1")
def _(spark, d):
    """One-degree tiles by their north-west corner."""
    ll = boxes(spark, d).select("id", (F.lit(-120.0) + F.col("minx") / 100).alias("minx"), (F.lit(-120.0) + F.col("maxx") / 100).alias("maxx"), (F.lit(40.0) + F.col("miny") / 100).alias("miny"), (F.lit(40.0) + F.col("maxy") / 100).alias("maxy"))
    return spatial.degree_tile_names(ll).select("id", "tile")


@query("join13_footprint_overlap", f"WITH {BOXES} SELECT a.id AS a_id, b.id AS b_id, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area FROM boxes a JOIN boxes b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy")
def _(spark, d):
    b = boxes(spark, d).drop("density")
    return spatial.overlaps(b.withColumnRenamed("id", "a_id"), b.withColumnRenamed("id", "b_id"), 50.0)


@query("src11_tile_index_lookup", f"WITH {BOXES} SELECT id FROM boxes WHERE minx <= 400 AND maxx >= 200 AND miny <= 500 AND maxy >= 300")
def _(spark, d):
    return boxes(spark, d).filter("minx <= 400 AND maxx >= 200 AND miny <= 500 AND maxy >= 300").select("id")


@query("src09_features_deduped", f"WITH {BOXES} SELECT id % 40 AS feature, min(id) AS id FROM boxes WHERE minx <= 600 GROUP BY 1")
def _(spark, d):
    b = boxes(spark, d).filter("minx <= 600").withColumn("feature", F.col("id") % 40)
    return b.filter("id % 2 = 0").unionByName(b.filter("id % 2 <> 0")).groupBy("feature").agg(F.min("id").alias("id"))


@query("lat03_padded_domains", f"WITH {BOXES} SELECT id, floor(minx / 30) * 30 AS minx, floor(miny / 30) * 30 AS miny, ceil(maxx / 30) * 30 AS maxx, ceil(maxy / 30) * 30 AS maxy FROM boxes")
def _(spark, d):
    return lattices.padded(boxes(spark, d), 30.0).select("id", "minx", "miny", "maxx", "maxy")


@query("lat01_lattice_of_boxes", f"WITH {BOXES}, sized AS (SELECT id, minx, miny, greatest(1, CAST(ceil((maxx - minx) / 30) AS BIGINT)) AS cols, greatest(1, CAST(ceil((maxy - miny) / 30) AS BIGINT)) AS rows FROM boxes) SELECT id, CAST(a.range AS INT) AS row, CAST(b.range AS INT) AS col, minx + (b.range + 0.5) * 30 AS x, miny + (rows - a.range - 0.5) * 30 AS y FROM sized JOIN range(100) a ON a.range < rows JOIN range(100) b ON b.range < cols")
def _(spark, d):
    """All cells of each region's lattice, anchored at its lower left corner."""
    return lattices.cells_of(boxes(spark, d), 30.0).select("id", "row", "col", "x", "y")
