"""Queries over cells, lattices, points and voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import grids, lattices, pointcloud, rules, voxels
from ..operators.rules import Action, Condition, Rule
from ..registry import query
from ..sources import files, tables
from . import base_sql as B

HALF = "CAST(0.5 AS DOUBLE)"


def rounded(df, *cols, n=7):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("prj08_masked_cells", B.cells("SELECT row, col, round(CASE WHEN n > 5 AND mean_height < 20 THEN 0 WHEN n > 5 THEN mean_height - 20 ELSE mean_height END, 7) AS mean_height FROM cells"))
def _(spark, d):
    return rounded(rules.edit_cells(tables.cells(spark, d), [Rule((Action("mean_height", "subtract", 20.0),), (Condition("n", "gt", 5),))]).select("row", "col", "mean_height"), "mean_height")


@query("prj12_select_else", B.cells("SELECT row, col, round(CASE WHEN n >= 6 THEN mean_height ELSE -1 END, 7) AS v FROM cells"))
def _(spark, d):
    c = tables.cells(spark, d)
    return c.select("row", "col", F.round(F.when(rules.predicate(Condition("n", "ge", 6), True), F.col("mean_height")).otherwise(-1.0), 7).alias("v"))


for op, sql in {"add": "mean_height + max_height", "subtract": "max_height - mean_height", "multiply": "mean_height * max_height", "divide": "CASE WHEN mean_height <> 0 THEN max_height / mean_height END", "average": "(max_height + mean_height) / 2", "max": "greatest(max_height, mean_height)", "min": "least(max_height, mean_height)"}.items():
    @query(f"prj13_compute_{op}", B.cells(f"SELECT row, col, round({sql}, 7) AS v FROM cells"))
    def _(spark, d, op=op):
        return tables.cells(spark, d).select("row", "col", F.round(rules.compute(op, F.col("max_height"), F.col("mean_height")), 7).alias("v"))


@query("prj17_band_scaling", "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) / 10 END AS v FROM orders")
def _(spark, d):
    raw = F.when(F.col("o_custkey") % 7 == 0, F.lit(-9999)).otherwise(F.col("o_custkey"))
    return tables.table(spark, d, "orders").select("o_orderkey", rules.descaled(raw, 32767, 10).alias("v"))


@query("join07_cell_join", B.cells("SELECT c.row, c.col, c.n, round(t.s, 7) AS dbh FROM cells c JOIN (SELECT row, col, sum(dbh) AS s FROM located GROUP BY row, col) t USING (row, col)"))
def _(spark, d):
    other = tables.located(tables.trees(spark, d)).groupBy("row", "col").agg(F.sum("dbh").alias("dbh"))
    return rounded(tables.cells(spark, d).join(other, ["row", "col"]).select("row", "col", "n", "dbh"), "dbh")


@query("join08_offset_join", B.cells("SELECT a.row, a.col, a.n, b.n AS other FROM cells a JOIN cells b ON a.row = b.row - 3 AND a.col = b.col - 5"))
def _(spark, d):
    c = tables.cells(spark, d)
    return c.select("row", "col", "n").join(c.select((F.col("row") - 3).alias("row"), (F.col("col") - 5).alias("col"), F.col("n").alias("other")), ["row", "col"])


@query("agg01_band_summary", B.cells("SELECT 'mean_height' AS \"column\", count(mean_height) AS n, count(*) - count(mean_height) AS null_count, round(min(mean_height), 7) AS min, round(max(mean_height), 7) AS max, round(avg(mean_height), 7) AS mean, round(stddev_pop(mean_height), 7) AS std FROM cells"))
def _(spark, d):
    from ..operators import stand

    return rounded(stand.column_summary(tables.cells(spark, d), ["mean_height"], sample=False), "min", "max", "mean", "std")


def settled(df, c):
    """Rounded off the ties that short decimals make."""
    return df.withColumn(c, F.round(F.col(c) + 1e-9, 4))


def metres(spark, d):
    """Points in metres from the square's corner, with height h over 1000 m."""
    p = tables.points(spark, d)
    return p.withColumns({"x_m": F.col("X") * F.lit(0.01), "y_m": F.col("Y") * F.lit(0.01), "h": F.col("Z") * F.lit(0.01) - 1000})


METRES = f"{B.POINTS}, metres AS (SELECT *, CAST(floor((1000 - Y * CAST(0.01 AS DOUBLE)) / 5) AS INT) AS row, CAST(floor(X * CAST(0.01 AS DOUBLE) / 5) AS INT) AS col, Z * CAST(0.01 AS DOUBLE) - 1000 AS h FROM points)"

for how, sql in {"mean": "avg(h)", "max": "max(h)"}.items():
    @query(f"agg06_rasterize_{how}", f"WITH {METRES} SELECT row, col, round({sql}, 7) AS v FROM metres WHERE classification IN (2, 5) GROUP BY row, col")
    def _(spark, d, how=how):
        return rounded(pointcloud.rasterized(metres(spark, d), 5.0, how, (2, 5), y1=1000.0), "v")


for how, sql in {"max": "max(h)", "mean": "avg(h)", "median": "median(h)", "percentile": "quantile_cont(h, 0.95)"}.items():
    @query(f"agg09_height_{how}_of_points", f"WITH {METRES} SELECT row, col, round({sql}, 7) AS v FROM metres GROUP BY row, col")
    def _(spark, d, how=how):
        return rounded(pointcloud.rasterized(metres(spark, d), 5.0, how, percentile=95.0, y1=1000.0), "v")


@query("agg07_rasterize_min", B.cells("SELECT row, col, min(height) AS v FROM located WHERE l_linenumber < 6 GROUP BY row, col"))
def _(spark, d):
    return tables.located(tables.trees(spark, d)).filter("l_linenumber < 6").groupBy("row", "col").agg(F.min("height").alias("v"))


@query("agg08_ground_snap", B.cells("SELECT row, col, round(avg(height), 7) AS v FROM located JOIN (SELECT row, col, min(height) AS g FROM located GROUP BY row, col) USING (row, col) WHERE abs(height - g) <= 0.5 GROUP BY row, col"))
def _(spark, d):
    t = tables.located(tables.trees(spark, d))
    g = t.groupBy("row", "col").agg(F.min("height").alias("g"))
    return rounded(t.join(g, ["row", "col"]).filter("abs(height - g) <= 0.5").groupBy("row", "col").agg(F.avg("height").alias("v")), "v")


@query("agg09_height_percentile", B.cells("SELECT row, col, round(quantile_cont(height, 0.9), 7) AS p90, round(median(height), 7) AS med FROM located GROUP BY row, col"))
def _(spark, d):
    t = tables.located(tables.trees(spark, d))
    return rounded(t.groupBy("row", "col").agg(F.percentile("height", F.lit(0.9)).alias("p90"), F.percentile("height", F.lit(0.5)).alias("med")), "p90", "med")


@query("agg10_point_summary", B.points("SELECT *, round(n / ((maxx - minx) * CAST(0.01 AS DOUBLE) * ((maxy - miny) * CAST(0.01 AS DOUBLE))), 9) AS density FROM (SELECT count(*) AS n, count(DISTINCT classification) AS classes, min(X) AS minx, max(X) AS maxx, min(Y) AS miny, max(Y) AS maxy, min(Z) AS minz, max(Z) AS maxz FROM points)"))
def _(spark, d):
    return rounded(pointcloud.summary(tables.points(spark, d)), "density", n=9)


@query("agg11_points_per_tile", B.points("SELECT CAST(floor(X * 0.01 / 50) AS INT) AS tile_x, CAST(floor(Y * 0.01 / 50) AS INT) AS tile_y, count(*) AS n FROM points GROUP BY 1, 2"))
def _(spark, d):
    return pointcloud.tiled(tables.points(spark, d), 50.0).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


PKEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
TILED = f"tiled AS (SELECT *, CAST(floor(X * 0.01 / 50) AS INT) AS tile_x, CAST(floor(Y * 0.01 / 50) AS INT) AS tile_y FROM points), placed AS (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY {PKEY}) - 1 AS i FROM tiled), lods AS (SELECT *, CAST(CASE WHEN i % 1024 = 0 THEN 0 WHEN i % 256 = 0 THEN 1 WHEN i % 64 = 0 THEN 2 WHEN i % 16 = 0 THEN 3 WHEN i % 4 = 0 THEN 4 ELSE 5 END AS INT) AS lod FROM placed)"


def leveled(spark, d):
    return pointcloud.with_lod(pointcloud.tiled(tables.points(spark, d), 50.0), tuple(PKEY.split(", ")))


@query("win06_levels_of_detail", f"WITH {B.POINTS}, {TILED} SELECT {PKEY}, tile_x, tile_y, lod FROM lods")
def _(spark, d):
    return leveled(spark, d).select(*PKEY.split(", "), "tile_x", "tile_y", "lod")


@query("win07_tile_catalogue", f"WITH {B.POINTS}, {TILED} SELECT tile_x, tile_y, lod, n, CAST(sum(n) OVER (PARTITION BY tile_x, tile_y ORDER BY lod) AS BIGINT) AS upto FROM (SELECT tile_x, tile_y, lod, count(*) AS n FROM lods GROUP BY ALL)")
def _(spark, d):
    return pointcloud.tile_catalogue(leveled(spark, d))


@query("src06_read_points", f"WITH {B.POINTS}, {TILED} SELECT {PKEY}, round(X * CAST(0.01 AS DOUBLE), 2) AS x_m, round(Y * CAST(0.01 AS DOUBLE), 2) AS y_m FROM lods WHERE tile_x BETWEEN 2 AND 8 AND tile_y BETWEEN 4 AND 10 AND lod <= 4 AND classification IN (1, 2, 5)")
def _(spark, d):
    p = pointcloud.read_points(leveled(spark, d), (120.0, 220.0, 440.0, 540.0), 50.0, (1, 2, 5), 4)
    return rounded(p.select(*PKEY.split(", "), "x_m", "y_m"), "x_m", "y_m", n=2)


@query("src08_write_points", f"WITH {B.POINTS}, {TILED} SELECT {PKEY}, round(X * CAST(0.01 AS DOUBLE), 2) AS x_m, round(Y * CAST(0.01 AS DOUBLE), 2) AS y_m FROM lods WHERE X BETWEEN 12000 AND 44000 AND Y BETWEEN 22000 AND 54000 AND lod <= 4 AND classification IN (1, 2, 5)")
def _(spark, d):
    """The tiled table is written and read back; the read opens the folders of its tiles and levels only."""
    path = files.shared_path(spark, "points")
    pointcloud.write_points(leveled(spark, d), path)
    p = pointcloud.read_points(spark.read.parquet(path), (120.0, 220.0, 440.0, 540.0), 50.0, (1, 2, 5), 4, exact=True)
    return rounded(p.select(*PKEY.split(", "), "x_m", "y_m"), "x_m", "y_m", n=2)


@query("sc10_rescale", B.points(f"SELECT {PKEY}, CAST(round(X * CAST(0.01 AS DOUBLE) / {HALF}) AS INT) AS half FROM points"))
def _(spark, d):
    return tables.points(spark, d).select(*PKEY.split(", "), F.round(F.col("X") * F.lit(0.01) / F.lit(0.5)).cast("int").alias("half"))


TON_ACRE = repr(units.factor("short_ton/acre", "kg/m2"))
FUELS = "fuels AS (SELECT CAST(91 + p_partkey % 45 AS INT) AS code, min(p_size) AS tons FROM part GROUP BY 1)"


def fuels(spark, d):
    return tables.table(spark, d, "part").groupBy((91 + F.col("p_partkey") % 45).cast("int").alias("code")).agg(F.min("p_size").alias("tons"))


def metric(tons):
    return F.round(units.convert(tons, "short_ton/acre", "kg/m2").cast("float").cast("double"), 6)


@query("join01_fuel_lookup", B.codes(f"SELECT row, col, nullif(c.code, 32767) AS code, round(CAST(CAST(tons * CAST({TON_ACRE} AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS load FROM codes c LEFT JOIN (WITH {FUELS} SELECT * FROM fuels) f ON c.code = f.code AND c.code <> 32767"))
def _(spark, d):
    return grids.lookup(tables.fuel_codes(spark, d), "code", fuels(spark, d), 32767, strict=True).select("row", "col", "code", metric(F.col("tons")).alias("load"))


SPARSE = "SELECT row, col, CAST(code * 10000 + n % 4 AS INT) AS code FROM codes WHERE code <> 32767"


def sparse_codes(spark, d):
    return tables.fuel_codes(spark, d).filter("code <> 32767").selectExpr("row", "col", "CAST(code * 10000 + n % 4 AS INT) AS code")


def sparse_fuels(spark, d):
    """The fuels' variants 0 to 2; variant 3 of a known base has no row."""
    return fuels(spark, d).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select((F.col("code") * 10000 + F.col("variant")).alias("code"), (F.col("tons") + F.col("variant")).alias("tons"))


@query("join02_sparse_lookup", B.codes(f"SELECT row, col, s.code, CASE WHEN s.code % 10000 < 3 THEN round(CAST(CAST((tons + s.code % 10000) * CAST({TON_ACRE} AS DOUBLE) AS FLOAT) AS DOUBLE), 6) END AS load FROM ({SPARSE}) s JOIN (WITH {FUELS} SELECT * FROM fuels) f ON s.code // 10000 = f.code"))
def _(spark, d):
    return grids.lookup(sparse_codes(spark, d), "code", sparse_fuels(spark, d), strict=True, base=10000).select("row", "col", "code", metric(F.col("tons")).alias("load"))


@query("join02_unknown_codes", B.codes(f"SELECT DISTINCT code FROM ({SPARSE}) WHERE code % 10000 = 3"))
def _(spark, d):
    return grids.unknown_codes(sparse_codes(spark, d), "code", sparse_fuels(spark, d))


LISTED, ROUNDS = "(91, 98, 32767)", 12


def seen_sql(cells: str, source: str, extent: str, columns: str) -> str:
    """Each cell with the cells of its window; beyond the lattice's edge the nearest cell."""
    return f"(SELECT s.*, n.* EXCLUDE (row, col) FROM (SELECT c.row, c.col, {columns} greatest(r0, least(r1, c.row + dr)) AS nr, greatest(c0, least(c1, c.col + dc)) AS nc FROM {cells} c, off, {extent}) s JOIN {source} n ON n.row = s.nr AND n.col = s.nc)"


def refill_sql() -> str:
    """Rounds of the filter one after the other, and the first after which nothing is listed or nothing was replaced."""
    parts, ends = ["ext AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM codes)", "g0 AS (SELECT row, col, code FROM codes)"], []
    for k in range(1, ROUNDS + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT row, col, own, code AS v, count(*) AS k FROM {seen_sql(f'g{k - 1}', f'g{k - 1}', 'ext', 'c.code AS own,')} GROUP BY ALL)")
        parts.append(f"g{k} AS MATERIALIZED (SELECT row, col, CASE WHEN own NOT IN {LISTED} AND max(k) FILTER (v = own) = max(k) THEN own ELSE coalesce(arg_max(v, (k, v)) FILTER (v NOT IN {LISTED}), own) END AS code FROM s{k} GROUP BY row, col, own)")
    parts.append("lefts AS (" + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n FROM g{k} WHERE code IN {LISTED}" for k in range(ROUNDS + 1)) + ")")
    parts.append("last AS (SELECT min(a.k) AS k FROM lefts a JOIN lefts b ON b.k = a.k - 1 WHERE a.n = 0 OR a.n = b.n)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM g{k}" for k in range(1, ROUNDS + 1))
    return B.codes(f"SELECT c.row, c.col, CASE WHEN c.code IN {LISTED} THEN g.code ELSE c.code END AS code FROM codes c JOIN ({every}) g USING (row, col) WHERE g.k = (SELECT k FROM last)").replace(B.CODES + " ", B.CODES + f", {B.window(2)}, {', '.join(parts)} ")


@query("foc01_majority_refill", B.region(refill_sql()))
def _(spark, d):
    codes = tables.fuel_codes(spark, d, tables.region_trees(spark, d)).select("row", "col", "code")
    return grids.refill_majority(codes, "code", [91, 98, 32767], lambda df: files.written(df, "refill"))


def gradient_sql(c: str, after: str, before: str) -> str:
    return f"CASE WHEN c.{c} = (SELECT min({c}) FROM surface) THEN ({after}.z - c.z) / 5 WHEN c.{c} = (SELECT max({c}) FROM surface) THEN (c.z - {before}.z) / 5 ELSE ({after}.z - {before}.z) / 10 END"


@query("foc02_slope_aspect", B.region(B.surface(f"""SELECT row, col, round(degrees(atan(sqrt(dx*dx + dy*dy))), 7) AS slope, CAST(0 AS DOUBLE) + round(CASE WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 7) AS aspect
 FROM (SELECT c.row, c.col, {gradient_sql('col', 'e', 'w')} AS dx, {gradient_sql('row', 's', 'n')} AS dy FROM surface c LEFT JOIN surface e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN surface w ON w.row = c.row AND w.col = c.col - 1 LEFT JOIN surface s ON s.row = c.row + 1 AND s.col = c.col LEFT JOIN surface n ON n.row = c.row - 1 AND n.col = c.col)""")))
def _(spark, d):
    return rounded(grids.slope_aspect(tables.surface(spark, d, tables.region_trees(spark, d)), "z", 5.0), "slope", "aspect").withColumn("aspect", F.lit(0.0) + F.col("aspect"))


NEAR = "off AS (SELECT a.range - {k} AS dr, b.range - {k} AS dc FROM range({w}) a, range({w}) b), near AS (SELECT c.row - dr AS row, c.col - dc AS col, dr, dc, c.{v} AS near FROM cells c, off)"


#: Means of hundredths by 8, 64, ... neighbours lie on ties of the sixth decimal, where the order of a sum decides; this puts them beside.
ASIDE = 3.14e-8


def fill_sql(rings: int) -> str:
    parts = ["f0 AS (SELECT row, col, z FROM surface WHERE n % 4 <> 1)", "ext AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM f0)", "every AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT unnest(range(r0, r1 + 1)) AS r FROM ext), (SELECT unnest(range(c0, c1 + 1)) AS c FROM ext))"]
    for k in range(1, rings + 1):
        gaps = f"(SELECT * FROM every ANTI JOIN f{k - 1} USING (row, col))"
        parts.append(f"f{k} AS MATERIALIZED (SELECT * FROM f{k - 1} UNION ALL SELECT row, col, avg(z) FROM {seen_sql(gaps, f'f{k - 1}', 'ext', '')} GROUP BY row, col)")
    return f"WITH {B.TREES}, {B.SURFACE}, {B.window(1)}, {', '.join(parts)} SELECT row, col, round(z + {ASIDE!r}::DOUBLE, 6) AS z FROM every LEFT JOIN f{rings} USING (row, col)"


@query("foc04_fill_gaps", B.region(fill_sql(6)))
def _(spark, d):
    """Gaps of up to 30 m."""
    out = grids.fill_gaps(tables.surface(spark, d, tables.region_trees(spark, d)).filter("n % 4 <> 1"), "z", 6)
    return rounded(out.withColumn("z", F.col("z") + ASIDE), "z", n=6)


@query("foc06_drop_spikes", B.region(f"WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, {NEAR.format(k=1, w=3, v='max_height')}, top AS (SELECT row, col, max(near) AS t FROM near WHERE dr <> 0 OR dc <> 0 GROUP BY row, col) SELECT c.row, c.col, CASE WHEN coalesce(max_height - t > 0.2, false) THEN NULL ELSE max_height END AS max_height FROM cells c LEFT JOIN top USING (row, col)"))
def _(spark, d):
    return grids.drop_spikes(tables.cells(spark, d, tables.region_trees(spark, d)).select("row", "col", "max_height"), "max_height", 1, 0.2)


@query("foc08_local_maxima", B.region(f"WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, {NEAR.format(k=2, w=5, v='max_height')}, top AS (SELECT row, col, max(CASE WHEN near <= 41 THEN near ELSE 0 END) AS t FROM near WHERE dr*dr + dc*dc <= 4 GROUP BY row, col) SELECT c.row, c.col, max_height FROM cells c JOIN top USING (row, col) WHERE max_height <= 41 AND max_height = t AND max_height >= 2"))
def _(spark, d):
    return grids.local_maxima(tables.cells(spark, d, tables.region_trees(spark, d)), "max_height", 2, 2.0, 41.0)


@query("foc10_bilinear", f"""WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, p AS (SELECT *, greatest(0, least(99, (x - 500000)/10 - {HALF})) AS fx, greatest(0, least(99, (5201000 - y)/10 - {HALF})) AS fy FROM trees),
 q AS (SELECT *, CAST(least(floor(fx), 98) AS INT) AS c, CAST(least(floor(fy), 98) AS INT) AS r FROM p)
 SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, round((a.mean_height*(1-(fx-c)) + b.mean_height*(fx-c))*(1-(fy-r)) + (d.mean_height*(1-(fx-c)) + e.mean_height*(fx-c))*(fy-r), 6) AS z
 FROM q LEFT JOIN cells a ON a.row = r AND a.col = c LEFT JOIN cells b ON b.row = r AND b.col = c + 1 LEFT JOIN cells d ON d.row = r + 1 AND d.col = c LEFT JOIN cells e ON e.row = r + 1 AND e.col = c + 1""")
def _(spark, d):
    t = tables.trees(spark, d).select(*PKEY.split(", "), "x", "y")
    ground = tables.cells(spark, d).select("row", "col", F.col("mean_height").alias("z"))
    return rounded(grids.bilinear(t, ground, "z", 10.0, 500000.0, 5201000.0, 100, 100).select(*PKEY.split(", "), "z"), "z", n=6)


SOURCE = grids.Lattice(500000.0, 5201000.0, 10.0, 100, 100)
#: Stems on the southern edge of the square lie in a row of their own.
COARSE = grids.Lattice(500000.0, 5201000.0, 40.0, 26, 25)
#: Neither in step with the source nor within it.
ODD = grids.Lattice(499987.0, 5200996.0, 15.0, 60, 66)

for method, sql in {"average": "avg(mean_height)", "sum": "sum(mean_height)", "min": "min(mean_height)", "max": "max(mean_height)", "median": "median(mean_height)", "q1": "quantile_cont(mean_height, 0.25)", "q3": "quantile_cont(mean_height, 0.75)", "rms": "sqrt(avg(mean_height*mean_height))"}.items():
    @query(f"foc12_resample_{method}", B.cells(f"SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round({sql} + {ASIDE!r}::DOUBLE, 6) AS mean_height FROM cells GROUP BY 1, 2"))
    def _(spark, d, method=method):
        out = grids.resample(tables.cells(spark, d), "mean_height", SOURCE, COARSE, method)
        return rounded(out.withColumn("mean_height", F.col("mean_height") + ASIDE), "mean_height", n=6)


@query("foc12_resample_mode", B.cells("SELECT row, col, n FROM (SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, n, row_number() OVER (PARTITION BY row // 4, col // 4 ORDER BY count(*) DESC, n) AS k FROM cells GROUP BY row // 4, col // 4, n) WHERE k = 1"))
def _(spark, d):
    return grids.resample(tables.cells(spark, d), "n", SOURCE, COARSE, "mode")


SPOTS = f"spots AS (SELECT CAST(a.range AS INT) AS tr, CAST(b.range AS INT) AS tc, ({ODD.x0} + (b.range + {HALF}) * 15 - 500000) / 10 AS fx, (5201000 - ({ODD.y1} - (a.range + {HALF}) * 15)) / 10 AS fy FROM range({ODD.rows}) a, range({ODD.cols}) b)"


@query("foc12_resample_nearest", f"WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, {SPOTS} SELECT tr AS row, tc AS col, n FROM spots JOIN cells ON cells.row = floor(fy) AND cells.col = floor(fx)")
def _(spark, d):
    """The default of categorical bands."""
    return grids.resample(tables.cells(spark, d), "n", SOURCE, ODD, grids.method_of("n", "categorical"))


#: Weight at a distance of t cells, and the reach.
WEIGHTS = {
    "bilinear": (1, "greatest(0, 1 - t)"),
    "cubic": (2, "CASE WHEN t <= 1 THEN (3*t*t*t - 5*t*t + 2) / 2 WHEN t < 2 THEN (-t*t*t + 5*t*t - 8*t + 4) / 2 ELSE 0 END"),
    "cubic_spline": (2, "CASE WHEN t <= 1 THEN CAST(2 AS DOUBLE)/3 - t*t + t*t*t/2 WHEN t < 2 THEN pow(2 - t, 3) / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN t = 0 THEN 1 WHEN t < 3 THEN (sin(pi()*t) / (pi()*t)) * (sin(pi()*t/3) / (pi()*t/3)) ELSE 0 END"),
}

for method, (reach, weight) in WEIGHTS.items():
    wy, wx = (weight.replace("t", "@").replace("grea@es@", "greatest").replace("WHEN", "WHEN").replace("@", f"abs({f} - 0.5 - c.{c})") for f, c in (("fy", "row"), ("fx", "col")))
    near = lambda f: f"BETWEEN floor({f} - 0.5) - {reach - 1} AND floor({f} - 0.5) + {reach}"  # noqa: B023, E731
    @query(f"foc12_resample_{method}", f"WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, {SPOTS}, {B.window(reach)}, w AS (SELECT tr, tc, mean_height AS v, ({wy}) * ({wx}) AS w FROM spots, off JOIN cells c ON c.row = floor(fy - 0.5) + dr AND c.col = floor(fx - 0.5) + dc WHERE c.row {near('fy')} AND c.col {near('fx')}) SELECT tr AS row, tc AS col, round(sum(v * w) / sum(w) + 1e-9, 4) AS mean_height FROM w GROUP BY 1, 2 HAVING sum(w) <> 0")
    def _(spark, d, method=method):
        return settled(grids.resample(tables.cells(spark, d), "mean_height", SOURCE, ODD, method), "mean_height")


STRADDLE = f"met AS (SELECT CAST(a.range AS INT) AS row, CAST(b.range AS INT) AS col, mean_height AS v, (least(c.col*10 + 510, {ODD.x0 - 499500} + (b.range + 1)*15) - greatest(c.col*10 + 500, {ODD.x0 - 499500} + b.range*15)) * (least(c.row*10 + 10, {5201000 - ODD.y1} + (a.range + 1)*15) - greatest(c.row*10, {5201000 - ODD.y1} + a.range*15)) / 100 AS w FROM cells c JOIN range({ODD.rows}) a ON c.row*10 < {5201000 - ODD.y1} + (a.range + 1)*15 AND c.row*10 + 10 > {5201000 - ODD.y1} + a.range*15 JOIN range({ODD.cols}) b ON c.col*10 + 500 < {ODD.x0 - 499500} + (b.range + 1)*15 AND c.col*10 + 510 > {ODD.x0 - 499500} + b.range*15)"
for method, sql in {"average": "sum(v*w)/sum(w)", "sum": "sum(v*w)", "max": "max(v)"}.items():
    @query(f"foc12_resample_{method}_across_cells", f"WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, {STRADDLE} SELECT row, col, round({sql} + 1e-9, 4) AS mean_height FROM met GROUP BY row, col")
    def _(spark, d, method=method):
        return settled(grids.resample(tables.cells(spark, d), "mean_height", SOURCE, ODD, method), "mean_height")


@query("foc13_mosaic", B.cells("SELECT row, col, round(arg_min(dbh, (l_suppkey % 3, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 7) AS v FROM located WHERE dbh IS NOT NULL GROUP BY row, col"))
def _(spark, d):
    t = tables.located(tables.trees(spark, d)).select("row", "col", F.col("dbh").alias("v"), F.struct((F.col("l_suppkey") % 3).alias("tile"), *PKEY.split(", ")).alias("seq"))
    return rounded(grids.mosaic(t, "v"), "v")


@query("src25_chunk_sparse", B.cells("SELECT CAST(row // 32 AS INT) AS chunk_row, CAST(col // 32 AS INT) AS chunk_col, row % 32 * least(32, 100 - col // 32 * 32) + col % 32 AS flat, n FROM cells WHERE n <> 1"))
def _(spark, d):
    return lattices.chunk_sparse(tables.cells(spark, d).select("row", "col", "n"), "n", 32, 100, 100, fill=1)


for order, sql in {"C": "row % 32, col % 32", "F": "col % 32, row % 32"}.items():
    @query(f"src25_chunk_dense_{order.lower()}", f"WITH {B.TREES}, {B.LOCATED}, {B.CELLS}, {B.LATTICE} SELECT CAST(row // 32 AS INT) AS chunk_row, CAST(col // 32 AS INT) AS chunk_col, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY {sql}) AS data FROM lattice LEFT JOIN cells USING (row, col) GROUP BY row // 32, col // 32")
    def _(spark, d, order=order):
        dense = lattices.chunk_dense(tables.cells(spark, d).select("row", "col", "n"), "n", 32, 100, 100, fill=0, order=order)
        return dense.select("chunk_row", "chunk_col", F.array_join(F.transform("data", lambda v: v.cast("string")), ",").alias("data"))


#: Fixed order of the roles in a landscape, with the factor by which each is stored.
ROLES = {"elevation": 1, "slope": 1, "aspect": 1, "fuel_model": 1, "canopy_cover": 1, "canopy_height": 10, "canopy_base_height": 10, "canopy_bulk_density": 100}
RAW = {"elevation": "mean_height + 900", "slope": "n % 40", "aspect": "CASE WHEN n > 2 THEN n * 77 % 360 END", "fuel_model": "91 + n % 45", "canopy_cover": "n * 3", "canopy_height": "max_height", "canopy_base_height": "mean_height / 3", "canopy_bulk_density": "max_height * 9000"}


@query("src23_landscape_stack", B.cells("SELECT CAST(row - 3 AS INT) AS row, CAST(col - 5 AS INT) AS col, " + ", ".join(f"CAST(coalesce(greatest(-32768, least(32767, round_even(CAST({RAW[r]} AS DOUBLE) * {k}, 0))), -9999) AS SMALLINT) AS {r}" for r, k in ROLES.items()) + " FROM cells WHERE row - 3 BETWEEN 0 AND 79 AND col - 5 BETWEEN 0 AND 69"))
def _(spark, d):
    bands = tables.cells(spark, d).selectExpr("row", "col", *(f"CAST({RAW[r]} AS DOUBLE) AS {r}" for r in ROLES))
    return lattices.stacked(bands, ROLES, (3, 5), 80, 70)


def stamped(spark, d):
    t = tables.trees(spark, d).filter("dbh IS NOT NULL AND fia_species_code IS NOT NULL")
    t = t.withColumn("tree_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    # Shapes depend on height and crown ratio only.
    shapes = files.written(voxels.crown_templates(t.select(*voxels.class_keys()[2:]).distinct(), 2.0, 1.0), "templates")
    return voxels.stamp(t, shapes, 2.0, 1.0, 500000.0, 5201000.0, 500, 500, F.col("dbh"), tiled=True)


#: A crown: nk layers of a paraboloid of the radius r; a voxel is in where its centre is within the layer's circle.
CROWNS = f"""kept AS (SELECT *, l_orderkey * 10 + l_linenumber AS tree_id, floor(height) AS hb, CAST(round_even(crown_ratio / CAST(0.1 AS DOUBLE), 0) AS INT) AS rb FROM trees WHERE dbh IS NOT NULL AND fia_species_code IS NOT NULL),
 shapes AS (SELECT hb, rb, greatest(1, CAST(ceil((hb + {HALF}) * (rb * CAST(0.1 AS DOUBLE))) AS INT)) AS nk, {HALF} + hb * CAST(0.08 AS DOUBLE) AS r FROM (SELECT DISTINCT hb, rb FROM kept)),
 layers AS (SELECT hb, rb, CAST(k.range AS INT) AS dk, r * r * (1 - (k.range + {HALF}) / nk) AS wide, CAST(ceil(r / 2) AS INT) AS nr FROM shapes, range(200) k WHERE k.range < nk),
 spots AS MATERIALIZED (SELECT hb, rb, dk, CAST(a.range - 10 AS INT) AS dj, CAST(b.range - 10 AS INT) AS di FROM layers, range(21) a, range(21) b WHERE abs(a.range - 10) <= nr AND abs(b.range - 10) <= nr AND (((a.range - 10) * (a.range - 10) + (b.range - 10) * (b.range - 10)) * 4 <= wide OR (a.range = 10 AND b.range = 10))),
 counts AS (SELECT hb, rb, count(*) AS voxels FROM spots GROUP BY ALL),
 stamps AS (SELECT CAST(floor(height * (1 - crown_ratio)) AS INT) + dk AS k, CAST(floor((5201000 - y) / 2) AS INT) + dj AS j, CAST(floor((x - 500000) / 2) AS INT) + di AS i, tree_id, height, CAST(round_even(dbh / voxels / 4 * CAST(1000000000 AS DOUBLE), 0) AS BIGINT) AS grains FROM kept JOIN counts USING (hb, rb) JOIN spots USING (hb, rb)),
 merged AS (SELECT k, j, i, sum(grains) AS grains, sum(grains) / CAST(1000000000 AS DOUBLE) AS density, arg_max(tree_id, (height, tree_id)) AS tree_id FROM stamps WHERE j BETWEEN 0 AND 499 AND i BETWEEN 0 AND 499 GROUP BY k, j, i)"""


@query("agg18_equivalence_classes", B.trees(f"SELECT *, dense_rank() OVER (ORDER BY species NULLS FIRST, dbh_bin, height_bin, ratio_bin) AS class FROM (SELECT fia_species_code AS species, CAST(floor(dbh / CAST(2.75 AS DOUBLE)) AS INT) AS dbh_bin, CAST(floor(height) AS INT) AS height_bin, CAST(round_even(crown_ratio / CAST(0.1 AS DOUBLE), 0) AS INT) AS ratio_bin, count(*) AS members FROM trees WHERE dbh IS NOT NULL GROUP BY 1, 2, 3, 4)"))
def _(spark, d):
    return voxels.equivalence_classes(tables.trees(spark, d).filter("dbh IS NOT NULL"))


@query("vox02_stamped_and_merged", f"WITH {B.TREES}, {CROWNS} SELECT k, j, i, density, tree_id FROM merged")
def _(spark, d):
    return voxels.merged(stamped(spark, d))


@query("vox03_crown_templates", f"WITH {B.TREES}, {CROWNS} SELECT CAST(hb AS INT) AS height_bin, rb AS ratio_bin, dk, dj, di FROM spots")
def _(spark, d):
    t = tables.trees(spark, d).filter("dbh IS NOT NULL AND fia_species_code IS NOT NULL")
    return voxels.crown_templates(t.select(*voxels.class_keys()[2:]).distinct(), 2.0, 1.0).drop("nk_")


@query("agg16_additive_merge", f"WITH {B.TREES}, {CROWNS} SELECT k, count(*) AS voxels, round(sum(density), 4) AS density FROM merged GROUP BY k")
def _(spark, d):
    m = voxels.merged(stamped(spark, d))
    return m.groupBy("k").agg(F.count("*").alias("voxels"), F.round(F.sum("density"), 4).alias("density"))


@query("agg17_tallest_wins", f"WITH {B.TREES}, {CROWNS} SELECT tree_id, count(*) AS voxels FROM merged GROUP BY tree_id")
def _(spark, d):
    return voxels.merged(stamped(spark, d)).groupBy("tree_id").agg(F.count("*").alias("voxels"))


@query("vox07_column_collapse", f"WITH {B.TREES}, {CROWNS} SELECT j, i, sum(grains) / CAST(1000000000 AS DOUBLE) AS load, count(*) AS layers, CAST(max(k) + 1 AS DOUBLE) AS canopy_height FROM merged GROUP BY j, i")
def _(spark, d):
    return voxels.collapse_stamps(stamped(spark, d), 1.0)


@query("vox01_stem_cells", B.trees(f"SELECT {PKEY}, CAST(floor((x - 500000) / 2) AS INT) AS i, CAST(floor((5201000 - y) / 2) AS INT) AS j FROM trees"))
def _(spark, d):
    t = tables.located(tables.trees(spark, d), 2.0)
    return t.select(*PKEY.split(", "), F.col("col").alias("i"), F.col("row").alias("j"))


@query("lat04_chunk_metadata", B.cells("SELECT chunk, CAST(chunk // 4 * 32 AS INT) AS row0, CAST(chunk % 4 * 32 AS INT) AS col0, CAST(least(32, 100 - chunk // 4 * 32) AS INT) AS height, CAST(least(32, 100 - chunk % 4 * 32) AS INT) AS width, CAST(500000 + chunk % 4 * 320 AS DOUBLE) AS x0, CAST(5201000 - chunk // 4 * 320 AS DOUBLE) AS y1, n FROM (SELECT CAST(row // 32 * 4 + col // 32 AS INT) AS chunk, count(*) AS n FROM cells GROUP BY 1)"))
def _(spark, d):
    per = tables.cells(spark, d).groupBy(lattices.chunk_of(F.col("row"), F.col("col"), 32, 100).alias("chunk")).agg(F.count("*").alias("n"))
    return lattices.chunk_metadata(per, "chunk", 32, SOURCE)


@query("lat04_chunk_metadata_3d", B.trees("SELECT chunk, CAST(chunk // 16 * 8 AS INT) AS k0, CAST(least(8, 42 - chunk // 16 * 8) AS INT) AS depth, CAST(chunk % 16 // 4 * 32 AS INT) AS row0, CAST(chunk % 4 * 32 AS INT) AS col0, n FROM (SELECT CAST(floor(height) AS INT) // 8 * 16 + CAST(floor((5201000 - y) / 10) AS INT) // 32 * 4 + CAST(floor((x - 500000) / 10) AS INT) // 32 AS chunk, count(*) AS n FROM trees GROUP BY 1)"))
def _(spark, d):
    t = tables.located(tables.trees(spark, d))
    per = t.groupBy((F.floor(F.floor("height") / 8).cast("int") * 16 + lattices.chunk_of(F.col("row"), F.col("col"), 32, 100)).cast("int").alias("chunk")).agg(F.count("*").alias("n"))
    return lattices.chunk_metadata(per, "chunk", 32, SOURCE, layers=(42, 8)).select("chunk", "k0", "depth", "row0", "col0", "n")


@query("lat06_voxel_dimensions", B.trees("SELECT CAST(floor(min(x) / 2) * 2 AS DOUBLE) AS x0, CAST(ceil(max(y) / 2) * 2 AS DOUBLE) AS y1, CAST(ceil(max(x) / 2) - floor(min(x) / 2) AS INT) AS nx, CAST(ceil(max(y) / 2) - floor(min(y) / 2) AS INT) AS ny, CAST(ceil(ceil(max(height)) / 1) AS INT) AS nz FROM trees"))
def _(spark, d):
    return voxels.dimensions(tables.trees(spark, d), 2.0, 1.0)
