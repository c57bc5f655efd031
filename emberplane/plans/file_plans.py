"""Queries over written tables, ingestion, exports, rule ledgers, JSON and upload streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import catalogue, generation, ingest, pointcloud, rules, spatial
from ..operators.rules import Action, Condition, Rule
from ..registry import query
from ..sources import files, tables
from ..streaming import dispatches
from . import base_sql as B
from .lattice_plans import CELLS, K, PKEY
from .spatial_plans import BOXES, boxes


def written_parts(spark, d):
    path = files.shared_path(spark, "trees")
    files.write_parts(tables.trees(spark, d), F.col("l_suppkey") % 4, path)
    return path


@query("src04_read_part", B.trees(f"SELECT {PKEY}, height FROM trees WHERE l_suppkey % 4 = 1"))
def _(spark, d):
    return files.read_part(spark, written_parts(spark, d), 1, [*K, "height"])


@query("src04_part_as_json", B.trees("SELECT '{\"l_orderkey\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || '}' AS record FROM trees WHERE l_suppkey % 4 = 2"))
def _(spark, d):
    part = files.read_part(spark, written_parts(spark, d), 2, ["l_orderkey", "l_linenumber"])
    return part.select(F.to_json(F.struct("l_orderkey", "l_linenumber")).alias("record"))


@query("src05_part_sizes", B.trees("SELECT CAST(l_suppkey % 4 AS INT) AS part, count(*) AS n, 11 AS columns FROM trees GROUP BY 1"))
def _(spark, d):
    return files.part_sizes(spark, written_parts(spark, d)).select(F.col("part").cast("int").alias("part"), "n", F.size("columns").alias("columns"))


@query("src10_running_ids", B.trees(f"SELECT {PKEY}, row_number() OVER (ORDER BY l_suppkey % 4, {PKEY}) - 1 AS row_id FROM trees"))
def _(spark, d):
    return files.running_ids(tables.trees(spark, d).withColumn("part", F.col("l_suppkey") % 4), "part", K).select(*K, F.col("row_id").cast("long").alias("row_id"))


@query("src12_optimized_index", f"WITH {BOXES} SELECT id, minx, maxx FROM boxes WHERE minx BETWEEN 100 AND 400")
def _(spark, d):
    path = files.shared_path(spark, "index")
    files.write_index(boxes(spark, d), ["id", "minx", "miny", "maxx", "maxy"], ["minx", "miny"], path)
    return spark.read.parquet(path).filter("minx BETWEEN 100 AND 400").select("id", "minx", "maxx")


@query("src15_ingest_cells", f"{CELLS} SELECT col * CAST(10 AS DOUBLE) + 5 AS x, row * CAST(10 AS DOUBLE) + 5 AS y, n AS stems, true AS regular FROM cells WHERE col * 10 + 5 BETWEEN 180 AND 620 AND row * 10 + 5 BETWEEN 80 AND 520")
def _(spark, d):
    c = tables.cells(spark, d).select((F.col("col") * 10.0 + 5).alias("x"), (F.col("row") * 10.0 + 5).alias("y"), F.col("n").alias("band_1"))
    return generation.ingest_cells(c, {"band_1": "stems"}, (200.0, 100.0, 600.0, 500.0), 10.0, 2)


FEET = "floor({} * CAST(" + repr(units.factor("ft", "m") / 0.01) + " AS DOUBLE) + 0.5)"


@query("src16_ingest_points", B.trees(f"SELECT {PKEY}, CAST({FEET.format('(x - 500000)')} AS INT) AS X, CAST({FEET.format('(y - 5200000)')} AS INT) AS Y, CAST({FEET.format('height')} AS INT) AS Z, CAST(floor({FEET.format('(x - 500000)')} * CAST(0.01 AS DOUBLE) / 50) AS INT) AS tile_x, CAST(floor({FEET.format('(y - 5200000)')} * CAST(0.01 AS DOUBLE) / 50) AS INT) AS tile_y FROM trees"))
def _(spark, d):
    """Points in feet scaled to integer centimetres, tiled, levelled, written and read back."""
    t = tables.trees(spark, d).select(*K, "x", "y", F.col("height").alias("z"))
    p = pointcloud.tiled(ingest.scaled_points(t, 0.01, "ft", (500000.0, 5200000.0)), 50.0)
    path = files.shared_path(spark, "points")
    pointcloud.write_points(pointcloud.with_lod(p, tuple(K)), path)
    return spark.read.parquet(path).select(*K, "X", "Y", "Z", "tile_x", "tile_y")


@query("src16_reprojected_points", f"WITH {BOXES} SELECT id, CAST(500000 + minx * 60 AS BIGINT) AS x, CAST(4900000 + miny * 60 AS BIGINT) AS y FROM boxes")
def _(spark, d):
    """UTM points by way of longitude and latitude and back, in whole metres."""
    b = boxes(spark, d).select("id", (500000 + F.col("minx") * 60).alias("e"), (4900000 + F.col("miny") * 60).alias("n"))
    lon, lat = spatial.lonlat(F.col("e"), F.col("n"), 11)
    x, y = spatial.utm(F.col("lon"), F.col("lat"), 11)
    return b.select("id", lon.alias("lon"), lat.alias("lat")).select("id", F.round(x).cast("long").alias("x"), F.round(y).cast("long").alias("y"))


@query("src17_write_with_summary", B.trees("SELECT count(*) AS n, count(dbh) AS dbh_n, round(sum(dbh), 3) AS dbh_sum, min(height) AS low, max(height) AS high FROM trees"))
def _(spark, d):
    m = files.write_with_summary(tables.trees(spark, d), files.shared_path(spark, "trees"), n=F.count(F.lit(1)), dbh_n=F.count("dbh"), dbh_sum=F.round(F.sum("dbh"), 3), low=F.min("height"), high=F.max("height"))
    return spark.createDataFrame([tuple(m[k] for k in ("n", "dbh_n", "dbh_sum", "low", "high"))], "n long, dbh_n long, dbh_sum double, low double, high double")


@query("src18_replace_in_place", B.trees(f"SELECT {PKEY} FROM trees WHERE dbh > 10 AND height < 35"))
def _(spark, d):
    base = files.shared_path(spark, "inventory")
    files.replace_rows(tables.trees(spark, d).filter("dbh > 10"), base)
    files.replace_rows(files.current_revision(spark, base).filter("height < 35"), base)
    return files.current_revision(spark, base).select(*K)


for fmt in ("parquet", "csv"):
    @query(f"src20_export_{fmt}", B.trees(f"SELECT {PKEY}, height FROM trees"))
    def _(spark, d, fmt=fmt):
        path = files.shared_path(spark, "export")
        files.export(tables.trees(spark, d), [*K, "height"], path, fmt)
        schema = ", ".join(f"{k} {'int' if k == 'l_linenumber' else 'long'}" for k in K) + ", height double"
        return spark.read.schema(schema).option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


@query("src22_uniform_nodata", "SELECT s_nationkey AS grid, count(DISTINCT coalesce(CAST(s_suppkey % 3 AS VARCHAR), 'none')) = 1 AS is_uniform FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS s_suppkey FROM supplier) GROUP BY 1")
def _(spark, d):
    bands = tables.table(spark, d, "supplier").select(F.col("s_nationkey").alias("grid"), F.expr("CASE s_suppkey % 3 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST(2 AS DOUBLE) END").alias("nodata"))
    return bands.groupBy("grid").agg((F.count_distinct(F.coalesce(F.col("nodata").cast("string"), F.lit("none"))) == 1).alias("is_uniform"))


STACK = f"WITH {B.TREES}, v AS (SELECT CAST(floor(height / 5) AS INT) AS k, CAST(floor((5201000 - y) / 50) AS INT) AS j, CAST(floor((x - 500000) / 50) AS INT) AS i, sum(height) AS density FROM trees GROUP BY ALL), g AS (SELECT 0 AS k, j, i, sum(density) / 100 AS load, max(density) AS moisture, min(density) AS savr FROM v WHERE k > 0 GROUP BY j, i)"


@query("src24_fire_input_stack", f"{STACK} SELECT k, j, i, round(coalesce(density, 0) + coalesce(load / 5, 0), 6) AS rho, round(greatest(moisture, 60), 6) AS moisture, CASE WHEN savr > 0 THEN round(2 / savr, 9) ELSE 0 END AS size FROM v FULL JOIN g USING (k, j, i)")
def _(spark, d):
    from .lattice_plans import coarse

    v = coarse(spark, d)
    g = v.filter("k > 0").groupBy("j", "i").agg((F.sum("density") / 100).alias("load"), F.max("density").alias("moisture"), F.min("density").alias("savr")).withColumn("k", F.lit(0))
    s = v.join(g, ["k", "j", "i"], "full")
    rho = F.coalesce("density", F.lit(0)) + F.coalesce(F.col("load") / 5, F.lit(0))
    return s.select("k", "j", "i", F.round(rho, 6).alias("rho"), F.round(F.greatest("moisture", F.lit(60.0)), 6).alias("moisture"), F.when(F.col("savr") > 0, F.round(2 / F.col("savr"), 9)).otherwise(0.0).alias("size"))


@query("src26_layerset", f"WITH {BOXES} SELECT id, CASE id % 3 WHEN 0 THEN 'shrub' ELSE 'herb' END AS fuel_type, minx, maxy, CASE WHEN maxx <= 180 AND maxy <= 90 THEN 'geographic' WHEN id % 130 > 100 THEN 'cover' WHEN id % 4 = 0 AND id % 8 <> 0 THEN 'patch_size' END AS fault FROM boxes")
def _(spark, d):
    text = """concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', minx, ',', miny, '],[', maxx, ',', miny, '],[', maxx, ',', maxy, ']]]},"properties":{"fuel_type":"', if(id % 3 = 0, 'shrub', 'herb'), '","percent_cover":', id % 130, ',"distribution":"', if(id % 4 = 0, 'random_clusters', 'uniform'), '"', if(id % 8 = 0, ',"patch_size":4', ''), '}}')"""
    out = generation.read_layers(boxes(spark, d).select("id", F.expr(text).alias("text")), "text")
    return out.select("id", "fuel_type", "minx", "maxy", "fault")


@query("sc07_coordinates", f"WITH {BOXES} SELECT id, '[[' || CAST(minx AS INT) || ',' || CAST(miny AS INT) || '],[' || CAST(maxx AS INT) || ',' || CAST(maxy AS INT) || ']]' AS text, maxx AS second_x FROM boxes")
def _(spark, d):
    point = lambda a, b: F.array(F.col(a).cast("int"), F.col(b).cast("int"))
    t = boxes(spark, d).select("id", F.to_json(F.array(point("minx", "miny"), point("maxx", "maxy"))).alias("text"))
    return t.select("id", "text", F.from_json("text", "array<array<double>>")[1][0].alias("second_x"))


@query("prj10_rule_ledger", B.trees(f"SELECT {PKEY}, round(height * 2 - 3, 6) AS height FROM trees"))
def _(spark, d):
    ledger = [(1, "applied", "multiply", 100.0), (2, "pending", "multiply", 2.0), (3, "pending", "subtract", 3.0)]
    out, after = rules.apply_pending(tables.trees(spark, d), spark.createDataFrame(ledger, "seq int, status string, modifier string, value double"), "height")
    if after.filter("status = 'pending'").count():
        raise RuntimeError("rules left")
    return out.select(*K, F.round("height", 6).alias("height"))


@query("prj11_uniform_bands", f"{CELLS} SELECT row, col, CAST(102 AS INT) AS fbfm, CAST(0.25 AS FLOAT) AS load FROM cells")
def _(spark, d):
    return rules.uniform(tables.cells(spark, d).select("row", "col"), {"fbfm": 102, "load": 0.25})


@query("prj14_non_finite_guard", f"{CELLS} SELECT row, col, round(CASE WHEN n % 4 <> 0 THEN max_height / (n % 4) ELSE -1 END, 6) AS v FROM cells")
def _(spark, d):
    """Cells whose denominator is 0 are excluded by the condition and take the fallback; in a used cell they would raise."""
    c = tables.cells(spark, d).withColumn("m", F.col("n") % 4)
    used = rules.predicate(Condition("m", "ne", 0), True)
    return c.select("row", "col", F.round(rules.guarded("divide", F.col("max_height"), F.col("m"), used=used, otherwise=F.lit(-1.0)), 6).alias("v"))


@query("prj15_else_values", f"{CELLS} SELECT row, col, round(CASE WHEN n > 8 THEN mean_height ELSE max_height END, 6) AS band, round(CASE WHEN n > 8 THEN mean_height ELSE -1 END, 6) AS number, round(CASE WHEN n > 8 THEN mean_height ELSE max_height - mean_height END, 6) AS computed, CASE WHEN n > 8 THEN 'dense' ELSE 'GR1' END AS label FROM cells")
def _(spark, d):
    hit = rules.predicate(Condition("n", "gt", 8), True)
    pick = lambda v: F.round(F.when(hit, F.col("mean_height")).otherwise(rules.value_of(v)), 6)
    return tables.cells(spark, d).select(
        "row", "col", pick({"band": "max_height"}).alias("band"), pick(-1.0).alias("number"),
        pick({"op": "subtract", "of": [{"band": "max_height"}, {"band": "mean_height"}]}).alias("computed"), F.when(hit, "dense").otherwise(rules.value_of({"label": "GR1"})).alias("label"),
    )


@query("prj16_unit_algebra", f"{CELLS} SELECT row, col, round(mean_height + max_height * CAST(0.3048 AS DOUBLE), 6) AS added, round(mean_height * max_height * CAST(0.3048 AS DOUBLE), 6) AS product FROM cells")
def _(spark, d):
    a, b = (F.col("mean_height"), "m"), (F.col("max_height"), "ft")
    return tables.cells(spark, d).select("row", "col", F.round(units.added(a, b, "m"), 6).alias("added"), F.round(units.product(a, b, "m2"), 6).alias("product"))


@query("set04_live_minus_artifacts", B.resources("SELECT DISTINCT owner AS id FROM resources WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND owner % 10 <> 0"))
def _(spark, d):
    live = tables.resources(spark, d).select(F.col("owner").alias("id"))
    return live.subtract(tables.table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("id"))).filter("id % 10 <> 0")


@query("set05_first_reason", B.resources("SELECT id, CASE WHEN status = 'failed' THEN 'failed' WHEN domain > 150 THEN 'orphan' ELSE 'large' END AS reason FROM resources WHERE status = 'failed' OR domain > 150 OR size_bytes > 200000"))
def _(spark, d):
    r = tables.resources(spark, d)
    reasons = F.array_compact(F.array(F.when(F.col("size_bytes") > 200000, "large"), F.when(F.col("domain") > 150, "orphan"), F.when(F.col("status") == "failed", "failed")))
    return catalogue.first_reason(r.select("id", F.explode(reasons).alias("reason")), ["failed", "orphan", "large"])


#: Second deliveries come within 60 days; a path is forgotten after that.
@query("st01_uploads_stream", "SELECT user_id AS path, CASE WHEN user_id % 3 > 0 AND user_id % 3 <= 1 THEN 'completed' ELSE 'failed' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    source = spark.readStream.schema(tables.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("path"), (F.col("user_id") % 3).alias("size"), F.col("ts").cast("timestamp").alias("ts"))
    return dispatches.appended(dispatches.uploads(source, "path", "size", 1, "ts", "60 days"))


@query("st03_tile_offsets_stream", "SELECT user_id % 40 AS tile, count(*) AS n, count(*) - 1 AS last, count(*) AS places FROM events GROUP BY 1")
def _(spark, d):
    source = spark.readStream.schema(tables.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*").select((F.col("user_id") % 40).alias("tile"), F.col("event_id").alias("id"))
    return dispatches.appended(dispatches.tile_offsets(source)).groupBy("tile").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))


@query("st04_completeness", """WITH a AS (SELECT DISTINCT l_suppkey AS tile, l_orderkey % 12 AS idx FROM lineitem), l AS (SELECT tile, max(idx) AS last_idx FROM a GROUP BY 1),
 m AS (SELECT l.tile, last_idx, min(r.range) AS next FROM l CROSS JOIN range(13) r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.tile = l.tile AND a.idx = r.range) GROUP BY ALL) SELECT tile, next, next > last_idx AS final FROM m""")
def _(spark, d):
    a = tables.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), (F.col("l_orderkey") % 12).alias("idx"))
    return dispatches.complete_up_to(a, a.groupBy("tile").agg(F.max("idx").alias("last_idx")))
