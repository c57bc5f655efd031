"""Queries over stored point clouds: appended uploads, manifests, footers, completeness of arrivals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import units
from ..operators import ingest, pointcloud, spatial
from ..registry import query
from ..sources import files, tables
from ..streaming import dispatches
from . import base_sql as B
from .lattice_plans import PKEY, K

TILE = 250.0
LEVEL = "CASE " + " ".join(f"WHEN i % {4 ** (pointcloud.LEVELS - 1 - k)} = 0 THEN {k}" for k in range(pointcloud.LEVELS - 1)) + f" ELSE {pointcloud.LEVELS - 1} END"


def utm_series_sql(zone: int) -> str:
    """(X, Y, Z) of lonlat(lon, lat, z in feet): the transverse Mercator series in the conformal latitude, as steps of a centimetre."""
    n = spatial.WGS84_F / (2 - spatial.WGS84_F)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    radius, s = spatial.WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    east = " + ".join(f"CAST({c!r} AS DOUBLE) * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(alpha, 1))
    north = " + ".join(f"CAST({c!r} AS DOUBLE) * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(alpha, 1))
    return f"""conformal AS (SELECT *, sinh(atanh(sin(radians(lat))) - CAST({s!r} AS DOUBLE) * atanh(CAST({s!r} AS DOUBLE) * sin(radians(lat)))) AS t, radians(lon - {6 * zone - 183}) AS lam FROM lonlat),
 angles AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM conformal),
 stepped AS (SELECT {PKEY}, upload, CAST(floor((500000 + CAST({0.9996 * radius!r} AS DOUBLE) * (eta + {east})) / CAST(0.01 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT) AS X, CAST(floor((CAST({0.9996 * radius!r} AS DOUBLE) * (xi + {north})) / CAST(0.01 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT) AS Y,
  CAST(floor(z * CAST({units.factor("ft", "m")!r} AS DOUBLE) / CAST(0.01 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT) AS Z FROM angles)"""


UPLOADS = f"""lonlat AS (SELECT {PKEY}, l_suppkey % 3 AS upload, -117 + (x - 500000) / 80000 AS lon, 47 + (y - 5200000) / 111000 AS lat, height AS z FROM trees),
 {utm_series_sql(11)},
 numbered AS (SELECT *, CAST(floor(X * CAST(0.01 AS DOUBLE) / 250) AS INT) AS tile_x, CAST(floor(Y * CAST(0.01 AS DOUBLE) / 250) AS INT) AS tile_y FROM stepped),
 levelled AS (SELECT *, CAST({LEVEL} AS INT) AS lod FROM (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY upload, {PKEY}) - 1 AS i FROM numbered))"""


def uploaded_cloud(spark, d) -> str:
    """Stems as points in degrees and feet, brought to UTM and stored in three uploads."""
    t = tables.trees(spark, d).select(*K, (F.col("l_suppkey") % 3).alias("upload"), (F.lit(-117.0) + (F.col("x") - 500000) / 80000).alias("lon"), (F.lit(47.0) + (F.col("y") - 5200000) / 111000).alias("lat"), F.col("height").alias("z"))
    root = files.shared_path(spark, "cloud")
    for k in range(3):
        points = ingest.projected_points(t.filter(F.col("upload") == k).drop("upload"), 11, pointcloud.SCALE, "ft")
        pointcloud.append_upload(pointcloud.tiled(points, TILE), root, k, tuple(K))
    return root


@query("src16_appended_uploads", f"WITH {B.TREES}, {UPLOADS} SELECT {PKEY}, X, Y, Z, tile_x, tile_y, lod, CAST(upload AS INT) AS upload FROM levelled")
def _(spark, d):
    """Levels of three uploads as if all had been written at once."""
    return spark.read.parquet(f"{uploaded_cloud(spark, d)}/points").select(*K, "X", "Y", "Z", "tile_x", "tile_y", "lod", "upload")


@query("src07_checked_catalogue", f"WITH {B.TREES}, {UPLOADS} SELECT tile_x, tile_y, lod, n, sum(n) OVER (PARTITION BY tile_x, tile_y ORDER BY lod) AS upto FROM (SELECT tile_x, tile_y, lod, count(*) AS n FROM levelled GROUP BY ALL)")
def _(spark, d):
    """Points of each tile by level from the files' footers, after the totals agree with the manifest."""
    return pointcloud.checked_catalogue(spark, uploaded_cloud(spark, d))


@query("src19_footer_counts", B.trees("SELECT CAST(l_suppkey % 4 AS INT) AS part, count(*) AS n FROM trees GROUP BY 1"))
def _(spark, d):
    path = files.shared_path(spark, "trees")
    files.write_parts(tables.trees(spark, d), F.col("l_suppkey") % 4, path)
    return files.footer_counts(spark, path, ["part"]).select(F.col("part").cast("int").alias("part"), "n")


ARRIVALS = """arrived AS (SELECT DISTINCT l_suppkey % 50 AS cloud, l_orderkey % 40 AS idx FROM lineitem WHERE l_suppkey % 50 * 7 % 45 <> l_orderkey % 40),
 schedule AS (SELECT l_suppkey % 50 AS cloud, l_partkey % 10 AS tile, max(l_orderkey % 40) AS last FROM lineitem GROUP BY 1, 2),
 missing AS (SELECT c.cloud, min(r.range) AS upto FROM (SELECT DISTINCT cloud FROM arrived) c, range(41) r WHERE NOT EXISTS (SELECT 1 FROM arrived a WHERE a.cloud = c.cloud AND a.idx = r.range) GROUP BY c.cloud)"""


@query("st04_finished_tiles_stream", f"WITH {ARRIVALS} SELECT cloud, tile FROM schedule JOIN missing USING (cloud) WHERE last < upto")
def _(spark, d):
    """Tiles that are whole because all their cloud's arrivals up to their last one are there, as a stream with state."""
    li = tables.table(spark, d, "lineitem")
    arrivals = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/lineitem.parquet*").filter("l_suppkey % 50 * 7 % 45 <> l_orderkey % 40").select((F.col("l_suppkey") % 50).alias("cloud"), (F.col("l_orderkey") % 40).alias("idx"))
    schedule = li.groupBy((F.col("l_suppkey") % 50).alias("cloud"), (F.col("l_partkey") % 10).alias("tile")).agg(F.max(F.col("l_orderkey") % 40).alias("last"))
    return dispatches.appended(dispatches.finished_tiles(arrivals, schedule))
