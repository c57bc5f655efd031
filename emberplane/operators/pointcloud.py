"""Tiled point tables: tiles, levels of detail, reading by box, rasterising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files

# Fixed values of the format: metres per integer step, levels of detail (each keeps one point in four of the next), bits of a cell of the order in a file.
SCALE, LEVELS, ORDER_BITS = 0.01, 6, 8


def tiled(points: DataFrame, tile: float, scale: float = SCALE) -> DataFrame:
    world = lambda c: F.col(c) * F.lit(scale)
    return points.withColumns({"tile_x": F.floor(world("X") / tile).cast("int"), "tile_y": F.floor(world("Y") / tile).cast("int")})


def with_lod(points: DataFrame, order: tuple[str, ...], levels: int = LEVELS) -> DataFrame:
    """Level of a point from its place in its tile: place i has the least k with i divisible by 4^(levels-1-k).
    A tile is numbered over as many partitions as it lies in."""
    p = files.numbered(points, ["tile_x", "tile_y"], list(order), "i_")
    return p.withColumn("lod", level(F.col("i_"), levels)).drop("i_")


def level(place: Column, levels: int = LEVELS) -> Column:
    lod = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        lod = F.when(place % (4 ** (levels - 1 - k)) == 0, F.lit(k)).otherwise(lod)
    return lod.cast("int")


def read_points(points: DataFrame, box: tuple[float, float, float, float], tile: float, classes=None, max_lod: int | None = None, exact: bool = False, scale: float = SCALE) -> DataFrame:
    """Points of the tiles that meet the box (with `exact`, of the box), by class and level, as x_m, y_m, z_m."""
    out = points.filter(F.col("tile_x").between(int(box[0] // tile), int(box[2] // tile)) & F.col("tile_y").between(int(box[1] // tile), int(box[3] // tile)))
    if max_lod is not None:
        out = out.filter(F.col("lod") <= max_lod)
    if classes:
        out = out.filter(F.col("classification").isin(*classes))
    out = out.select(*[c for c in out.columns if c not in "XYZ"], *((F.col(c) * F.lit(scale)).alias(f"{c.lower()}_m") for c in "XYZ"))
    return out.filter(F.col("x_m").between(box[0], box[2]) & F.col("y_m").between(box[1], box[3])) if exact else out


def write_points(points: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per tile and level, whose rows lie in grid order. Rows are dealt by ranges of tile, level and
    place, so that a large tile is written by several tasks. A read by read_points opens the folders of its
    tiles and levels only."""
    near = F.shiftright(F.col("X"), ORDER_BITS), F.shiftright(F.col("Y"), ORDER_BITS)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tile_x", "tile_y", "lod", *near]
    points.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("tile_x", "tile_y", "lod").parquet(path)


#: Folders of a cloud that takes uploads.
PARTITIONS = ["upload", "tile_x", "tile_y", "lod"]


class BrokenCloud(ValueError):
    """A stored cloud that its manifest or the format does not allow."""


def append_upload(points: DataFrame, root: str, upload: int, order: tuple[str, ...]) -> None:
    """Add tiled points to the cloud under `root` as its upload number `upload` (0, 1, ...), then write its manifest.

    A tile's numbering runs on from the points that earlier uploads have stored in it, so levels are those of
    one write of all uploads in their order. The counts come from footers. An upload replaces what an earlier try
    of the same number has left; one before a later upload is an error, as it would shift that one's levels."""
    spark = points.sparkSession
    tiles = ["tile_x", "tile_y"]
    if upload:
        counts = files.footer_counts(spark, f"{root}/points", PARTITIONS)
        if not counts.filter(F.col("upload") > upload).isEmpty():
            raise ValueError(f"upload {upload} has successors")
        stored = counts.filter(F.col("upload") < upload).groupBy(*tiles).agg(F.sum("n").alias("stored_"))
    else:
        stored = spark.createDataFrame([], "tile_x int, tile_y int, stored_ long")
    placed = files.numbered(points, tiles, list(order), "i_").join(stored, tiles, "left")
    placed = placed.withColumn("lod", level(F.col("i_") + F.coalesce("stored_", F.lit(0)))).drop("i_", "stored_")
    write_points(placed, f"{root}/points/upload={upload}", "overwrite")
    write_manifest(spark, root)


def write_manifest(spark, root: str) -> None:
    """What the cloud holds: tiles and points, written last, so that a reader can tell a whole cloud."""
    counts = files.footer_counts(spark, f"{root}/points", PARTITIONS).groupBy("tile_x", "tile_y").agg(F.sum("n").alias("n"))
    counts.agg(F.count("*").alias("tiles"), F.coalesce(F.sum("n"), F.lit(0)).alias("points")).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")


def checked_catalogue(spark, root: str, levels: int = LEVELS) -> DataFrame:
    """tile_catalogue of a stored cloud from its footers. No manifest, other totals than it declares, or a level outside the
    format are errors."""
    try:
        declared = spark.read.parquet(f"{root}/manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise BrokenCloud(f"{root} has no manifest") from e
    counts = files.footer_counts(spark, f"{root}/points", PARTITIONS).groupBy("tile_x", "tile_y", "lod").agg(F.sum("n").alias("n"))
    odd = counts.filter(~F.col("lod").between(0, levels - 1)).select("lod").first()
    if odd:
        raise BrokenCloud(f"level {odd.lod} is outside of the format")
    seen = counts.agg(F.count_distinct("tile_x", "tile_y").alias("tiles"), F.coalesce(F.sum("n"), F.lit(0)).alias("points")).first()
    for what in ("tiles", "points"):
        if seen[what] != declared[what]:
            raise BrokenCloud(f"the files have {seen[what]} {what}, the manifest declares {declared[what]}")
    return cumulated(counts)


def tile_catalogue(points: DataFrame) -> DataFrame:
    """Points per tile and level, and cumulated over levels."""
    return cumulated(points.groupBy("tile_x", "tile_y", "lod").agg(F.count("*").alias("n")))


def cumulated(counts: DataFrame) -> DataFrame:
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("tile_x", "tile_y").orderBy("lod")))


def height_above(points: DataFrame, z: Column, ground: Column, low: float = -0.5, high: float = 100.0) -> DataFrame:
    h = z - ground
    return points.withColumn("h", h).filter((F.col("h") >= low) & (F.col("h") < high)).withColumn("h", F.greatest(F.col("h"), F.lit(0.0)))


def summary(points: DataFrame, scale: float = SCALE) -> DataFrame:
    """One row: n, classes, bounds in integer steps, and density (points per square metre of the bounding box, 0 if that is degenerate)."""
    out = points.agg(F.count("*").alias("n"), F.count_distinct("classification").alias("classes"), *(f(c).alias(f"{n}{c.lower()}") for c in "XYZ" for n, f in (("min", F.min), ("max", F.max))))
    area = (F.col("maxx") - F.col("minx")) * F.lit(scale) * (F.col("maxy") - F.col("miny")) * F.lit(scale)
    return out.withColumn("density", F.when(area > 0, F.col("n") / area).otherwise(0.0))


def rasterized(points: DataFrame, cell: float, how: str = "max", classes=None, percentile: float = 50.0, value: str = "h", x: str = "x_m", y: str = "y_m", y1: float = 0.0) -> DataFrame:
    """(row, col, v) of the cells that have points (of the classes): max, mean, min, median or a percentile
    in (0, 100] by linear rank. Rows run south from y1."""
    if how == "percentile" and not 0 < percentile <= 100:
        raise ValueError("a percentile lies in (0, 100]")
    v = F.col(value)
    agg = {"max": F.max(v), "mean": F.avg(v), "min": F.min(v), "median": F.percentile(v, F.lit(0.5)), "percentile": F.percentile(v, F.lit(percentile / 100))}[how]
    some = points.filter(F.col("classification").isin(*classes)) if classes else points
    return some.groupBy(F.floor((F.lit(y1) - F.col(y)) / cell).cast("int").alias("row"), F.floor(F.col(x) / cell).cast("int").alias("col")).agg(agg.alias("v"))
