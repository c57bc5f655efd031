"""Uploaded and exported tree tables: column maps, GeoJSON points, rules with reports, plot trees of several schemas, point scaling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from . import spatial


def mapped(raw: DataFrame, names: dict[str, str], kinds: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """The known columns (kinds: name to type) of an upload, whose own names `names` maps to; others go. A missing
    optional column is null, any other an error."""
    source = {c: names.get(c, c) for c in kinds}
    lost = [c for c, s in source.items() if s not in raw.columns and c not in optional]
    if lost:
        raise ValueError(f"the upload lacks {lost}")
    return raw.select(*((F.col(source[c]) if source[c] in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def points_of(texts: DataFrame, feature: str, properties: str) -> DataFrame:
    """GeoJSON features, one a row, to a row per point: x, y and the properties. A MultiPoint gives several; other
    geometries raise."""
    kind = F.get_json_object(feature, "$.geometry.type")
    place = F.get_json_object(feature, "$.geometry.coordinates")
    one = F.array(F.from_json(place, "array<double>"))
    all_ = F.when(kind == "Point", one).when(kind == "MultiPoint", F.from_json(place, "array<array<double>>")).otherwise(F.raise_error(F.concat(F.lit("no points: "), F.coalesce(kind, F.lit("null")))))
    out = texts.select(F.from_json(F.get_json_object(feature, "$.properties"), properties).alias("p_"), F.explode(all_).alias("at_"))
    return out.select("p_.*", F.col("at_")[0].alias("x"), F.col("at_")[1].alias("y"))


def feature(table: DataFrame, properties: list[str]) -> Column:
    """A GeoJSON point feature of x, y and the properties; x and y must be there."""
    if not {"x", "y"} <= set(table.columns):
        raise ValueError("points need the columns x and y")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def faulty(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The rows that break a rule (name to a condition that good rows meet; unknown is broken), with `faults`: all the rules' names."""
    faults = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.withColumn("faults", faults).filter(F.size("faults") > 0)


def fault_counts(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule that any breaks."""
    return faulty(rows, rules).select(F.explode("faults").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def first_faults(rows: DataFrame, rules: dict[str, str], order: list[str], most: int = 100) -> DataFrame:
    """The first `most` faulty rows in order, each with `total`, the number of all."""
    bad = faulty(rows, rules)
    total = bad.agg(F.count("*").alias("total"))  # one row
    return bad.orderBy(*order, F.array_join("faults", ",")).limit(most).join(F.broadcast(total))


# The column that names the plot, by version of the plot table.
PLOT_COLUMN = {"2014": "CN", "2016": "TM_CN", "2022": "PLT_CN"}


def plot_trees(raw: DataFrame, version: str) -> DataFrame:
    """Trees of a plot table of a version, in metric units: diameter inch to cm, height ft to m, crown ratio percent to
    share (missing: 0), stems per acre to per m2."""
    if version not in PLOT_COLUMN:
        raise ValueError(f"no version {version}")
    per_area = F.col("TPA") * units.factor("1/acre", "1/m2")
    return raw.select(
        F.col(PLOT_COLUMN[version]).alias("plot_id"), F.col("TREE").alias("tree"), units.convert(F.col("DIA"), "in", "cm").alias("dbh"), units.convert(F.col("HT"), "ft", "m").alias("height"),
        (F.coalesce(F.col("CR"), F.lit(0.0)) / 100).alias("crown_ratio"), per_area.alias("tpa"),
    )


def scaled_points(points: DataFrame, scale: float, unit: str, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """points(x, y, z in `unit`) with X, Y, Z as integer steps of `scale` metres from the origin."""
    step = lambda c, o: F.floor((F.col(c) - F.lit(o)) * F.lit(units.factor(unit, "m") / scale) + 0.5).cast("int")
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    return points.select(*rest, step("x", origin[0]).alias("X"), step("y", origin[1]).alias("Y"), step("z", 0.0).alias("Z"))


def _settled(zone: int, scale: float):
    """The steps (X, Y) of the few places that are given, by the C library's functions; null where those have no value."""

    def steps(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"X": None, "Y": None}, index=lon.index, dtype="object")
        for k in lon.index[lon.notna()]:
            try:
                out.loc[k] = [math.floor(v / scale + 0.5) for v in spatial.utm(lon[k], lat[k], zone, m=math)]
            except (ValueError, OverflowError):  # a pole
                pass
        return out.astype("Int32")

    return F.pandas_udf(steps, "struct<X:int,Y:int>")


def projected_points(points: DataFrame, zone: int, scale: float, unit: str) -> DataFrame:
    """points(lon, lat in degrees, z in `unit`) with X, Y (UTM of the zone, north) and Z as integer steps of `scale` metres.

    A place within a micrometre of the border of two steps is settled by the C library's sines, as other engines do:
    there the last bit of a number decides."""
    rest = [c for c in points.columns if c not in ("lon", "lat", "z")]
    x, y = (c / F.lit(scale) + 0.5 for c in spatial.utm(F.col("lon"), F.col("lat"), zone))
    near = lambda c: F.abs(F.col(c) - F.rint(c)) < 1e-6 / scale
    p = points.withColumns({"x_": x, "y_": y})
    border = lambda c: F.when(near("x_") | near("y_"), F.col(c))
    p = p.withColumn("settled_", _settled(zone, scale)(border("lon"), border("lat")))
    step = lambda k: F.coalesce(f"settled_.{k}", F.floor(f"{k.lower()}_").cast("int")).alias(k)
    return p.select(*rest, step("X"), step("Y"), F.floor(F.col("z") * F.lit(units.factor(unit, "m")) / F.lit(scale) + 0.5).cast("int").alias("Z"))


#: What a tree table must have; without a status all its trees are live.
MORPHOLOGY = ("x", "y", "fia_species_code", "dbh", "height", "crown_ratio")


class TreesNotFound(LookupError):
    """No tree table where one was asked for."""


class MissingMorphology(ValueError):
    """A tree table without the columns that say what its trees are like."""


def read_trees(spark: SparkSession, path: str, extra: tuple[str, ...] = (), live_only: bool = True) -> DataFrame:
    """The needed and extra columns of a written tree table; others are not read, and a status of 1 is asked of the files."""
    try:
        trees = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise TreesNotFound(path) from e
    lost = [c for c in (*MORPHOLOGY, *extra) if c not in trees.columns]
    if lost:
        raise MissingMorphology(f"{path} lacks {lost}: impute them first")
    if "fia_status_code" not in trees.columns:
        return trees.select(*MORPHOLOGY, *extra).withColumn("fia_status_code", F.lit(1))
    trees = trees.select(*MORPHOLOGY, "fia_status_code", *extra)
    return trees.filter("fia_status_code = 1") if live_only else trees
