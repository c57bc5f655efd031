"""Forest tables derived from the star-schema tables, as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stem on a square of 1 km."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CAST(500000 AS DOUBLE) + CAST((l_orderkey*7919 + l_partkey*31 + l_linenumber*104729) % 100000 AS DOUBLE)/CAST(100 AS DOUBLE) AS x",
        "CAST(5200000 AS DOUBLE) + CAST((l_partkey*6151 + l_suppkey*17 + l_orderkey*13) % 100000 AS DOUBLE)/CAST(100 AS DOUBLE) AS y",
        "CASE l_suppkey % 6 WHEN 0 THEN 122 WHEN 1 THEN 202 WHEN 2 THEN 93 WHEN 3 THEN 15 WHEN 4 THEN 746 ELSE NULL END AS fia_species_code",
        "CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS fia_status_code",
        "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) + l_quantity*CAST(1.7 AS DOUBLE) END AS dbh",
        "CAST(1.5 AS DOUBLE) + CAST((l_orderkey*3 + l_partkey*7) % 4000 AS DOUBLE)/CAST(100 AS DOUBLE) AS height",
        "CAST(0.2 AS DOUBLE) + l_discount*CAST(5 AS DOUBLE) AS crown_ratio",
    )


def located(df: DataFrame, cell: float = CELL, x0: float = 500000.0, y1: float = 5201000.0) -> DataFrame:
    """With row and col of the cell of (x, y): rows run south from y1, columns east from x0."""
    return df.withColumns({"row": F.floor((F.lit(y1) - F.col("y")) / F.lit(float(cell))).cast("int"), "col": F.floor((F.col("x") - F.lit(x0)) / F.lit(float(cell))).cast("int")})


def lattice(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """All cells of a lattice; made on the executors."""
    return spark.range(rows * cols).select(F.expr(f"CAST(id DIV {cols} AS INT)").alias("row"), F.expr(f"CAST(id % {cols} AS INT)").alias("col"))


def region_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems on as many squares of 1 km, eight side by side, as 3,000 orders each need: a region that grows with the table."""
    east, south = F.expr("l_orderkey DIV 3000 % 8"), F.expr("l_orderkey DIV 24000")
    return trees(spark, sf_dir).withColumns({"x": F.col("x") + 1000 * east, "y": F.col("y") - 1000 * south})


def cells(spark: SparkSession, sf_dir: str, stems: DataFrame | None = None) -> DataFrame:
    """Occupied 10 m cells with stem count, mean and highest height."""
    return located(trees(spark, sf_dir) if stems is None else stems).groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("height").alias("mean_height"), F.max("height").alias("max_height"))


def surface(spark: SparkSession, sf_dir: str, stems: DataFrame | None = None) -> DataFrame:
    """Occupied 5 m cells (200 x 200 of a square of 1 km) with stem count n, highest z and lowest low."""
    return located(trees(spark, sf_dir) if stems is None else stems, 5).groupBy("row", "col").agg(F.count("*").alias("n"), F.max("height").alias("z"), F.min("height").alias("low"))


def fuel_codes(spark: SparkSession, sf_dir: str, stems: DataFrame | None = None) -> DataFrame:
    """Fuel codes 91 to 135 of the occupied 5 m cells, in patches, 32767 where missing."""
    code = "CASE WHEN n % 7 = 3 THEN 32767 ELSE CAST(91 + (row DIV 8 * 7 + col DIV 8 * 13 + n % 3) % 45 AS INT) END"
    return surface(spark, sf_dir, stems).withColumn("code", F.expr(code))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled integer points of the stems: X, Y, Z at 0.01 m, classification 1 to 7."""
    t = trees(spark, sf_dir)
    return t.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CAST((l_orderkey*7919 + l_partkey*31 + l_linenumber*104729) % 100000 AS INT) AS X",
        "CAST((l_partkey*6151 + l_suppkey*17 + l_orderkey*13) % 100000 AS INT) AS Y",
        "CAST((l_orderkey*3 + l_partkey*7) % 4000 + 100000 AS INT) AS Z",
        "CAST(element_at(array(1,2,3,4,5,7), CAST(l_linenumber % 6 AS INT) + 1) AS INT) AS classification",
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS owner", "o_custkey % 200 AS domain",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status",
        "CAST(o_orderdate AS TIMESTAMP) AS modified_on", "CAST(floor(o_totalprice) AS BIGINT) AS size_bytes", "o_orderpriority AS tag",
    )
