"""Feature layers stored by area, and an index of the areas that says which of them a box meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS, FEW = ("road", "water"), 10_000


def write_layers(features: DataFrame, root: str, kind: str) -> None:
    """features(area, minx, miny, maxx, maxy, ...) as one layer (folder) for each area, in files that several tasks write."""
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [F.floor(F.col(c) / 100) for c in ("minx", "miny")]
    features.repartitionByRange(n, "area", *place).sortWithinPartitions("area", *place).write.partitionBy("area").parquet(f"{root}/{kind}")


def meets(box: tuple[float, float, float, float]) -> Column:
    """Whether minx to maxy of a row meet a box, edges included."""
    return (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1])


def read_layers(spark: SparkSession, root: str, kind: str, index: DataFrame, box: tuple[float, float, float, float], key: str, order: str, schema: StructType | None = None) -> DataFrame:
    """Features of a kind that meet a box, from the layers of the areas of index(area, minx, miny, maxx, maxy) that meet it.

    The index is joined on the folders' column, so that Spark prunes the other layers before it opens a file. An area
    without a layer has no features; a layer that can't be read is an error, not an empty one. A feature that several
    layers have comes once (by `key`: the least `order`). Without a schema Spark takes it from one of the files."""
    if kind not in KINDS:
        raise ValueError(f"no feature kind {kind!r}: one of {KINDS}")
    met = index.filter(meets(box)).select("area").distinct()
    try:
        layers = (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{kind}")
    except Exception as e:  # no area has a layer of this kind
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{key} long, {order} long")
    # The folders are pruned by a broadcast of the areas met; more than FEW are joined by Spark's own choice.
    met = F.broadcast(met) if met.limit(FEW + 1).count() <= FEW else met
    found = layers.filter(meets(box)).join(met.withColumn("area", F.col("area").cast(layers.schema["area"].dataType)), "area")
    rest = [c for c in found.columns if c not in (key, order)]
    return found.groupBy(key).agg(F.min_by(F.struct(order, *rest), order).alias("f")).select(key, "f.*")
