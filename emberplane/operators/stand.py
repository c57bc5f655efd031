"""Summaries, stand metrics and thinning of tree tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FT2_PER_M2, ACRE_M2, CM_PER_INCH = 10.763910416709722, 4046.8564224, 2.54


def finite(c: Column) -> Column:
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def basal_area(dbh: Column) -> Column:
    """m2 of a stem of `dbh` cm."""
    return F.lit(math.pi) * F.pow(dbh / 200, 2)


def column_summary(df: DataFrame, columns, sample: bool = True) -> DataFrame:
    """A row per column: count, null_count, min, max, mean and standard deviation (sample or population)."""
    parts = []
    for c in columns:
        v = finite(F.col(c).cast("double"))
        parts.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), (F.count("*") - F.count(v)).alias("null_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.stddev_samp if sample else F.stddev_pop)(v).alias("std")))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def stand_metrics(df: DataFrame, area_m2: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Basal area (ft2/acre), stems per acre and quadratic mean diameter (inch); no stems: nulls."""
    acres = area_m2 / ACRE_M2
    n, ba = F.count("dbh"), F.sum(basal_area(F.col("dbh")))
    out = df.groupBy(*by) if by else df.groupBy()
    return out.agg(
        n.alias("n"), F.when(n > 0, ba * FT2_PER_M2 / acres).alias("basal_area"), F.when(n > 0, n / acres).alias("trees_per_acre"),
        F.when(n > 0, F.sqrt(F.sum(F.col("dbh") * F.col("dbh")) / n) / CM_PER_INCH).alias("qmd"),
    )


def dominant_groups(df: DataFrame, groups: DataFrame, keep: int = 5) -> DataFrame:
    """Shares of basal area by species group: the largest `keep`, of which unmapped (-1) then goes."""
    by = df.groupBy("fia_species_code").agg(F.sum(basal_area(F.col("dbh"))).alias("ba"))
    by = by.join(groups, "fia_species_code", "left").groupBy(F.coalesce("species_group", F.lit(-1)).alias("species_group")).agg(F.sum("ba").alias("ba"))
    total = by.agg(F.sum("ba").alias("total"))  # one row
    top = by.join(F.broadcast(total)).select("species_group", F.least(F.col("ba") / F.col("total"), F.lit(1.0)).alias("share"))
    return top.orderBy(F.desc("share"), "species_group").limit(keep).filter("species_group <> -1")


def thin_diameter(df: DataFrame, limit: float, below: bool) -> DataFrame:
    """From below keeps dbh >= limit, from above dbh < limit."""
    return df.filter(F.col("dbh") >= limit if below else F.col("dbh") < limit)


def shuffled(keys: list[str], seed: int) -> Column:
    """A number by the hash of a stem's keys: the same order however the table is partitioned."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *keys, F.lit(str(seed))).cast("binary")), 1, 13), 16, 10).cast("double")


def thin_basal_area(df: DataFrame, target_m2: float, order: Column, ids: tuple[str, ...], bins: int = 1024, small: int = 200_000) -> DataFrame:
    """Keep stems in ascending `order` while their summed basal area stays within the target: a strict prefix.

    No global window: order values are binned between their bounds, the bins' sums (`bins` rows at most) say
    which bins are within the target, and the bin that the target cuts is binned again. Where one order value
    is left with many stems, these are binned by their first id, then by the next. Only a bin of `small` stems or fewer is sorted.
    """
    df = df.filter(F.col("dbh").isNotNull()).withColumns({"key_": order.cast("double"), "ba_": basal_area(F.col("dbh"))})
    done, kept, keys = 0.0, F.lit(False), ["key_", *ids]
    open_, at = F.lit(True), 0
    while True:
        cut = df.filter(open_)
        key = F.col(keys[at]).cast("double")
        low, high, n = cut.agg(F.min(key), F.max(key), F.count("*")).first()
        if not n:
            break
        if n <= small or (low == high and at + 1 == len(keys)):
            inside = cut.withColumn("run_", F.sum("ba_").over(Window.partitionBy(F.lit(0)).orderBy("key_", *ids).rowsBetween(Window.unboundedPreceding, 0)))
            return df.filter(kept).unionByName(inside.filter(F.col("run_") <= F.lit(target_m2 - done)).drop("run_")).drop("key_", "ba_")
        if low == high:
            at += 1
            continue
        width = (high - low) / bins
        bin_ = F.least(F.floor((key - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        over, held = None, done
        for r in cut.groupBy(bin_.alias("bin_")).agg(F.sum("ba_").alias("s")).orderBy("bin_").collect():
            if held + r.s > target_m2:
                over = r.bin_
                break
            held += r.s
        if over is None:
            kept = kept | open_
            break
        kept, done, open_ = kept | (open_ & (bin_ < over)), held, open_ & (bin_ == over)
    return df.filter(kept).drop("key_", "ba_")


def thin_within(df: DataFrame, region: Column, thin) -> DataFrame:
    """Thin only the rows of the region."""
    inside = F.coalesce(region, F.lit(False))
    return thin(df.filter(inside)).unionByName(df.filter(~inside))
