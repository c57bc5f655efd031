"""Sharding by a k-d tree over document metadata, balanced by bytes.

The unit is a group of equal texts, which stays together unless it is larger than a shard (then it is dealt into parts by
a hash of the id). Groups above 1/LARGE of a shard, of which there are LARGE a shard at most, are placed first, each in
the least loaded shard, largest first; what is left of each shard's bytes is the aim of its leaf. Each node of the tree is
cut at the weighted median of its widest dimension (of id, size, source and language, each scaled to its range over all
documents; ties in a hash order), or where its leaves' aims part. The cut is found exactly by sums per digit of the
key, five digits of 13 bits, for all nodes of a level at once. Nodes, sums and cuts are tables: the driver counts levels.

A null text has size 1 and checksum 0. Rows that share an id are placed each for itself, in any order among them; null
ids come first. Documents that no dimension tells apart are cut by the hash order, so equal metadata is balanced, too.
Missing source or language columns count as null; other columns are ignored. A very long text is one unit, and a shard
is no smaller than it. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from .common import discard, written

DIGIT, SHIFTS = 13, (50, 37, 24, 11, 0)
DIMENSIONS, LARGE = 4, 8
NODE = ["first", "leaves"]


def cuts(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(first, leaves, dim, share) with `cut`: the key of the node's dimension up to which its weight comes nearest to the share."""
    state = nodes.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "aim": F.lit(None).cast("double")})
    last = 63
    for shift in SHIFTS:
        key = F.element_at(F.array(*(f"k{d}" for d in range(DIMENSIONS))), F.col("dim") + 1)
        here = units.join(state, NODE).filter(F.shiftright(key, last) == F.col("prefix"))
        sums = here.groupBy(*state.columns, F.shiftright(key, shift).alias("digit")).agg(F.sum("weight").alias("w"))
        own = Window.partitionBy(*NODE)
        sums = sums.withColumn("aim", F.coalesce("aim", F.sum("w").over(own) * F.col("share")))
        sums = sums.withColumn("reach", F.col("before") + F.sum("w").over(own.orderBy("digit")))  # of 2^DIGIT digits at most
        at = F.struct("digit", "reach", "w")
        found = sums.groupBy("first", "leaves", "dim", "share", "aim").agg(F.coalesce(F.min(F.when(F.col("reach") >= F.col("aim"), at)), F.max(at)).alias("at"))
        below = F.col("at.reach") - F.col("at.w")
        # The digit that holds the share; at the last one the nearer side of it.
        short = F.when(F.lit(shift == 0) & (F.col("aim") - below < F.col("at.reach") - F.col("aim")), 1).otherwise(0)
        was, state = state, written(found.select("first", "leaves", "dim", "share", (F.col("at.digit") - short).alias("prefix"), below.alias("before"), "aim"), "cuts")
        discard(was)
        last = shift
    return state.withColumnRenamed("prefix", "cut")


def kd_leaves(units: DataFrame, leaves: int, aims: DataFrame | None = None) -> DataFrame:
    """units(weight, d0..d3 scaled to 0..2^31-1, tie) with their leaf, 0 to leaves - 1. aims(leaf, upto), with a row for each leaf and
    one more, cumulates the weights that leaves are to hold; without, all are to hold the same."""
    keys = {f"k{d}": F.shiftleft(F.col(f"d{d}").cast("long"), 32).bitwiseOR(F.col("tie").bitwiseAND(0xFFFFFFFF)) for d in range(DIMENSIONS)}
    units = units.withColumns(keys).withColumns({"first": F.lit(0), "leaves": F.lit(leaves)})
    left = F.floor(F.col("leaves") / 2).cast("int")
    for _ in range((leaves - 1).bit_length()):
        spans = [(F.max(f"d{d}") - F.min(f"d{d}")).alias(f"s{d}") for d in range(DIMENSIONS)]
        nodes = units.filter("leaves > 1").groupBy(*NODE).agg(*spans)
        widest = F.array_position(F.array(*(f"s{d}" for d in range(DIMENSIONS))), F.greatest(*(f"s{d}" for d in range(DIMENSIONS)))) - 1
        nodes = nodes.withColumns({"dim": widest.cast("int"), "share": left / F.col("leaves")})
        if aims is not None:
            for name, place in (("a", F.col("first")), ("b", F.col("first") + left), ("c", F.col("first") + F.col("leaves"))):
                nodes = nodes.withColumn("leaf", place).join(aims.withColumnRenamed("upto", name), "leaf").drop("leaf")
            nodes = nodes.withColumn("share", F.when(F.col("c") > F.col("a"), (F.col("b") - F.col("a")) / (F.col("c") - F.col("a"))).otherwise(F.col("share")))
        nodes = written(nodes.select(*NODE, "dim", "share"), "nodes")
        cut = cuts(units, nodes).select(*NODE, "dim", "cut")
        key = F.element_at(F.array(*(f"k{d}" for d in range(DIMENSIONS))), F.col("dim") + 1)
        moved = units.join(cut, NODE, "left").withColumn("side", F.when(F.col("cut").isNull(), 0).when(key <= F.col("cut"), 1).otherwise(2))
        first = F.when(F.col("side") == 2, F.col("first") + left).otherwise(F.col("first"))
        size = F.when(F.col("side") == 1, left).when(F.col("side") == 2, F.col("leaves") - left).otherwise(F.col("leaves"))
        was, units = units, written(moved.withColumns({"first": first, "leaves": size}).drop("dim", "cut", "side"), "units")
        discard(was, nodes)
    return units.withColumn("leaf", F.col("first"))


def place_large(groups: list[tuple[str, int, int]], shards: int, total: int) -> tuple[list[tuple[str, int, int]], list[float]]:
    """(same, part, weight) of large groups to (same, part, shard), and how many bytes each shard has left."""
    loads = [(0, s) for s in range(shards)]
    placed = []
    for same, part, weight in sorted(groups, key=lambda g: (-g[2], g[0], g[1])):
        load, s = heapq.heappop(loads)
        placed.append((same, part, s))
        heapq.heappush(loads, (load + weight, s))
    left = [0.0] * shards
    for load, s in loads:
        left[s] = max(0.0, total / shards - load)
    return placed, left


def _scaled(low, high, value: Column) -> Column:
    if low is None or high == low:
        return F.lit(0)
    share = (F.coalesce(value.cast("double"), F.lit(float(low))) - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.floor(share * F.lit((1 << 31) - 1)).cast("long")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per row of docs(doc_id, text[, source, lang]): doc_id, size, text_crc32, shard, slot (0, 1, ... in
    ascending id within the shard). Give the number of shards, or the bytes a shard is to hold."""
    has, spark = set(docs.columns), docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = [F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).alias(c) if c in has else F.lit(0).cast("long").alias(c) for c in ("source", "lang")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("same"), *meta)
    rows = written(rows, "rows")
    ranges = rows.agg(*(f(c) for c in ("doc_id", "size", "source", "lang") for f in (F.min, F.max)), F.sum("size")).first()
    total = ranges[8] or 0
    shards = shards or max(1, -(-total // target_bytes))
    target = max(1, total // shards)

    # Groups above a shard, one a shard at most, are dealt by the id.
    huge = rows.groupBy("same").agg(F.sum("size").alias("w")).filter(F.col("w") > target).select("same", F.ceil(F.col("w") / target).alias("parts"))
    rows = rows.join(huge, "same", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    units = rows.groupBy("same", "part").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    dims = [_scaled(ranges[2 * k], ranges[2 * k + 1], F.col(c)).alias(f"d{k}") for k, c in enumerate(("doc_id", "size", "source", "lang"))]
    units = written(units.select("same", "part", "weight", F.xxhash64("same", "part").alias("tie"), *dims), "units")

    placed, left = place_large([tuple(r) for r in units.filter(F.col("weight") > target / LARGE).select("same", "part", "weight").collect()], shards, total)  # LARGE a shard at most
    if placed:
        upto = [0.0]
        for x in left:
            upto.append(upto[-1] + x)
        large = spark.createDataFrame(placed, "same string, part int, shard int")
        aims = spark.createDataFrame(list(enumerate(upto)), "leaf int, upto double")
        small = kd_leaves(units.filter(F.col("weight") <= target / LARGE), shards, aims).select("same", "part", F.col("leaf").alias("shard"))
        leaf = written(small.unionByName(large), "leaves")
    else:
        leaf = written(kd_leaves(units, shards).select("same", "part", F.col("leaf").alias("shard")), "leaves")
    out = rows.join(leaf, ["same", "part"]).select("doc_id", "size", "text_crc32", "shard")
    return files.numbered(out, ["shard"], ["doc_id"], "slot")
