"""Trees from plots, imputed sizes, layer sets and species representatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import draws
from ..sources import files


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only, so alike however the table is partitioned."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def digest_uniform(seed: int, *keys: Column) -> Column:
    """As uniform, from the first 52 bits of the MD5 digest of "seed:key:...", which other engines have too; slower."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(mean: Column, most: int = 150) -> Column:
    """P(N <= k) for k = 0 to `most` as an array, of a Poisson number N with a mean up to 30, which is above 150
    with a chance under 1e-50."""
    def step(acc, k):
        p = F.when(k == 0, F.exp(-mean)).otherwise(acc["p"] * mean / k)
        return F.struct(p.alias("p"), (acc["t"] + p).alias("t"), F.array_append(acc["out"], acc["t"] + p).alias("out"))

    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step, lambda a: a["out"])


def _beside(table: DataFrame, most: int) -> DataFrame:
    """A written table to join a longer one with: broadcast if it has `most` rows or fewer, else hashed in shuffled
    parts. Left to itself, Spark sizes rows that an explode makes by the rows before it, and may broadcast those."""
    return F.broadcast(table) if table.count() <= most else table.hint("shuffle_hash")


#: Trees of a plot that a task holds, and stems that it makes at a time.
TREES, STEMS = 1 << 23, 1 << 17
#: The draws of columns, as a task makes them for arrays.
DRAWS = {uniform: draws.hashes, digest_uniform: draws.digests}


def _grown(draw: Callable[..., np.ndarray], seed: int, cell: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of trees (key_, tree, tpa), then those of the cells (key_, cell_) that draw from them, to stems."""

    def stems(c: dict, kinds: pa.StructType, trees: pa.Array, upto: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = draw([seed], c["row"], c["col"], np.arange(1, c["parts_"] + 1))[0]
        n = int(np.searchsorted(np.array(c["steps_"]), np.minimum(parts, 1 - 1e-13), "right").sum())
        for first in range(1, n + 1, STEMS):
            k = np.arange(first, min(first + STEMS, n + 1))
            numbers = draw([seed + 1, seed + 2, seed + 3], c["row"], c["col"], k)
            at = numbers[0] * c["total_"]
            order = np.argsort(at)  # neighbours look at the same trees
            order = order[slice(*np.searchsorted(at[order], (c["begin_"], c["end_"])))]
            same = lambda name: pa.repeat(pa.scalar(c[name], kinds.field(name).type), len(order))  # noqa: B023, E731
            place = lambda name, u: pa.array((c[name] + u[order]) * cell)  # noqa: B023, E731
            tree = trees.take(pa.array(np.searchsorted(upto, at[order], "right")))
            yield pa.record_batch([same("row"), same("col"), pa.array(k[order].astype(np.int32)), same("plot"), tree, place("col", numbers[1]), place("row", numbers[2])], ["row", "col", "stem", "plot", "tree", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trees, tpas, upto, made, n = None, [], [], None, [], 0
        for batch in batches:
            keys, is_cell = batch.column("key_").to_numpy(), batch.column("cell_").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(is_cell.astype(np.int8)) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(keys) else ():
                if keys[a] != key:
                    key, trees, tpas, upto = keys[a], [], [], None
                if not is_cell[a]:
                    trees.append(batch.column("tree").slice(a, z - a))
                    tpas.append(batch.column("tpa").slice(a, z - a).fill_null(0.0).to_numpy())
                    continue
                for c in batch.column("cell_").slice(a, z - a).to_pylist():
                    if upto is None:  # a tree begins where the one before it ends, to the bit
                        held = pa.concat_arrays(trees)
                        upto = np.minimum(np.cumsum(np.concatenate([[c["begin_"]], *tpas]))[1:], c["end_"])
                        upto[-1], trees, tpas = c["end_"], [], []
                    for some in stems(c, batch.schema.field("cell_").type, held, upto):
                        made.append(some)
                        n += some.num_rows
                        if n >= STEMS:
                            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                            made, n = [], 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return run


def expand_plots(cells: DataFrame, plots: DataFrame, cell: float, seed: int, draw: Callable = uniform) -> DataFrame:
    """cells(row, col, plot) and plots(plot, tree, tpa: stems per hectare) to stems(row, col, stem, plot, tree, x, y).

    Stems of a cell are Poisson with the plot's stems per hectare times its area (a mean above 30 is drawn in
    equal parts, whose distribution is made once a plot); each draws a tree of the plot in proportion to tpa and
    a place in the cell. Cells without a plot stay empty.

    Stems are far more than trees and cells, so they are never shuffled: a task gets a plot's trees and some of its
    cells, and grows these. Few plots are sent to several tasks each, with other cells. Of a plot of more than TREES
    trees a task gets a part, draws all stems of its cells and keeps those of its own trees.
    draw gives the uniform numbers: one of DRAWS, or a function as theirs, draw(seeds, row, col, ascending numbers)."""
    spark = cells.sparkSession
    total = plots.groupBy("plot").agg(F.sum("tpa").alias("total_"), F.count("*").alias("trees_"))
    mean = F.col("total_") * F.lit(cell * cell / 10_000)
    sized = total.withColumn("parts_", F.greatest(F.lit(1), F.ceil(mean / F.lit(30.0)).cast("int"))).withColumn("steps_", poisson_steps(mean / F.col("parts_")))
    sized = files.written(sized.filter(F.col("plot").isNotNull() & F.col("total_").isNotNull()), "plots")
    most = sized.agg(F.coalesce(F.max("trees_"), F.lit(1)).alias("trees"), F.greatest(F.count("*"), F.lit(1)).alias("plots")).first()
    shares = -(-most.trees // TREES)
    slices = -(-2 * spark.sparkContext.defaultParallelism // (most.plots * shares))
    tasks = min(most.plots * shares * slices, max(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = _beside(files.written(files.numbered(sized.select("plot"), [], ["plot"], "place_"), "places"), 10_000)
    key = lambda slice_: ((F.col("place_") * shares + F.col("share_")) * slices + slice_).alias("key_")
    if shares > 1:
        dealt = files.numbered(plots, ["plot"], ["tree"], "i_").withColumn("share_", F.floor(F.col("i_") / TREES))
        order = Window.partitionBy("plot").orderBy("share_")  # a row per share
        upto = F.sum("sum_").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ends = dealt.groupBy("plot", "share_").agg(F.sum(F.coalesce("tpa", F.lit(0.0))).alias("sum_")).withColumn("upto_", upto)
        last = F.lead("share_").over(order).isNull()
        ends = ends.select("plot", "share_", F.coalesce(F.lag("upto_").over(order), F.lit(0.0)).alias("begin_"), F.when(last, F.lit(float("inf"))).otherwise(F.col("upto_")).alias("end_"))
        ends = cells.join(_beside(files.written(ends, "shares"), 10_000), "plot")
    else:
        dealt = plots.withColumn("share_", F.lit(0))
        ends = cells.withColumns({"share_": F.lit(0), "begin_": F.lit(0.0), "end_": F.lit(float("inf"))})
    trees = dealt.join(place, "plot").withColumn("slice_", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    trees = trees.select(key(F.col("slice_")), F.lit(None).cast("boolean").alias("is_cell_"), "tree", "tpa")
    sown = ends.join(_beside(sized, 10_000), "plot").join(place, "plot")
    sown = sown.select(key(F.pmod(F.xxhash64("row", "col"), F.lit(slices))), F.lit(True).alias("is_cell_"), F.struct("row", "col", "plot", "total_", "parts_", "steps_", "begin_", "end_").alias("cell_"))
    both = trees.unionByName(sown, allowMissingColumns=True).repartitionById(tasks, F.pmod("key_", F.lit(tasks)).cast("int"))
    both = both.sortWithinPartitions("key_", "is_cell_", "tree").select("key_", "tree", F.col("tpa").cast("double").alias("tpa"), "cell_")
    kinds = {**{c: cells.schema[c].dataType for c in ("row", "col")}, "stem": T.IntegerType(), "plot": cells.schema["plot"].dataType, "tree": plots.schema["tree"].dataType, "x": T.DoubleType(), "y": T.DoubleType()}
    return both.mapInArrow(_grown(DRAWS.get(draw, draw), seed, cell), T.StructType([T.StructField(c, k) for c, k in kinds.items()]))


def impute(trees: DataFrame, predictions: DataFrame, keys: list[str], columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Fill nulls of trees from predictions(keys, ...): columns maps a tree column to its prediction and the unit factor."""
    p = predictions.select(*keys, *(F.col(src).alias(f"p_{c}") for c, (src, _) in columns.items()))
    filled = {c: F.coalesce(F.col(c), F.col(f"p_{c}") * F.lit(f)) for c, (_, f) in columns.items()}
    return trees.join(p, keys, "left").withColumns(filled).drop(*(f"p_{c}" for c in columns))


def prediction_faults(sent: DataFrame, made: DataFrame, keys: list[str], needed: str) -> DataFrame:
    """One row: sent, predicted, lost (sent without a prediction), without_height (predictions that lack the needed value)."""
    lost = sent.join(made.select(*keys), keys, "left_anti").agg(F.count("*").alias("lost"))
    return sent.agg(F.count("*").alias("sent")).join(made.agg(F.count("*").alias("predicted"), F.count_if(F.col(needed).isNull()).alias("without_height"))).join(lost).select("sent", "predicted", "lost", "without_height")  # one row each


def checked_predictions(sent: DataFrame, made: DataFrame, keys: list[str], needed: str) -> DataFrame:
    """prediction_faults, or an error unless as many were predicted as were sent, none is lost and all have the needed value."""
    out = prediction_faults(sent, made, keys, needed)
    r = out.first()
    if r.sent != r.predicted or r.lost or r.without_height:
        raise ValueError(f"{r.sent} sent, {r.predicted} predicted, {r.lost} lost, {r.without_height} without {needed}")
    return out


def representatives(codes: DataFrame, usable: DataFrame) -> DataFrame:
    """codes(code, genus, class) to (code, stands_for): itself where usable, else the least usable code of
    its genus, else of its class, else null."""
    by = lambda k: usable.groupBy(k).agg(F.min("code").alias(f"{k}_rep"))
    own = usable.select("code", F.col("code").alias("own_rep")).distinct()
    return codes.join(own, "code", "left").join(by("genus"), "genus", "left").join(by("class"), "class", "left").select("code", F.coalesce("own_rep", "genus_rep", "class_rep").alias("stands_for"))


LAYER = "struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<strata_fb:string,fuel_type:string,fuel_loading:double,fuel_height:double,percent_cover:double,distribution:string,patch_size:double>>"


def read_layers(texts: DataFrame, text: str) -> DataFrame:
    """GeoJSON features, one a row, to their properties and bounds with the first rule that they break:
    json, geographic (all coordinates within 180), cover, patch_size."""
    f = texts.withColumn("f_", F.from_json(text, LAYER))
    ring = F.flatten("f_.geometry.coordinates")
    side = lambda k, agg: agg(F.transform(ring, lambda p: p[k]))
    f = f.withColumns({"minx": side(0, F.array_min), "miny": side(1, F.array_min), "maxx": side(0, F.array_max), "maxy": side(1, F.array_max)})
    p = "f_.properties."
    rule = (
        F.when(F.col("f_.geometry.coordinates").isNull() | F.col(p + "fuel_type").isNull(), "json")
        .when((F.abs("minx") <= 180) & (F.abs("maxx") <= 180) & (F.abs("miny") <= 90) & (F.abs("maxy") <= 90), "geographic")
        .when(~F.col(p + "percent_cover").between(0, 100), "cover").when((F.col(p + "distribution") == "random_clusters") & F.col(p + "patch_size").isNull(), "patch_size")
    )
    return f.withColumn("fault", rule).select(*texts.drop(text).columns, "f_.properties.*", "minx", "miny", "maxx", "maxy", "fault")


def ingest_cells(cells: DataFrame, names: dict[str, str], box: tuple[float, float, float, float], cell: float, buffer_cells: int) -> DataFrame:
    """cells(x, y, b1, ...) with bands renamed and clipped to a box and `buffer_cells` around it, plus
    `regular`: whether the centres of its row step by whole cells."""
    missing = [b for b in names if b not in cells.columns]
    if missing:
        raise ValueError(f"no bands {missing}")
    pad = buffer_cells * cell
    step = (F.col("x") - F.lag("x").over(Window.partitionBy("y").orderBy("x"))) / cell
    kept = cells.withColumn("regular", F.coalesce(F.abs(step - F.rint(step)) < 1e-6, F.lit(True)))
    return kept.filter(F.col("x").between(box[0] - pad, box[2] + pad) & F.col("y").between(box[1] - pad, box[3] + pad)).withColumnsRenamed(names)


def calibrated(cells: DataFrame, value: str, how: str, low: float, high: float = 0.0) -> DataFrame:
    """Non-zero cells rescaled to a target: maxmin (low, high), meansd (mean, deviation) or constant."""
    v = F.when(F.col(value) != 0, F.col(value))
    low_, high_, mean, deviation = map(F.lit, cells.agg(F.min(v), F.max(v), F.avg(v), F.stddev(v)).first())
    new = {
        "maxmin": F.coalesce(F.try_divide((v - low_) * F.lit(high - low), high_ - low_), F.lit(0.0)) + F.lit(low),
        "meansd": F.coalesce(F.try_divide((v - mean) * F.lit(high), deviation), F.lit(0.0)) + F.lit(low),
        "constant": F.lit(low),
    }[how]
    return cells.withColumn(value, F.when(v.isNotNull(), new).otherwise(F.col(value)))
