"""Trees to voxels: crown templates by class, stamping, merging, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .generation import uniform

DBH_BIN, HEIGHT_BIN, RATIO_BIN = 2.75, 1.0, 0.1
#: Densities are summed as whole numbers of this part of a unit, so that sums are exact in any order.
GRAINS = 1e9


def class_keys() -> list[Column]:
    """Trees with equal keys share a crown template."""
    return [
        F.col("fia_species_code").alias("species"), F.floor(F.col("dbh") / DBH_BIN).cast("int").alias("dbh_bin"),
        F.floor(F.col("height") / HEIGHT_BIN).cast("int").alias("height_bin"), F.rint(F.col("crown_ratio") / RATIO_BIN).cast("int").alias("ratio_bin"),
    ]


def realizations(layers: Column, members: Column, most: int = 100) -> Column:
    return F.greatest(F.lit(1), F.least(F.pow(layers, 0.8).cast("int"), F.greatest(F.lit(1), members), F.lit(most)))


def realization_of(seed: int, key: Column, n: Column) -> Column:
    """Which realization a tree takes; by its id only, so alike however the table is partitioned."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long"), n).cast("int")


def crown_templates(classes: DataFrame, hr: float, vr: float) -> DataFrame:
    """classes(species, dbh_bin, height_bin, ratio_bin) with the voxels (dk, dj, di) of a paraboloid crown."""
    top, ratio = (F.col("height_bin") + 0.5) * HEIGHT_BIN, F.col("ratio_bin") * RATIO_BIN
    c = classes.withColumns({"length_": top * ratio, "radius_": 0.5 + F.col("height_bin") * 0.08})
    c = c.withColumn("nk_", F.greatest(F.lit(1), F.ceil(F.col("length_") / vr)).cast("int")).withColumn("nr_", F.ceil(F.col("radius_") / hr).cast("int"))
    c = c.withColumn("dk", F.explode(F.sequence(F.lit(0), F.col("nk_") - 1)))
    for d in ("dj", "di"):
        c = c.withColumn(d, F.explode(F.sequence(-F.col("nr_"), F.col("nr_"))))
    wide = F.col("radius_") * F.col("radius_") * (1 - (F.col("dk") + 0.5) / F.col("nk_"))
    far = (F.col("dj") * F.col("dj") + F.col("di") * F.col("di")) * F.lit(hr * hr)
    return c.filter((far <= wide) | ((F.col("dj") == 0) & (F.col("di") == 0))).select(*classes.columns, "dk", "dj", "di", "nk_")


CLASS = ["species", "dbh_bin", "height_bin", "ratio_bin"]


def occupancy(hr: float) -> Column:
    """How likely a voxel of a template has fuel: 1 at the stem, half of that at the crown's edge in its layer."""
    radius = 0.5 + F.col("height_bin") * 0.08
    wide = radius * radius * (1 - (F.col("dk") + 0.5) / F.col("nk_"))
    far = (F.col("dj") * F.col("dj") + F.col("di") * F.col("di")) * F.lit(hr * hr)
    return 1 - 0.5 * F.least(F.lit(1.0), far / wide)


def realized_templates(templates: DataFrame, classes: DataFrame, seed: int, keep: Column, draw=uniform) -> DataFrame:
    """templates with a row per realization and voxel that it has: classes(the keys, realizations) says how many there are of each
    class. A voxel stays where its own draw, by seed, class, realization and place, is below `keep`; the stem's voxels always do.
    So realizations differ, and none depends on which task makes it."""
    t = templates.join(classes.select(*CLASS, "realizations"), CLASS).withColumn("realization", F.explode(F.sequence(F.lit(0), F.col("realizations") - 1)))
    u = draw(seed, *(F.col(c) for c in (*CLASS, "realization", "dk", "dj", "di")))
    stem = (F.col("dj") == 0) & (F.col("di") == 0)
    return t.filter(stem | (u < keep)).select(*CLASS, "realization", "dk", "dj", "di", "nk_")


#: Columns of voxels across a tile of `stamp`.
TILE = 32


def stamp(trees: DataFrame, templates: DataFrame, hr: float, vr: float, x0: float, y1: float, rows: int, cols: int, load: Column, tiled: bool = False) -> DataFrame:
    """(k, j, i, tree_id, height, grains) of all crowns, cut at the grid's edge; a tree's load is spread evenly, in GRAINS a unit of density.
    Templates are keyed by any of the class keys; those with realizations need trees with the realization that each takes.

    tiled: also `tile`, a square of TILE x TILE columns, and `rank`, which rises with (height, tree_id) within it. Trees are dealt
    to the tiles that their crowns may reach and grow there, so the voxels of a tile are all made in one partition: what
    `merged` and `collapse_stamps` shuffle is trees, never stamps. Templates are broadcast then."""
    keys = [c for c in (*CLASS, "realization") if c in templates.columns]
    # Templates are read twice: pass a written table.
    sizes = templates.groupBy(*keys).agg(F.count("*").alias("voxels_"), F.max(F.greatest(F.abs("dj"), F.abs("di"))).alias("reach_"))
    own = [c for n, c in zip(CLASS, class_keys(), strict=True) if n in keys]
    t = trees.select("tree_id", "height", "x", "y", *(["realization"] if "realization" in keys else []), load.alias("load_"), F.floor(F.col("height") * (1 - F.col("crown_ratio")) / vr).cast("int").alias("k0_"), *own)
    t = t.withColumns({"i0_": F.floor((F.col("x") - x0) / hr).cast("int"), "j0_": F.floor((y1 - F.col("y")) / hr).cast("int")}).drop("x", "y")
    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tiled:
        across = (cols - 1) // TILE + 1
        t = t.join(sizes, keys).filter((F.col("j0_") + F.col("reach_") >= 0) & (F.col("j0_") - F.col("reach_") < rows) & (F.col("i0_") + F.col("reach_") >= 0) & (F.col("i0_") - F.col("reach_") < cols))
        met = lambda c, size: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - F.col("reach_"), F.lit(0)) / TILE), F.floor(F.least(F.col(c) + F.col("reach_"), F.lit(size - 1)) / TILE)))
        t = t.withColumn("tj_", met("j0_", rows)).withColumn("ti_", met("i0_", cols)).withColumn("tile", (F.col("tj_") * across + F.col("ti_")).cast("int")).drop("tj_", "ti_", "reach_")
        t = t.repartition(n, "tile").sortWithinPartitions("height", "tree_id").withColumn("rank", F.monotonically_increasing_id())
        out, more = t.join(F.broadcast(templates), keys), ["tile", "rank"]
    else:
        # A tree grows to all voxels of its crown: few files of trees are dealt to all tasks first.
        out, more = t.repartition(n, "tree_id").join(sizes, keys).join(templates, keys), []
    out = out.select((F.col("k0_") + F.col("dk")).alias("k"), (F.col("j0_") + F.col("dj")).alias("j"), (F.col("i0_") + F.col("di")).alias("i"), "tree_id", "height", F.rint(F.col("load_") / F.col("voxels_") / F.lit(hr * hr * vr) * F.lit(GRAINS)).cast("long").alias("grains"), *more)
    out = out.filter((F.col("j") >= 0) & (F.col("j") < rows) & (F.col("i") >= 0) & (F.col("i") < cols))
    return out.filter(F.floor(F.col("j") / TILE) * across + F.floor(F.col("i") / TILE) == F.col("tile")) if tiled else out


def _within(stamps: DataFrame) -> list[str]:
    return ["tile"] if "tile" in stamps.columns else []


def merged(stamps: DataFrame) -> DataFrame:
    """Overlapping crowns: densities add; the tallest tree (ties: the later id) names the voxel."""
    if "rank" in stamps.columns:
        return stamps.groupBy("tile", "k", "j", "i").agg(density(F.sum("grains")), F.max_by("tree_id", "rank").alias("tree_id")).drop("tile")
    # Two steps of sums and maxima, which combine before the shuffle; a maximum of pairs would sort all stamps.
    by = stamps.groupBy("k", "j", "i", "height").agg(F.sum("grains").alias("grains"), F.max("tree_id").alias("tree_id"))
    return by.groupBy("k", "j", "i").agg(density(F.sum("grains")), F.max_by("tree_id", "height").alias("tree_id"))


def density(grains: Column) -> Column:
    return (grains / F.lit(GRAINS)).alias("density")


def collapse(voxels: DataFrame, vr: float) -> DataFrame:
    """Per column of voxels(k, j, i, density): load (kg/m2), layers with fuel and canopy height."""
    return collapse_stamps(voxels.withColumn("grains", F.rint(F.col("density") * F.lit(GRAINS)).cast("long")), vr)


def collapse_stamps(stamps: DataFrame, vr: float) -> DataFrame:
    """collapse of merged stamps, without asking which tree names a voxel: heights and ids are never grouped."""
    tile = _within(stamps)
    layers = stamps.groupBy(*tile, "k", "j", "i").agg(F.sum("grains").alias("grains"))
    return layers.groupBy(*tile, "j", "i").agg((density(F.sum("grains")) * vr).alias("load"), F.count("*").alias("layers"), ((F.max("k") + 1) * vr).alias("canopy_height")).drop(*tile)


def densify(voxels: DataFrame, lattice: DataFrame, fills: dict[str, object]) -> DataFrame:
    """All cells of the lattice(k, j, i), absent ones with each band's fill value."""
    return lattice.join(voxels, ["k", "j", "i"], "left").select("k", "j", "i", *(F.coalesce(F.col(b), F.lit(v)).alias(b) for b, v in fills.items()))


def partitioned(voxels: DataFrame, live: float, specific_leaf_area: float) -> DataFrame:
    """Density split into live and dead, and the leaf area density of the live part."""
    own = F.col("density") * F.lit(live)
    return voxels.withColumns({"live": own, "dead": F.col("density") * F.lit(round(1 - live, 12)), "leaf_area": own * F.lit(specific_leaf_area)})


def equivalence_classes(trees: DataFrame) -> DataFrame:
    """(species, dbh_bin, height_bin, ratio_bin, members, class): classes numbered from 1 in the order of their keys."""
    keys = ["species", "dbh_bin", "height_bin", "ratio_bin"]
    classes = trees.groupBy(*class_keys()).agg(F.count("*").alias("members"))
    return files.numbered(classes, [], keys, "class").withColumn("class", F.col("class") + 1)


def dimensions(trees: DataFrame, hr: float, vr: float) -> DataFrame:
    """One row: upper left corner snapped outward to whole cells, and nx, ny, nz of the voxel grid that holds all stems."""
    out = trees.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))), F.max("height").alias("top"))
    low, high = lambda c: F.floor(F.col(f"min{c}") / hr), lambda c: F.ceil(F.col(f"max{c}") / hr)
    return out.select((low("x") * F.lit(hr)).cast("double").alias("x0"), (high("y") * F.lit(hr)).cast("double").alias("y1"), (high("x") - low("x")).cast("int").alias("nx"), (high("y") - low("y")).cast("int").alias("ny"), F.ceil(F.ceil("top") / vr).cast("int").alias("nz"))
