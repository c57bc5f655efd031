"""Small goldens for what SQL twins do not show: missing values, errors, geometry."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberplane.functions import codes, draws, units
from emberplane.operators import catalogue, compose, coverage, generation, grids, ingest, lattices, layers, pointcloud, polygons, reprojection, rules, spatial, stand, voxels
from emberplane.operators.rules import Action, Condition, Rule
from emberplane.sources import files, tables
from emberplane.streaming import dispatches

TREES = "tree_id int, x double, y double, dbh double, height double, crown_ratio double, fia_species_code int"


@pytest.fixture(scope="module")
def five(spark):
    data = [(k, float(k), float(k), d, 10.0 + k, 0.5, 122) for k, d in enumerate((4.0, 12.0, 7.0, 3.0, 26.0))]
    return spark.createDataFrame([*data, (5, None, None, None, float("nan"), None, None)], TREES)


def test_missing_values_in_predicates(five):
    def n(op, nodata=False):
        return five.filter(rules.predicate(Condition("dbh", op, 12.0), nodata)).count()

    assert (n("ne"), n("ne", True), n("gt"), n("le")) == (5, 4, 1, 4)
    with pytest.raises(ValueError):
        rules.predicate(Condition("dbh", "gt", [1.0]))


def test_expression_is_limited():
    for text in ("open('x')", "dbh.a > 1", "spcd > 1", "'a' = dbh"):
        with pytest.raises((ValueError, SyntaxError)):
            rules.expression(text)


def test_remove_keeps_rows_without_a_value(five):
    assert five.count() - 1 == rules.edit_trees(five, [Rule((Action("", "remove"),), (Condition("dbh", "gt", 20.0),))]).count()


def test_basal_area_thinning_is_a_strict_prefix(five):
    kept = stand.thin_basal_area(five, 0.06, -F.col("dbh"), ("tree_id",))
    assert [r.dbh for r in kept.collect()] == [26.0]
    assert stand.thin_basal_area(five, 99.0, -F.col("dbh"), ("tree_id",)).count() == 5


def test_stand_metrics_and_summary(five, spark):
    m = stand.stand_metrics(five, 100.0).first()
    assert m.n == 5 and m.qmd == pytest.approx(math.sqrt(894 / 5) / 2.54)
    assert stand.stand_metrics(five.limit(0), 100.0).first().basal_area is None
    s = stand.column_summary(five, ["height"]).first()
    assert (s.n, s.null_count) == (5, 1)


def test_units_and_codes(spark):
    assert units.factor("ft2/acre", "m2/ha") == pytest.approx(0.2295684)
    with pytest.raises(ValueError):
        units.factor("m", "kg")
    r = spark.range(1).select(codes.code_of(F.lit(" gr1 ")).alias("a"), codes.label_of(F.lit(98)).alias("b"), codes.code_of(F.lit("XX")).alias("c")).first()
    assert tuple(r) == (101, "NB8", None)


def test_points_on_edges(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    p = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (0.0, 5.0), (10.0, 10.0), (11.0, 5.0)], "x double, y double")
    got = p.select(spatial.condition(F.col("x"), F.col("y"), square, "within").alias("w"), spatial.condition(F.col("x"), F.col("y"), square, "intersects").alias("i")).collect()
    assert [(r.w, r.i) for r in got] == [(True, True), (False, False), (False, True), (False, True), (False, False)]


def test_utm_on_the_central_meridian(spark):
    # The meridian arc from the equator to 45 degrees is 4984944.378 m on this ellipsoid.
    e, n = spatial.utm(F.lit(-117.0), F.lit(45.0), 11)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(500000, abs=1e-6) and r.n == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_greedy_cover(spark):
    cells = spark.createDataFrame([(c, n) for n, cs in {"a": range(10), "b": range(8, 20), "c": range(3)}.items() for c in cs], "cell int, name string")
    assert spatial.greedy_cover(cells, spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "name string, density double")) == ["b", "a"]


def test_greedy_cover_runs_to_the_end(spark):
    # 100 names of 3 cells and 60 of one cell or two that overlap: more than any fixed number of rounds takes.
    rng = random.Random(4)
    own = {f"n{k}": set(range(3 * k, 3 * k + 3)) for k in range(100)} | {f"m{k}": set(rng.sample(range(320), rng.randint(1, 2))) for k in range(60)}
    density = {n: float(rng.randint(1, 3)) for n in own}
    left, want = dict(own), []
    while any(left.values()):
        best = max(left, key=lambda n: (len(left[n]), density[n], n))
        want.append(best)
        left = {n: c - own[best] for n, c in left.items()}
    cells = spark.createDataFrame([(c, n) for n, cs in own.items() for c in cs], "cell int, name string")
    assert spatial.greedy_cover(cells, spark.createDataFrame(list(density.items()), "name string, density double")) == want
    assert len(want) > 100


def test_dense_plots_keep_their_stems(spark):
    for mean in (5.0, 90.0, 500.0):
        cells = spark.range(400).selectExpr("CAST(id AS INT) AS row", "1 AS col", "id % 2 AS plot")
        plots = spark.createDataFrame([(p, t, mean * s) for p in (0, 1) for t, s in ((1, 0.1), (2, 0.2), (3, 0.7))], "plot long, tree long, tpa double")
        stems = generation.expand_plots(cells, plots, 100.0, seed=7)
        n = [r["count"] for r in stems.groupBy("row").count().collect()]
        n += [0] * (400 - len(n))
        average = sum(n) / 400
        assert abs(average - mean) < 4 * math.sqrt(mean / 400)
        assert 0.7 < sum((k - average) ** 2 for k in n) / 399 / mean < 1.35
        share = stems.filter("tree = 3").count() / sum(n)
        assert abs(share - 0.7) < 4 * math.sqrt(0.21 / sum(n))
        assert stems.select("row", "col", "stem").distinct().count() == sum(n)


def test_levels_and_files(spark, tmp_path):
    p = spark.range(100).selectExpr("id", "CAST(id AS INT) AS X", "CAST(id AS INT) AS Y", "0 AS Z", "1 AS classification")
    p = pointcloud.with_lod(pointcloud.tiled(p, 50.0), ("id",))
    pointcloud.write_points(p, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.lod: r.n for r in pointcloud.tile_catalogue(back).collect()} == {0: 1, 2: 1, 3: 5, 4: 18, 5: 75}
    assert pointcloud.read_points(back, (0.0, 0.0, 0.5, 0.5), 50.0, exact=True).count() == 51


def test_tallest_tree_names_the_voxel(spark):
    half = 500_000_000  # grains, 10^9 a unit of density
    s = spark.createDataFrame([(0, 0, 0, 1, 5.0, half), (0, 0, 0, 2, 9.0, half // 2), (1, 0, 0, 1, 5.0, half)], "k int, j int, i int, tree_id int, height double, grains long")
    assert sorted(tuple(r) for r in voxels.merged(s).collect()) == [(0, 0, 0, 0.75, 2), (1, 0, 0, 0.5, 1)]


def test_an_owner_without_limit_never_expires(spark):
    rows = spark.createDataFrame([(1, 1, "completed", "1999-01-01"), (2, 2, "completed", "1999-01-01"), (3, 2, "failed", None)], "id int, owner int, status string, t string").withColumn("modified_on", F.col("t").cast("timestamp"))
    owners = spark.createDataFrame([(1, None, None)], "owner int, ttl int, failed_ttl int")
    assert [r.id for r in catalogue.expired(catalogue.with_ttl(rows, owners), F.lit("2001-09-01").cast("timestamp")).collect()] == [2]


def test_thinning_narrows_the_bin_that_is_cut(spark):
    own = random.Random(1)
    rows = [(k, own.choice((10.0, 20.0, 20.0, 20.0, 30.0)), k % 7) for k in range(500)]
    table = spark.createDataFrame(rows, "tree_id int, dbh double, line int")
    left, want = 4.0, []
    for k, d, _ in sorted(rows, key=lambda r: (-r[1], r[2], r[0])):
        left -= math.pi * (d / 200) ** 2
        if left < 0:
            break
        want.append(k)
    got = stand.thin_basal_area(table, 4.0, -F.col("dbh"), ("line", "tree_id"), bins=4, small=20)
    assert sorted(r.tree_id for r in got.collect()) == sorted(want)


def lattice_of(a):
    return [(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]


def as_array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


@pytest.mark.parametrize("block", [7, 256])
def test_focal_operators_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(grids, "BLOCK", block)
    own = np.random.default_rng(3)
    a = own.integers(0, 40, (23, 31)).astype(float)
    a[own.random(a.shape) < 0.3] = np.nan
    cells = spark.createDataFrame(lattice_of(a), "row int, col int, z double")
    pad = lambda x, k, fill: np.pad(x, k, constant_values=fill)
    near = lambda x, k, fill: np.stack([pad(x, k, fill)[k + r : k + r + x.shape[0], k + c : k + c + x.shape[1]] for r in range(-k, k + 1) for c in range(-k, k + 1)])

    filled = a.copy()
    for _ in range(2):
        seen = np.pad(filled, 1, mode="edge")
        seen = np.stack([seen[r : r + a.shape[0], c : c + a.shape[1]] for r in range(3) for c in range(3)])
        known = (~np.isnan(seen)).sum(0)
        filled = np.where(np.isnan(filled) & (known > 0), np.nansum(seen, 0) / np.maximum(known, 1), filled)
    np.testing.assert_allclose(as_array(grids.fill_gaps(cells, "z", 2), "z", a.shape), filled)

    ground, before = a.copy(), 1
    for w in (3, 5):
        low = np.where(np.isnan(ground), np.nan, near(np.where(np.isnan(ground), np.inf, ground), w // 2, np.inf).min(0))
        opened = near(np.where(np.isnan(low), -np.inf, low), w // 2, -np.inf).max(0)
        limit = 0.15 if w <= 3 else min((w - before) * 1.0 + 0.15, 2.5)
        ground, before = np.where(ground - opened > limit, opened, ground), w
    np.testing.assert_allclose(as_array(grids.bare_ground(cells, "z", 1.0, (3, 5)), "ground", a.shape), ground)

    whole = spark.createDataFrame(lattice_of(np.nan_to_num(a)), "row int, col int, z double")
    dy, dx = np.gradient(np.nan_to_num(a), 2.0)
    np.testing.assert_allclose(as_array(grids.slope_aspect(whole, "z", 2.0), "slope", a.shape), np.degrees(np.arctan(np.hypot(dx, dy))))

    known = spark.createDataFrame([(2, 3), (20, 30)], "row int, col int")
    r, c = np.mgrid[: a.shape[0], : a.shape[1]]
    far = np.minimum(np.minimum(np.hypot(r - 2, c - 3), np.hypot(r - 20, c - 30)), 9)
    np.testing.assert_allclose(as_array(grids.distance_to_known(whole, known, 9), "distance", a.shape), far)


def test_a_gap_is_no_edge_for_slopes(spark):
    plane = spark.createDataFrame([(r, c, float(c)) for r in range(5) for c in range(7) if c != 3], "row int, col int, z double")
    got = {(r.row, r.col): r.slope for r in grids.slope_aspect(plane, "z", 1.0).collect()}
    assert {c: got[2, c] for c in (0, 1, 2, 4, 5, 6)} == {0: 45.0, 1: 45.0, 2: None, 4: None, 5: 45.0, 6: 45.0}


def test_majority_prefers_the_centre_then_the_most_frequent(spark):
    a = np.full((9, 9), 7.0)
    a[2:7, 2:7] = 0.0
    a[0, 0], a[8, 8] = 3.0, 0.0
    cells = spark.createDataFrame([(r, c, int(v)) for r, c, v in lattice_of(a)], "row int, col int, code int")
    got = as_array(grids.refill_majority(cells, "code", [0], lambda df: files.written(df)), "code", a.shape)
    assert (got == np.where(a == 0.0, 7.0, a)).all()
    alone = spark.createDataFrame([(0, 0, 0), (0, 9, 5)], "row int, col int, code int")
    assert {r.col: r.code for r in grids.refill_majority(alone, "code", [0], lambda df: files.written(df)).collect()} == {0: 0, 9: 5}


def test_lookups_fail_on_unknown_codes(spark):
    dim = spark.createDataFrame([(910001, 1.0), (920000, 2.0)], "code int, load double")
    cells = lambda *codes: spark.createDataFrame([(0, k, c) for k, c in enumerate(codes)], "row int, col int, code int")
    assert [r.load for r in grids.lookup(cells(910001, 910002, -1), "code", dim, -1, strict=True, base=10000).orderBy("col").collect()] == [1.0, None, None]
    with pytest.raises(ValueError, match="910002"):
        grids.lookup(cells(910001, 910002), "code", dim, strict=True)
    with pytest.raises(ValueError, match="930000"):
        grids.lookup(cells(910002, 930000), "code", dim, strict=True, base=10000)


def test_only_used_cells_must_be_finite(spark):
    c = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0), (None, 0.0), (float("inf"), 1.0)], "a double, b double")
    value = lambda used: rules.guarded("divide", F.col("a"), F.col("b"), used=used, otherwise=F.lit(-1.0))
    assert [r[0] for r in c.select(value((F.col("b") > 0) & (F.col("a") < 9))).collect()] == [2.0, -1.0, -1.0, -1.0]
    for used in (F.col("b") == 0, F.col("b") == 1, None):
        with pytest.raises(Exception, match="not finite"):
            c.select(value(used)).collect()


def test_predictions_must_be_complete(spark):
    sent = spark.range(5).withColumnRenamed("id", "tree_id")
    made = sent.withColumn("height", F.lit(3.0))
    assert tuple(generation.checked_predictions(sent, made, ["tree_id"], "height").first()) == (5, 5, 0, 0)
    for bad in (made.filter("tree_id > 0"), made.unionByName(made.limit(1)), made.withColumn("height", F.when(F.col("tree_id") > 1, 1.0))):
        with pytest.raises(ValueError):
            generation.checked_predictions(sent, bad, ["tree_id"], "height")


def test_numbering_over_partitions(spark):
    own = random.Random(6)
    rows = [(own.choice(["a", "a", "a", "b", None]), own.random()) for _ in range(300)]
    got = files.numbered(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"], "i").collect()
    for g in ("a", "b", None):
        mine = sorted((r.v, r.i) for r in got if r.g == g)
        assert [i for _, i in mine] == list(range(len(mine)))
    ids = files.assign_ids(spark.createDataFrame(rows, "g string, v double"), ["v"])
    assert ids.schema["tree_id"].dataType.simpleString() == "int" and [r.tree_id for r in ids.orderBy("v").collect()] == list(range(300))


def test_equal_shapes_meet_points_once(spark, tmp_path, monkeypatch):
    """Suppliers that repeat the same boxes and lines: points are joined with one of each."""
    from emberplane import registry

    seen, plain = [], spatial.in_boxes
    monkeypatch.setattr(spatial, "in_boxes", lambda p, b, cell: seen.append(b.count()) or plain(p, b, cell))
    rng = random.Random(9)
    trees = [(k, 1, rng.randrange(900), rng.randrange(900), "R", 3.0, 0.05) for k in range(600)]
    spark.createDataFrame(trees, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    results = {}
    for times in (1, 4):
        d = tmp_path / str(times)
        d.mkdir()
        (d / "lineitem.parquet").symlink_to(tmp_path / "lineitem.parquet")
        spark.range(900 * times).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "0.5D AS s_acctbal").write.parquet(str(d / "supplier.parquet"))
        for name in ("geo08_union_of_parts", "geo13_contribution"):
            rows = sorted(tuple(r) for r in registry.queries()[name](spark, str(d)).collect())
            assert rows and results.setdefault(name, rows) == rows
    assert seen == [900] * 4
    lines = spark.createDataFrame([(0.0, 0.0, 30.0, 0.0, 2.0), (0.0, 0.0, 30.0, 0.0, 5.0)] * 50, "x1 double, y1 double, x2 double, y2 double, half double")
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 3.0, 6.0), (3, 29.0, 1.0)], "id int, x double, y double")
    near = spatial.within_capsules(points, lines, 50.0, ["id"])
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in near.collect()) == [1, 3]
    assert plan.count("Join ") == 1 and "Join LeftSemi" in plan and "max(half" in plan


def test_polygon_join_meets_only_near_edges(spark):
    own = random.Random(8)
    rings = {k: [(100 + 90 * math.cos(t + k) * own.uniform(0.3, 1), 100 + 90 * math.sin(t + k) * own.uniform(0.3, 1)) for t in (0, 0.7, 1.4, 2.6, 3.3, 4.5, 5.4)] for k in range(4)}
    edges = spark.createDataFrame([(k, *e) for k, ring in rings.items() for e in spatial.edges_of(ring)], "feature_id int, x1 double, y1 double, x2 double, y2 double")
    points = [(k, own.uniform(0, 200), own.uniform(0, 200)) for k in range(600)]
    got = {(r.id, r.feature_id) for r in spatial.polygon_join(spark.createDataFrame(points, "id int, x double, y double"), edges, 13.0).collect()}

    def inside(x, y, ring):
        return sum(min(b, d) <= y < max(b, d) and x < a + (y - b) * (c - a) / (d - b) for a, b, c, d in spatial.edges_of(ring)) % 2 == 1

    assert got == {(k, f) for k, x, y in points for f, ring in rings.items() if inside(x, y, ring)}


def test_ingest_reports_and_errors(spark):
    raw = spark.createDataFrame([("1", "2.5", "x")], "ID string, DIA string, remark string")
    assert ingest.mapped(raw, {"tree_id": "ID", "dbh": "DIA"}, {"tree_id": "int", "dbh": "double", "height": "double"}, ("height",)).first().asDict() == {"tree_id": 1, "dbh": 2.5, "height": None}
    with pytest.raises(ValueError, match="height"):
        ingest.mapped(raw, {"tree_id": "ID"}, {"tree_id": "int", "height": "double"})
    line = spark.createDataFrame([('{"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{}}',)], "feature string")
    with pytest.raises(Exception, match="no points"):
        ingest.points_of(line, "feature", "a int").collect()
    with pytest.raises(ValueError):
        ingest.feature(raw, ["ID"])
    with pytest.raises(ValueError):
        lattices.stacked(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, slope double"), {"slope": 1, "aspect": 1}, (0, 0), 1, 1)
    assert grids.method_of("a", "categorical") == "nearest" and grids.method_of("a", "continuous", {"a": "mode"}, "cubic") == "mode" and grids.method_of("b", "categorical", {"a": "mode"}, "cubic") == "cubic"


def test_second_deliveries_within_their_delay(spark, tmp_path):
    for k, part in enumerate(([("a", 1, 0), ("b", 0, 0)], [("a", 1, 3), ("c", 9, 30)], [("c", 9, 31), ("d", 2, 32)])):
        rows = [(p, n, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)) for p, n, d in part]
        spark.createDataFrame(rows, "path string, size long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={k}"))
    source = spark.readStream.schema("path string, size long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = dispatches.appended(dispatches.uploads(source, "path", "size", 5, "ts", "7 days")).collect()
    assert sorted(map(tuple, seen)) == [("a", "completed"), ("b", "failed"), ("c", "failed"), ("d", "completed")]


def test_stems_drawn_by_either_uniform(spark):
    cells = spark.range(300).selectExpr("CAST(id AS INT) AS row", "1 AS col", "0L AS plot")
    plots = spark.createDataFrame([(0, 1, 40.0)], "plot long, tree long, tpa double")
    for draw in (generation.uniform, generation.digest_uniform):
        stems = generation.expand_plots(cells, plots, 100.0, seed=3, draw=draw)
        assert abs(stems.count() / 300 - 40) < 4 * math.sqrt(40 / 300)
        assert stems.filter("x < 100 OR x >= 200 OR y < row * 100 OR y >= row * 100 + 100").isEmpty()


def test_draws_of_arrays_are_those_of_columns(spark):
    k = spark.range(1, 21_001).select(F.col("id").cast("int").alias("k"))
    for row, col in ((5, -12), (-(2**31), 2**31 - 1)):
        for draw in (generation.uniform, generation.digest_uniform):
            keys = [F.lit(row), F.lit(col), F.col("k")]
            want = [(r.a, r.b) for r in k.select("k", draw(9, *keys).alias("a"), draw(10, *keys).alias("b")).orderBy("k").collect()]
            for first, end in ((0, 21_000), (0, 7), (95, 1005), (20_999, 21_000)):
                got = generation.DRAWS[draw]([9, 10], row, col, np.arange(first + 1, end + 1))
                assert got.T.tolist() == [list(w) for w in want[first:end]]
    long = draws.digests([10**40], 5, 6, np.array([1, 20]))  # more than a block of 64 bytes
    assert long.shape == (1, 2) and 0 <= long.min() < long.max() < 1


def test_stems_are_grown_where_their_trees_are(spark, monkeypatch):
    cells = spark.range(40).selectExpr("CAST(id AS INT) AS row", "CAST(id % 3 AS INT) AS col", "id % 3 AS plot")
    rng = random.Random(5)
    rows = [(p, f"t{k:02d}", rng.choice([0.0, 1.0, 7.5, None])) for p in (0, 1, 7) for k in range(p + 30)]
    plots = spark.createDataFrame([*rows, (None, "t00", 1.0)], "plot long, tree string, tpa double")
    whole = generation.expand_plots(cells, plots, 100.0, seed=3)
    # Stems come out of the tasks that hold the trees, no shuffle or join follows.
    assert "MapInArrow" in whole._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    stems = sorted(map(tuple, whole.collect()))
    weights = {(p, t): w or 0.0 for p, t, w in rows}
    assert {s[3] for s in stems} == {0, 1} and all(weights[s[3], s[4]] > 0 for s in stems)
    digests = {"row": "int", "col": "int", "stem": "int", "plot": "bigint", "tree": "string", "x": "double", "y": "double"}
    assert dict(whole.dtypes) == digests
    # The same by columns, tree by tree, in the order of trees.
    total, upto = {}, {}
    for p, t, w in rows:
        upto[p, t] = total[p] = total.get(p, 0.0) + (w or 0.0)
    keys = [F.col("row"), F.col("col"), F.col("stem")]
    for r in whole.select("plot", "tree", "x", "y", "row", "col", generation.uniform(4, *keys).alias("at"), generation.uniform(5, *keys).alias("u"), generation.uniform(6, *keys).alias("v")).collect():
        assert upto[r.plot, r.tree] - weights[r.plot, r.tree] <= r.at * total[r.plot] < upto[r.plot, r.tree]
        assert (r.x, r.y) == ((r.col + r.u) * 100.0, (r.row + r.v) * 100.0)
    # Plots of more trees than a task holds, and stems in many batches.
    monkeypatch.setattr(generation, "TREES", 7)
    monkeypatch.setattr(generation, "STEMS", 5)
    assert sorted(map(tuple, generation.expand_plots(cells, plots, 100.0, seed=3).collect())) == stems


def test_domains_within_a_notched_boundary(spark):
    notch = [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (50.0, 20.0), (0.0, 100.0)]]
    rings = {
        "inside": [(10, 5), (20, 5), (20, 15)], "over the notch": [(5, 60), (95, 60), (95, 62), (5, 62)], "out": [(90, 5), (120, 5), (120, 15)], "on the edge": [(0, 0), (9, 0), (9, 9)],
        "line": [(10, 5), (20, 5)], "point": [(10, 5)], "none": [], "large": [(2, 1), (98, 1), (98, 15), (2, 15)],
    }
    rows = [(n, "EPSG:32611", [(float(x), float(y)) for x, y in r]) for n, r in rings.items()] + [("null", "EPSG:32611", None), ("code", "utm", [(10.0, 5.0), (20.0, 5.0), (20.0, 15.0)]), ("no code", None, None)]
    d = spark.createDataFrame(rows, "id string, crs string, ring array<struct<x:double,y:double>>")
    got = {r.id: r.fault for r in d.select("id", spatial.domain_fault(notch, 1000.0).alias("fault")).collect()}
    assert got == {"inside": None, "over the notch": "boundary", "out": "boundary", "on the edge": "boundary", "line": "area", "point": "area", "none": "area", "large": "too_large", "null": "area", "code": "crs", "no code": "crs"}


def test_role_contract_takes_nulls_for_faults(spark):
    contract = {"a": ("m", 2), "b": (None, 3)}
    rows = [("a", "x", {"x": "m"}, 2, None), ("a", "x", {"x": None}, 2, None), ("a", "y", {"x": "m"}, 2, None), ("a", None, {"x": "m"}, 2, None), ("a", "x", None, 2, None), (None, "x", {"x": "m"}, 2, None), ("b", "x", {"x": None}, 3, 8), ("b", "x", {"x": None}, 3, None), ("b", "x", {"x": None}, None, 8)]
    g = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, role string, band string, bands map<string,string>, dims int, nz int").withColumns({c: F.lit(1.0) for c in ("z_cell", "z0", "t_z_cell", "t_z0")} | {"t_nz": F.lit(8)})
    got = [r.fault for r in g.select("id", lattices.contract_fault(contract).alias("fault")).orderBy("id").collect()]
    assert got == [None, "unit", "band", "band", "band", "role", None, "vertical", "dimensions"]


def test_region_areas(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 300.0, 0.0, 301.0, 1.0), (3, 50.0, 0.0, 150.0, 100.0)], "id int, minx double, miny double, maxx double, maxy double")
    square = lambda a, c: [[(a, a), (c, a), (c, c), (a, c)]]
    got = {r.id: (round(r.area_ha, 6), r.too_large) for r in lattices.region_areas(b, [("within", square(-1.0, 101.0)), ("outside", square(20.0, 60.0))], 1.0, 0.5).collect()}
    assert got == {1: (1 - 0.16, True), 2: (0.0, False), 3: (0.47, False)}  # the third: 51 columns of 100, less 10 of 40
    # Centres on a polygon's edge are not within it: 39 x 39 of them are within this one.
    edge = lattices.region_areas(b.filter("id = 1"), [("outside", square(20.5, 60.5))], 1.0).first()
    assert round(edge.area_ha, 6) == 1 - 0.1521
    with pytest.raises(ValueError):
        lattices.region_areas(b, [("near", [])], 1.0)


def box_cells(boxes, side=10, step=10.0):
    """Cells of a square region whose centres lie in boxes(name -> x0, y0, x1, y1)."""
    mid = lambda k: (k + 0.5) * step
    return [(r * 1000 + c, n) for n, (x0, y0, x1, y1) in boxes.items() for r in range(side) for c in range(side) if x0 <= mid(c) <= x1 and y0 <= mid(r) <= y1]


def chosen_datasets(spark, boxes, density, pins=None, side=10, **kw):
    held = spark.createDataFrame(box_cells(boxes, side) + [(999_999, n) for n in boxes], "cell long, name string")
    region = spark.createDataFrame([(r * 1000 + c,) for r in range(side) for c in range(side)], "cell long")
    names = spark.createDataFrame(list(density.items()), "name string, density double")
    return [(r.name, r.cells, r.expected_points) for r in coverage.select_datasets(region, held, names, 100.0, pins, **kw).orderBy("place").collect()]


def test_one_nearly_complete_dataset_is_enough(spark):
    halves = {"west": (0, 0, 50, 100), "east": (50, 0, 100, 100)}
    whole = {"all": (0, 0, 100, 99), "most": (0, 0, 100, 85)}
    density = {"west": 9.0, "east": 9.0, "all": 1.0, "most": 20.0}
    assert chosen_datasets(spark, halves | whole, density) == [("all", 100, 10000)]
    # Of several complete ones the densest, then the greater name; 90 of 100 cells are too few.
    assert [n for n, *_ in chosen_datasets(spark, {"a": (0, 0, 100, 100), "c": (0, 0, 100, 100), "b": (0, 0, 100, 100), "most": (0, 0, 100, 90)}, {"a": 2.0, "b": 2.0, "c": 1.0, "most": 9.0})] == ["b"]


def test_greedy_by_what_is_added(spark):
    boxes = {"big": (0, 0, 70, 100), "second": (0, 0, 64, 100), "filler": (60, 0, 100, 100)}
    assert chosen_datasets(spark, boxes, {"big": 1.0, "second": 5.0, "filler": 2.0}) == [("big", 70, 7000), ("filler", 30, 6000)]
    assert chosen_datasets(spark, {}, {"x": 1.0}) == []


def test_pins_keep_their_order(spark):
    boxes = {"dense": (0, 0, 70, 100), "thin": (30, 0, 100, 100), "last": (0, 0, 100, 100), "far": (900, 900, 950, 950)}
    density = {"dense": 9.0, "thin": 1.0, "last": 1.0, "far": 1.0, "nowhere": 1.0}
    assert chosen_datasets(spark, boxes, density, ["thin", "dense"]) == [("thin", 70, 7000), ("dense", 30, 27000)]
    assert chosen_datasets(spark, boxes, density, ["thin", "dense", "last"]) == [("thin", 70, 7000), ("dense", 30, 27000)]  # nothing is left for the last
    # A pin that adds too little is left out, and its cells stay for those after it.
    assert chosen_datasets(spark, boxes | {"sliver": (0, 0, 10, 20)}, density | {"sliver": 1.0}, ["thin", "sliver", "dense"], enough=0.05) == [("thin", 70, 7000), ("dense", 30, 27000)]
    with pytest.raises(coverage.UnknownDataset, match="other"):
        chosen_datasets(spark, boxes, density, ["thin", "other"])
    for name in ("far", "nowhere"):
        with pytest.raises(coverage.OutsideRegion, match=name):
            chosen_datasets(spark, boxes, density, ["thin", name])


def cloud_points(spark, rows):
    return pointcloud.tiled(spark.createDataFrame(rows, "id int, X int, Y int, Z int"), 10.0)


def test_appended_uploads_are_levelled_as_one(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.randrange(-1500, 1500), rng.randrange(0, 1200), k) for k in range(400)]
    root, once = f"file://{tmp_path}/cloud", f"file://{tmp_path}/once"
    for k, (a, b) in enumerate(((0, 150), (150, 151), (151, 400))):
        pointcloud.append_upload(cloud_points(spark, rows[a:b]), root, k, ("id",))
    pointcloud.append_upload(cloud_points(spark, rows), once, 0, ("id",))
    read = lambda p: {r.id: (r.tile_x, r.tile_y, r.lod) for r in spark.read.parquet(f"{p}/points").collect()}
    assert read(root) == read(once) and len(read(root)) == 400
    per_tile = {}
    for k, (x, y, lod) in sorted(read(root).items()):
        i = per_tile[x, y] = per_tile.get((x, y), -1) + 1
        assert lod == min((j for j in range(5) if i % 4 ** (5 - j) == 0), default=5)
    # The last upload can be run again, one before it can't.
    pointcloud.append_upload(cloud_points(spark, rows[151:400]), root, 2, ("id",))
    assert read(root) == read(once)
    with pytest.raises(ValueError, match="successors"):
        pointcloud.append_upload(cloud_points(spark, rows[150:151]), root, 1, ("id",))


def test_catalogue_against_manifest(spark, tmp_path):
    root = f"file://{tmp_path}/cloud"
    pointcloud.append_upload(cloud_points(spark, [(k, k * 37 % 3000, k * 11 % 900, 0) for k in range(90)]), root, 0, ("id",))
    got = pointcloud.checked_catalogue(spark, root)
    assert got.agg(F.sum("n")).first()[0] == 90 and got.groupBy("tile_x", "tile_y").agg(F.max("upto").alias("m")).agg(F.sum("m")).first()[0] == 90
    with files.footer_statistics(spark):
        plan = spark.read.parquet(f"{root}/points").groupBy(*pointcloud.PARTITIONS).agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    spark.createDataFrame([(3, 91)], "tiles long, points long").write.mode("overwrite").parquet(f"{root}/manifest")
    with pytest.raises(pointcloud.BrokenCloud, match="the files have"):
        pointcloud.checked_catalogue(spark, root)
    cloud_points(spark, [(1, 1, 1, 1)]).withColumn("lod", F.lit(6)).write.mode("append").partitionBy("tile_x", "tile_y", "lod").parquet(f"{root}/points/upload=0")
    with pytest.raises(pointcloud.BrokenCloud, match="level 6"):
        pointcloud.checked_catalogue(spark, root)
    pointcloud.write_points(pointcloud.with_lod(cloud_points(spark, [(1, 1, 1, 1)]), ("id",)), f"file://{tmp_path}/bare/points")
    with pytest.raises(pointcloud.BrokenCloud, match="no manifest"):
        pointcloud.checked_catalogue(spark, f"file://{tmp_path}/bare")


def test_count_of_rows(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    assert files.count_rows(spark, path) is None
    spark.range(1234).write.parquet(path)
    assert files.count_rows(spark, path) == 1234
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_finished_tiles(spark, tmp_path):
    """Arrivals out of order, twice, without points and over a restart; tiles come once, when nothing before their last is missing."""
    rng = random.Random(3)
    arrivals = [(c, i, None if i % 5 == 0 else 10) for c in range(4) for i in range(60) if (c, i) not in ((1, 30), (2, 0))]
    rng.shuffle(arrivals)
    arrivals += arrivals[:40]
    schedule = spark.createDataFrame([(c, t, rng.randrange(60)) for c in range(5) for t in range(20)], "cloud long, tile long, last int")
    cut = [arrivals[k::6] for k in range(6)]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("cloud long, idx long, points int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    for some in (cut[:3], cut[3:]):  # the second query goes on from the checkpoint of the first
        for part in some:
            spark.createDataFrame(part, "cloud long, idx long, points int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = dispatches.finished_tiles(source, schedule).writeStream.foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect()))
        run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    upto = {0: 60, 1: 30, 2: 0, 3: 60}
    want = sorted((r.cloud, r.tile) for r in schedule.collect() if r.last < upto.get(r.cloud, 0))
    assert sorted(out) == want and len(want) > 30


def rings_of(spark, rings):
    rows = [(i, [(float(x), float(y)) for x, y in r]) for i, own in rings.items() for r in own]
    return spark.createDataFrame(rows, "id int, ring array<struct<x: double, y: double>>")


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_exact_areas(spark):
    """Hand-made polygons, far from the origin: a hole, a bay, several conditions that cross, on strips of several heights."""
    ox, oy = 500_000.0, 5_200_000.0
    move = lambda ring: [(x + ox, y + oy) for x, y in ring]
    square, bay = [(0, 0), (100, 0), (100, 100), (0, 100)], [(0, 0), (100, 0), (50, 40), (100, 100), (0, 100)]
    domains = {1: [move(square)], 2: [move(square), move([(20, 20), (20, 60), (60, 60)])], 3: [move(bay)], 4: [move([(300, 300), (310, 300), (305, 309)])], 5: [move([(0, 0), (50, 0)])]}
    edges = polygons.edges_of_rings(rings_of(spark, domains))
    area = lambda conditions, strip: {r.id: r.area_ha * 1e4 for r in polygons.exact_areas(edges, conditions, strip).collect()}
    half, slanted = move([(-10, -10), (200, -10), (200, 200)]), move([(-50, 30), (150, 70), (150, 500), (-50, 500)])
    for strip in (7.0, 33.3, 1000.0):
        assert area([], strip) == pytest.approx({1: 10_000, 2: 10_000 - 800, 3: 7_500, 4: 45, 5: 0}, abs=1e-6)
        # Below the diagonal half of the square; the hole lies above it but for its edge on it.
        below = {1: 5_000, 2: 5_000, 3: 4_500 / 2, 4: 0, 5: 0}
        got = area([("within", [half])], strip)
        assert got == pytest.approx(got | {1: below[1], 2: below[2], 5: 0}, abs=1e-6)
        # Below the line from (0, 40) to (100, 60) lies half of the square.
        out = area([("outside", [slanted])], strip)
        assert out[1] == pytest.approx(5_000, abs=1e-6)
        # A triangle of the diagonal and that line: they meet at x = y = 50.
        both = area([("intersects", [half]), ("outside", [slanted])], strip)
        assert both[1] == pytest.approx(100 * 40 + 100 * 20 / 2 - shoelace([(0, 0), (0, 40), (50, 50)]), abs=1e-6)
    assert [r.too_large for r in polygons.exact_areas(edges, [], 50.0, 0.8).orderBy("id").collect()] == [True, True, False, False, False]
    with pytest.raises(ValueError, match="touches"):
        polygons.exact_areas(edges, [("touches", [half])], 50.0)


def test_areas_against_convex_clipping(spark):
    rng = random.Random(12)
    tri = lambda: [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(3)]

    def clip(ring, by):
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(by, by[1:] + by[:1], strict=True)) < 0:
            by = by[::-1]
        for a, b in zip(by, by[1:] + by[:1], strict=True):
            side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            out = []
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                if (side(p) >= 0) != (side(q) >= 0):
                    t = side(p) / (side(p) - side(q))
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                if side(q) >= 0:
                    out.append(q)
            ring = out
            if not ring:
                return ring
        return ring

    for _ in range(3):
        rings, by = {k: [tri()] for k in range(12)}, tri()
        edges = polygons.edges_of_rings(rings_of(spark, rings))
        within = {r.id: r.area_ha * 1e4 for r in polygons.exact_areas(edges, [("within", [by])], 11.0).collect()}
        without = {r.id: r.area_ha * 1e4 for r in polygons.exact_areas(edges, [("outside", [by])], 11.0).collect()}
        for k, (ring,) in rings.items():
            common = shoelace(clip(ring, by)) if clip(ring, by) else 0.0
            assert within[k] == pytest.approx(common, abs=1e-6) and without[k] == pytest.approx(shoelace(ring) - common, abs=1e-6)


def test_clipped_rings(spark):
    rings = {1: [[(-5, 5), (5, -5), (15, 5), (5, 15)]], 2: [[(2, 2), (4, 2), (3, 5)]], 3: [[(20, 20), (30, 20), (30, 30)]], 4: [[(-10, -10), (40, -10), (40, 40), (-10, 40)]], 5: [[(1, 1), (20, 1), (20, 3), (5, 5), (20, 7), (20, 9), (1, 9)]]}
    out = polygons.clip_rings(rings_of(spark, rings), (0.0, 0.0, 10.0, 10.0))
    got = {r.id: shoelace([(p.x, p.y) for p in r.ring]) for r in out.collect()}
    bay = 5 * (17 / 3 - 13 / 3) / 2  # of the fifth, between (10, 13/3), (5, 5) and (10, 17/3)
    assert got == pytest.approx({1: 100.0, 2: 3.0, 4: 100.0, 5: 9 * 8 - bay}, abs=1e-9)
    assert all(0 <= p.x <= 10 and 0 <= p.y <= 10 for r in out.collect() for p in r.ring)


def test_filled_cells(spark):
    """Scanlines against a test of each centre: random polygons with many corners, a hole, and bands of layers."""
    rng = random.Random(6)
    rings = {}
    for k in range(8):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))
        rings[k] = [[(50 + rng.uniform(15, 45) * math.cos(t), 50 + rng.uniform(15, 45) * math.sin(t)) for t in turns]]
    rings[0].append([(47.0, 46.0), (55.0, 47.0), (50.0, 55.0)])
    edges = polygons.edges_of_rings(rings_of(spark, rings))
    got = {(r.id, r.row, r.col) for r in polygons.filled_cells(edges, 3.0).collect()}

    def holds(rings, x, y):
        hits = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                hits += min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return hits % 2 == 1

    assert got == {(k, r, c) for k, own in rings.items() for r in range(40) for c in range(40) if holds(own, c * 3 + 1.5, r * 3 + 1.5)}
    layers = spark.createDataFrame([(k, "ab"[k % 2], float(k), 50.0, k + 1.0, 100.0, 7.0, 18000.0) for k in range(8)], "id int, fuel_type string, fuel_loading double, percent_cover double, fuel_height double, live_fuel_moisture double, dead_fuel_moisture double, heat_of_combustion double")
    top = polygons.layer_bands(layers, edges, 3.0, "max").filter("row = 16 AND col = 12 AND fuel_type = 'b'").first()
    over = [k for k in range(1, 8, 2) if (k, 16, 12) in got]
    assert top.loading == max(over) / 2 and top.height == max(over) + 1 and top.heat_of_combustion == 18000
    with pytest.raises(ValueError, match="median"):
        polygons.layer_bands(layers, edges, 3.0, "median")


def test_layers_by_index(spark, tmp_path):
    rows = [(k, k % 7, float(k), float(k), k + 0.5, k + 0.5, f"n{k}") for k in range(70)] + [(3, 6, 3.0, 3.0, 3.5, 3.5, "again")]
    table = spark.createDataFrame(rows, "fid int, area int, minx double, miny double, maxx double, maxy double, name string")
    root = f"file://{tmp_path}"
    layers.write_layers(table.filter("area <> 5"), root, "road")  # an area of the index without a layer
    index = spark.createDataFrame([(a, float(a), float(a), a + 20.0, a + 20.0) for a in range(7)], "area int, minx double, miny double, maxx double, maxy double")
    found = layers.read_layers(spark, root, "road", index, (2.0, 2.0, 5.2, 5.2), "fid", "area")
    assert sorted((r.fid, r.area, r.name) for r in found.collect()) == [(2, 2, "n2"), (3, 3, "n3"), (4, 4, "n4")]
    far = layers.read_layers(spark, root, "road", index, (0.0, 0.0, 0.9, 0.9), "fid", "area")
    assert "dynamicpruning" in far._jdf.queryExecution().executedPlan().toString() and far.count() == 1
    assert layers.read_layers(spark, root, "water", index, (0.0, 0.0, 9.0, 9.0), "fid", "area").count() == 0
    with pytest.raises(ValueError, match="rail"):
        layers.read_layers(spark, root, "rail", index, (0.0, 0.0, 9.0, 9.0), "fid", "area")
    # A broken layer is an error where it is met, and not opened where it is not.
    for f in (tmp_path / "road" / "area=0").glob("part-*"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "road" / "area=0").glob(".part-*"):
        f.unlink()
    assert layers.read_layers(spark, root, "road", index, (25.0, 25.0, 26.0, 26.0), "fid", "area", table.schema).count() == 0
    with pytest.raises(Exception, match="area=0"):
        layers.read_layers(spark, root, "road", index, (0.0, 0.0, 0.9, 0.9), "fid", "area", table.schema).collect()


def test_checked_quadratic(spark):
    rng = random.Random(2)
    rows = [(k, t, -13_024_400 + t * 50_000 + rng.uniform(0, w), 5_942_000 + rng.uniform(0, w)) for t, w in ((0, 500.0), (1, 3_000.0), (2, 400_000.0), (3, 0.0)) for k in range(50)]
    points = spark.createDataFrame(rows, "k int, t int, x double, y double")
    exact = lambda x, y: spatial.utm(*spatial.from_mercator(x, y), 11)
    out = reprojection.reprojected(points, F.col("t"), exact)
    ex, ey = exact(F.col("x"), F.col("y"))
    got = out.groupBy("t").agg(F.bool_and("approximated").alias("a"), F.bool_or("approximated").alias("b"), F.max(F.hypot(F.col("px") - ex, F.col("py") - ey)).alias("miss")).collect()
    assert {r.t: (r.a, r.b) for r in got} == {0: (True, True), 1: (True, True), 2: (False, False), 3: (False, False)}
    assert all(r.miss <= 1e-4 for r in got) and max(r.miss for r in got if r.t < 2) > 0


def test_composed_grids(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "row int, col int, v double")
    base = grids.Lattice(0.0, 100.0, 10.0, 10, 10)
    good = compose.Grid(cells, base, "EPSG:1")
    near = compose.Grid(cells.filter("row = 1"), grids.Lattice(5e-10, 100.0, 10.0, 10, 10), "EPSG:1")
    assert sorted(tuple(r) for r in compose.aligned({"a": good, "b": near}).collect()) == [(0, 0, 1.0, None), (1, 1, 2.0, 2.0)]
    for bad, why in ((compose.Grid(cells, base, "EPSG:2"), "another reference"), (compose.Grid(cells, base, None), "no reference"), (compose.Grid(cells, grids.Lattice(0.0, 100.0, 10.0, 10, 9), "EPSG:1"), "shape"),
                     (compose.Grid(cells, grids.Lattice(1e-8, 100.0, 10.0, 10, 10), "EPSG:1"), "place"), (compose.Grid(cells.drop("v"), base, "EPSG:1"), "no bands"), (compose.Grid(cells.withColumn("k", F.lit(1)), base, "EPSG:1"), "two dimensions")):
        with pytest.raises(compose.Misaligned, match=why):
            compose.aligned({"a": good, "b": bad})
    assert [tuple(r) for r in compose.cropped(good, grids.Lattice(10.0, 90.0, 10.0, 2, 2)).collect()] == [(0, 0, 2.0)]
    for target, why in ((grids.Lattice(-10.0, 100.0, 10.0, 2, 2), "covered"), (grids.Lattice(90.0, 100.0, 10.0, 2, 2), "covered"), (grids.Lattice(5.0, 100.0, 10.0, 2, 2), "whole cells"), (grids.Lattice(0.0, 100.0, 5.0, 2, 2), "cells of")):
        with pytest.raises(compose.Misaligned, match=why):
            compose.cropped(good, target)
    with pytest.raises(ValueError, match=r"no band 'w': there are \['v'\]"):
        compose.chosen_bands(cells, ["w"])


def test_fire_stack(spark):
    canopy = spark.createDataFrame([(0, 0, 0, 0.2, 100.0, 1000.0), (1, 0, 0, 0.4, 90.0, 0.0), (0, 0, 1, 0.0, 80.0, None)], "k int, j int, i int, density double, moisture double, savr double")
    surface = spark.createDataFrame([(0, 0, 0.6, 0.3, 10.0, 2000.0), (0, 2, 0.0, 0.1, float("nan"), 5.0)], "j int, i int, load double, depth double, moisture double, savr double")
    rows = {how: {(r.k, r.i): (r.rho, r.moisture, r.depth, r["size"]) for r in compose.fire_stack(canopy, surface, 1.0, how).collect()} for how in ("max", "mean")}
    assert rows["max"][0, 0] == pytest.approx((0.8, 1.0, 0.3, 2 / 1750)) and rows["mean"][0, 0] == pytest.approx((0.8, 0.325, 0.3, 2 / 1750))
    assert rows["max"][1, 0] == (0.4, 0.9, 0.0, 0.0) and rows["max"][0, 1] == (0.0, 0.8, 0.0, 0.0) and rows["mean"][0, 1] == (0.0, 0.0, 0.0, 0.0) and rows["max"][0, 2] == (0.0, 0.0, 0.1, 0.0)
    assert "size" not in compose.fire_stack(canopy.drop("savr"), surface, 1.0).columns
    with pytest.raises(ValueError, match="sum"):
        compose.fire_stack(canopy, surface, 1.0, "sum")


def test_uploaded_lattices(spark):
    square = spark.createDataFrame([(x + 5.0, y + 5.0, 1, 2) for x in (0, 10, 40) for y in (0, 10, 20)], "x double, y double, a int, b int")
    box = (20.0, 20.0, 90.0, 90.0)
    assert compose.upload_lattice(square, ["p", "q"], "E:1", "E:1", box) == grids.Lattice(0.0, 30.0, 10.0, 3, 5)
    for table, names, crs, to, why in ((square, ["p"], "E:1", "E:1", "2 bands for 1"), (square, ["p", "q"], "E:2", "E:1", "the upload is in"), (square.withColumn("y", F.col("y") * 2), ["p", "q"], "E:1", "E:1", "not square"), (square.filter("x = 5"), ["p", "q"], "E:1", "E:1", "not square"), (square.withColumn("x", F.col("x") + 500), ["p", "q"], "E:1", "E:1", "meet")):
        with pytest.raises(ValueError, match=why):
            compose.upload_lattice(table, names, crs, to, box)


def test_tree_tables(spark, tmp_path):
    full = spark.createDataFrame([(1.0, 2.0, 122, 3.0, 4.0, 0.5, s, 9) for s in (1, 2, None)], "x double, y double, fia_species_code int, dbh double, height double, crown_ratio double, fia_status_code int, extra int")
    for name, table in (("full", full), ("bare", full.drop("fia_status_code")), ("poor", full.drop("dbh", "crown_ratio"))):
        table.write.parquet(f"{tmp_path}/{name}")
    live = ingest.read_trees(spark, f"{tmp_path}/full", ("extra",))
    assert live.count() == 1 and "EqualTo(fia_status_code,1)" in live._jdf.queryExecution().executedPlan().toString() and ingest.read_trees(spark, f"{tmp_path}/full", live_only=False).count() == 3
    assert [r.fia_status_code for r in ingest.read_trees(spark, f"{tmp_path}/bare").collect()] == [1, 1, 1]
    with pytest.raises(ingest.MissingMorphology, match="dbh.*crown_ratio"):
        ingest.read_trees(spark, f"{tmp_path}/poor")
    with pytest.raises(ingest.TreesNotFound):
        ingest.read_trees(spark, f"{tmp_path}/none")


def test_quotas_by_kind_and_week(spark):
    use = spark.createDataFrame([(1, "p", "g", 5, 2, 10), (2, "p", "g", 5, 1, 10), (3, "p", "g", 4, 1, 99), (4, "p", "g", 4, 1, 10), (5, "p", "x", 9, 9, 9), (6, "p", "g", 1, 0, 0)], "owner int, tier string, kind string, n int, active int, bytes long")
    limits = spark.createDataFrame([("p", "g", 2, 5, 99, 3)], "tier string, kind string, active_limit int, count_limit int, storage_limit int, weekly_limit int")
    weekly = spark.createDataFrame([(4, "g", 3), (1, "g", 9), (6, "g", 2)], "owner int, kind string, used long")
    got = {r.owner: (r.violated, r.current, r.most, r.retry) for r in catalogue.quota_verdicts(use, limits, weekly).collect()}
    none = (None, None, None, None)
    assert got == {1: ("active", 2, 2, True), 2: ("count", 5, 5, False), 3: ("storage", 99, 99, False), 4: ("weekly", 3, 3, False), 5: none, 6: none}


def test_stale_tests_and_reports(spark):
    day = lambda n: datetime.datetime(2020, 1, 10) - datetime.timedelta(days=n)
    rows = spark.createDataFrame([("test-a", None, day(3), 1), ("b", "test-o", day(3), 2), ("static-test-c", "test-o", day(9), 4), ("test-d", "o", day(1), 8), ("test-e", "o", None, 16), ("f", "o", day(9), 32), ("g", None, day(9), None)], "id string, owner string, modified_on timestamp, size_bytes long")
    stale = catalogue.stale_tests(rows, F.lit("2020-01-10 00:00:00").cast("timestamp"))
    assert sorted(r.id for r in stale.collect()) == ["b", "test-a"]
    report = catalogue.reconciliation(rows, {"orphan": rows.filter("id IN ('b', 'g')"), "test": stale, "blob": rows.limit(0)}, {"orphan": False})
    assert sorted(tuple(r) for r in report.collect()) == [("blob", True, 0, 0, 0, 0), ("orphan", False, 2, 2, 2, 2), ("test", True, 1, 0, 1, 0)]
    page = catalogue.counted_page(catalogue.listing(rows, {"owner": "o"}), "size_bytes", 0, 2)
    assert [(r.id, r.total) for r in page.orderBy(F.desc("size_bytes")).collect()] == [("f", 3), ("test-e", 3)]


def test_tiled_stamps_merge_as_plain_ones_and_are_never_shuffled(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([9.0, 9.2, 30.5, 41.3]), rng.uniform(-6, 140), rng.uniform(-6, 140), 0.6, 10.0 + k % 40, 122) for k in range(1500)]  # crowns over edges of tiles and of the grid
    t = spark.createDataFrame(rows, "tree_id long, height double, x double, y double, crown_ratio double, dbh double, fia_species_code int")
    shapes = voxels.files.written(voxels.crown_templates(t.select(*voxels.class_keys()[2:]).distinct(), 1.0, 1.0))
    plain, tiled = (voxels.stamp(t, shapes, 1.0, 1.0, 0.0, 130.0, 130, 130, F.col("dbh"), tiled=k) for k in (False, True))
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(tiled.select(plain.columns)) == read(plain)
    for f in (voxels.merged, lambda s: voxels.collapse_stamps(s, 1.0)):
        assert read(f(tiled)) == read(f(plain))
        plan = f(tiled)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("REPARTITION_BY_NUM")]
        assert above.count("HashAggregate(keys=[tile") >= 2 and above.count("Exchange hashpartitioning") == 1  # that of the trees


def test_densities_add_up_alike_in_any_order(spark):
    rng = random.Random(1)
    rows = [(0, 0, 0, k, float(k % 7), rng.randrange(10**9)) for k in range(4000)]
    sums = set()
    for parts in (1, 3, 17):
        rng.shuffle(rows)
        s = spark.createDataFrame(rows, "k int, j int, i int, tree_id int, height double, grains long").repartition(parts)
        sums |= {voxels.merged(s).first().density, voxels.collapse_stamps(s, 1.0).first().load}
    assert sums == {sum(r[5] for r in rows) / 1e9}


def test_realizations_of_a_class_differ(spark):
    """Each realization keeps the stem and its own draw of the other voxels, alike however the tables are dealt."""
    classes = spark.createDataFrame([(122, 3, 30, 5, 6), (202, 3, 30, 5, 1)], "species int, dbh_bin int, height_bin int, ratio_bin int, realizations int")
    shapes = voxels.crown_templates(classes.drop("realizations"), 1.0, 1.0)
    read = lambda df: {tuple(r)[:-1] for r in df.collect()}
    made = voxels.realized_templates(shapes, classes, 5, voxels.occupancy(1.0))
    own = {}
    for s, *_, n, k, j, i in read(made):
        own.setdefault((s, n), set()).add((k, j, i))
    whole = {(r.dk, r.dj, r.di) for r in shapes.filter("species = 122").collect()}
    assert set(own) == {(122, n) for n in range(6)} | {(202, 0)} and len(set(map(frozenset, own.values()))) == 7
    for v in own.values():
        assert v < whole and {x for x in whole if x[1:] == (0, 0)} <= v and 0.6 < len(v) / len(whole) < 0.9
    assert read(made) == read(voxels.realized_templates(shapes.repartition(7), classes, 5, voxels.occupancy(1.0)))
    assert read(made) != read(voxels.realized_templates(shapes, classes, 6, voxels.occupancy(1.0)))
    trees = spark.createDataFrame([(1, 20.0, 5.0, 5.0, 9.0, 0.5, 122, 2)], "tree_id int, height double, x double, y double, dbh double, crown_ratio double, fia_species_code int, realization int")
    one = trees.withColumns({"dbh": F.lit(9.0), "height": F.lit(30.2), "fia_species_code": F.lit(122)})
    stamps = voxels.stamp(one, made, 1.0, 1.0, 0.0, 10.0, 10, 10, F.lit(7.0))
    assert stamps.count() == len({x for x in own[122, 2] if abs(x[1]) <= 4 and abs(x[2]) <= 4} | {x for x in own[122, 2] if 0 <= 5 + x[1] < 10 and 0 <= 5 + x[2] < 10})


@pytest.mark.parametrize("order", ["C", "F"])
def test_dense_chunks(spark, order):
    rng = random.Random(3)
    known = {(rng.randrange(11), rng.randrange(7)): rng.random() for _ in range(40)}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in known.items()] + [(0, 6, None)], "row int, col int, v double")
    full = np.full((11, 7), -1.0)
    for (r, c), v in known.items():
        full[r, c] = v
    got = {(x.chunk_row, x.chunk_col): x.data for x in lattices.chunk_dense(cells.filter("NOT (row = 0 AND col = 6 AND v IS NULL)"), "v", 4, 11, 7, -1.0, order).collect()}
    assert got == {(a, b): full[a * 4 : a * 4 + 4, b * 4 : b * 4 + 4].ravel(order).tolist() for a in range(3) for b in range(2)}


def dense_chunks_equal_the_sql(spark, path, name):
    import duckdb

    from emberplane import registry

    d = stems_on_edges(spark, path, [(0, 1, 0, 0), (1, 1, 0, 0), (7692, 1, 0, 0)])  # the first lies on the southern edge, in row 100
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet/*.parquet'")
    got = {tuple(r) for r in registry.queries()[name](spark, d).collect()}
    want = set(con.execute(f"select chunk_row, chunk_col, data from ({registry.oracle_sql()[name]})").fetchall())
    assert got == want and len(got) == 16
    cells = spark.createDataFrame([(r, c, 1.0) for r, c in ((-1, 0), (0, -1), (3, 0), (0, 2), (2, 1))], "row int, col int, v double")
    rest = lattices.chunk_dense(cells, "v", 2, 3, 2, 0.0, name[-1].upper()).collect()
    assert {(r.chunk_row, r.chunk_col): r.data for r in rest} == {(0, 0): [0.0] * 4, (1, 0): [0.0, 1.0]}


def test_dense_chunks_in_c_order_leave_out_the_southern_edge(spark, tmp_path):
    dense_chunks_equal_the_sql(spark, tmp_path, "src25_chunk_dense_c")


def test_dense_chunks_in_f_order_leave_out_the_southern_edge(spark, tmp_path):
    dense_chunks_equal_the_sql(spark, tmp_path, "src25_chunk_dense_f")


def test_uploads_on_the_border_of_two_steps_equal_the_sql(spark, tmp_path):
    import duckdb

    from emberplane import registry

    # Places, in cm of the square, whose northing is a whole number of half steps but for its last bit, which Java and C
    # give differently.
    places = [(20079, 1914), (68627, 86829), (71563, 6677), (30574, 63017), (17623, 73085), (18171, 67807), (30227, 23529), (55497, 80017), (45477, 85954), (34995, 11043)]
    orders = [x * pow(7919, -1, 100_000) % 100_000 for x, _ in places]
    d = stems_on_edges(spark, tmp_path, [(o, 0, 0, (y - 13 * o) * pow(17, -1, 100_000) % 100_000) for o, (_, y) in zip(orders, places, strict=True)])
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet/*.parquet'")
    got = registry.queries()["src16_appended_uploads"](spark, d)
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()['src16_appended_uploads']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 10
    # Nulls stay, and the pole, where C has no hyperbolic arc, keeps the column's value.
    odd = spark.createDataFrame([(0, None, 47.0, 1.0), (1, -117.0, None, 1.0), (2, -117.0, 90.0, None)], "id int, lon double, lat double, z double")
    pole = math.floor(spatial.UTM_SCALE * spatial._RADIUS * math.pi / 2 / 0.01 + 0.5)
    assert [tuple(r) for r in ingest.projected_points(odd, 11, 0.01, "m").orderBy("id").collect()] == [(0, None, None, 100), (1, None, None, 100), (2, 50_000_000, pole, None)]


def test_the_region_of_the_focal_queries_has_many_blocks(spark):
    for made in (tables.cells, tables.surface):
        d = "/root/testdata/sf0.1"
        low, high, west, east = grids.bounds(made(spark, d, tables.region_trees(spark, d)))
        assert (high // grids.BLOCK - low // grids.BLOCK + 1) * (east // grids.BLOCK - west // grids.BLOCK + 1) >= 9


def test_blocks_far_from_any_cell_are_filled_with_null(spark, monkeypatch):
    monkeypatch.setattr(grids, "BLOCK", 7)
    cells = spark.createDataFrame([(-9, 3, 1.0), (30, 44, 2.0)], "row int, col int, z double")
    out = grids.fill_gaps(cells, "z", 1)
    assert out.count() == out.select("row", "col").distinct().count() == 40 * 42
    assert out.filter("z IS NOT NULL").count() == 8
    assert grids.fill_gaps(cells.limit(0), "z", 1).count() == 0


def stems_on_edges(spark, path, rows):
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double"
    spark.createDataFrame([(*r, "R", 3.0, 0.05) for r in rows], schema).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_stems_on_the_southern_edge_are_resampled_and_have_a_plot(spark, tmp_path):
    from emberplane import registry

    d = stems_on_edges(spark, tmp_path, [(0, 1, 0, 0), (1, 1, 0, 0)])  # y is 5,200,000 and 13 cm more
    for how in ("average", "max", "median", "min", "mode", "q1", "q3", "rms", "sum"):
        assert [r.row for r in registry.queries()[f"foc12_resample_{how}"](spark, d).orderBy("row").collect()] == [24, 25]
    near = registry.queries()["join10_nearest_plot"](spark, d).orderBy("l_orderkey").collect()
    assert [r.distance for r in near] == [round(math.hypot(2.29, 5.0), 4), round(math.hypot(1.48, 4.87), 4)]


@pytest.mark.parametrize("how", ["max", "median", "min", "mode", "q1", "q3", "rms"])
def test_resampled_stems_on_the_southern_edge_equal_the_sql(spark, tmp_path, how):
    import duckdb

    from emberplane import registry

    # y is 5,200,000, 5,200,000.13, 5,200,037.83 and 5,200,999.96.
    d = stems_on_edges(spark, tmp_path, [(0, 1, 0, 0), (1, 1, 0, 0), (291, 1, 0, 0), (7692, 1, 0, 0)])
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[f"foc12_resample_{how}"]).fetchall()
    assert sorted(map(tuple, registry.queries()[f"foc12_resample_{how}"](spark, d).collect())) == sorted(want)
    assert max(want)[0] == 25


def test_points_on_an_edge_lie_in_one_of_two_polygons(spark, tmp_path):
    from emberplane import registry

    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)]]
    p = spark.createDataFrame([(4.0, 1.0), (4.0, 0.0), (1.0, 0.0), (6.0, 0.0)], "x double, y double")
    for r in p.select(*(spatial.crossed(F.col("x"), F.col("y"), [ring]).alias(n) for n, ring in zip("ab", rings, strict=True))).collect():
        assert r.a != r.b
    d = stems_on_edges(spark, tmp_path, [(323826, 1, 50301, 2283)])  # on the boundary of the lake
    assert registry.queries()["join09_trees_in_polygon"](spark, d).count() == 1
    assert registry.queries()["join09_trees_outside_polygon"](spark, d).count() == 0


def test_exact_map_is_in_no_branch(spark):
    """Within a condition's branches Spark computes the parts that both coordinates share again and again."""
    p = spark.createDataFrame([(0.0, 0.0), (40.0, 7.0), (1e6, 3.0), (1e6 + 5, None)], "x double, y double")
    tile = F.when(F.col("x") < 100, 0).otherwise(1)
    out = reprojection.reprojected(p, tile, lambda x, y: (F.sinh(x / 1e4) + y, F.sinh(x / 1e4) - y), 1e-4)
    plan = out._jdf.queryExecution()
    top = [line for line in plan.optimizedPlan().toString().split("\n") if "SINH" in line]
    assert top and not any("ELSE" in line and "SINH" in line[line.index("ELSE") :] and " AS px" in line for line in top)
    assert "BroadcastHashJoin" in plan.executedPlan().toString()
    got = {r.x: (r.px, r.approximated) for r in out.collect()}
    assert got[40.0][0] == pytest.approx(math.sinh(40 / 1e4) + 7, abs=1e-4) and got[40.0][1]
    assert got[1e6][0] == pytest.approx(math.sinh(100.0) + 3) and not got[1e6][1] and got[1e6 + 5][0] is None


def test_pins_read_only_their_own_cells(spark, monkeypatch):
    kept, plain = [], files.written
    monkeypatch.setattr(coverage.files, "written", lambda df, tag="table": kept.append((tag, df.count())) or plain(df, tag))
    region = spark.range(10).withColumnRenamed("id", "cell")
    held = spark.range(500).selectExpr("id % 10 AS cell", "concat('s', id % 50) AS name")
    names = held.select("name").distinct().withColumn("density", F.lit(1.0))
    chosen = coverage.select_datasets(region, held, names, 1.0, pins=["s3", "s1"], enough=0.01)
    assert [(r.name, r.cells) for r in chosen.orderBy("place").collect()] == [("s3", 1), ("s1", 1)]
    assert ("held", 2) in kept


def test_majority_of_windows_by_hand(spark):
    rng, listed = np.random.default_rng(3), np.array([98.0, 32767.0])
    a = rng.choice([91.0, 92.0, 98.0, 32767.0, np.nan], (9, 11))
    there = ~np.isnan(a)
    got = grids.majority(a, there, listed)
    for r in range(9):
        for c in range(11):
            seen = [a[min(max(r + i, 0), 8), min(max(c + j, 0), 10)] for i in range(-2, 3) for j in range(-2, 3)]
            seen = [v for v in seen if not np.isnan(v)]
            free, most = [v for v in seen if v not in listed], max(map(seen.count, seen))
            own = there[r, c] and a[r, c] not in listed and seen.count(a[r, c]) == most
            want = a[r, c] if own or not free else max(free, key=lambda v: (seen.count(v), v))
            assert got[r, c] == want or (np.isnan(got[r, c]) and np.isnan(want))
