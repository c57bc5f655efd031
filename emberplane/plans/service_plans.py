"""Queries over quotas by kind and week, retention, listings, checked grids, and tree tables as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue, compose, generation, ingest
from ..operators.grids import Lattice
from ..registry import query
from ..sources import files, tables
from ..streaming import dispatches
from . import base_sql as B
from .catalogue_plans import NOW_SQL
from .lattice_plans import CELLS, PKEY, K, coarse

KINDS = ["grids", "exports", "inventories", "domains"]
KIND = f"element_at(array({', '.join(repr(k) for k in KINDS)}), CAST(id % 4 + 1 AS INT))"
TYPED = f"typed AS (SELECT *, {KINDS}[id % 4 + 1] AS kind, CASE WHEN owner % 3 = 0 THEN 'application' ELSE 'personal' END AS tier FROM resources)"


def typed(spark, d):
    return tables.resources(spark, d).withColumns({"kind": F.expr(KIND), "tier": F.when(F.col("owner") % 3 == 0, "application").otherwise("personal")})


SUMS = "count(*) AS n, count(*) FILTER (status IN ('pending', 'running')) AS active, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes"


@query("agg14_usage_by_kind", f"WITH {B.RESOURCES}, {TYPED} SELECT owner, kind, grouping(kind) = 1 AS all_kinds, {SUMS} FROM typed GROUP BY GROUPING SETS ((owner, kind), (owner))")
def _(spark, d):
    return catalogue.usage_by_kind(typed(spark, d))


#: tier, kind, active, count, storage, weekly; null is no limit.
LIMITS = [("personal", "grids", 2, 4, 600_000, 12), ("personal", "exports", 1, 5, None, 9), ("personal", "inventories", None, 3, 500_000, None), ("personal", "domains", None, 4, None, None),
          ("application", "grids", 4, 8, 2_000_000, 20), ("application", "exports", 3, None, None, 14), ("application", "inventories", None, 6, 900_000, None)]
LIMIT_COLUMNS = "tier, kind, active_limit, count_limit, storage_limit, weekly_limit"
LIMITS_SQL = f"limits({LIMIT_COLUMNS}) AS (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in row) + ')' for row in LIMITS)})"
WEEK = "TIMESTAMP '2024-01-08 00:00:00'"


@query("agg15_quota_by_kind", f"""WITH {B.RESOURCES}, {TYPED}, {LIMITS_SQL}, used AS (SELECT user_id AS owner, CASE event_type WHEN 'click' THEN 'grids' WHEN 'view' THEN 'exports' ELSE 'domains' END AS kind, count(*) AS used FROM events WHERE date_trunc('week', CAST(ts AS TIMESTAMP)) = {WEEK} GROUP BY 1, 2),
 usage AS (SELECT owner, tier, kind, {SUMS} FROM typed GROUP BY ALL), joined AS (SELECT u.*, l.* EXCLUDE (tier, kind), coalesce(used, 0) AS used FROM usage u LEFT JOIN limits l USING (tier, kind) LEFT JOIN used USING (owner, kind)),
 judged AS (SELECT *, CASE WHEN active >= active_limit THEN 'active' WHEN n >= count_limit THEN 'count' WHEN bytes >= storage_limit THEN 'storage' WHEN used >= weekly_limit THEN 'weekly' END AS violated FROM joined)
 SELECT owner, kind, violated, CAST(CASE violated WHEN 'active' THEN active WHEN 'count' THEN n WHEN 'storage' THEN bytes WHEN 'weekly' THEN used END AS BIGINT) AS current, CAST(CASE violated WHEN 'active' THEN active_limit WHEN 'count' THEN count_limit WHEN 'storage' THEN storage_limit WHEN 'weekly' THEN weekly_limit END AS BIGINT) AS most, CASE WHEN violated IS NOT NULL THEN violated = 'active' END AS retry FROM judged""")
def _(spark, d):
    """Each owner's usage by kind against the limits of the owner's tier and the week's dispatches."""
    t = typed(spark, d)
    use = catalogue.usage_by_kind(t).filter("NOT all_kinds").withColumn("tier", F.when(F.col("owner") % 3 == 0, "application").otherwise("personal"))
    limits = spark.createDataFrame(LIMITS, "tier string, kind string, active_limit int, count_limit int, storage_limit int, weekly_limit int")
    kind = F.when(F.col("event_type") == "click", "grids").when(F.col("event_type") == "view", "exports").otherwise("domains")
    weeks = dispatches.weekly_by(tables.table(spark, d, "events").withColumn("kind", kind), "user_id", "kind")
    return catalogue.quota_verdicts(use, limits, weeks.filter(F.col("week").cast("timestamp_ntz") == F.expr(WEEK.replace("TIMESTAMP", "TIMESTAMP_NTZ"))))


NAMED = "named AS (SELECT CASE WHEN id % 5 = 0 THEN 'static-test-' WHEN id % 5 < 3 THEN 'test-' ELSE 'r' END || id AS id, CASE WHEN owner % 4 = 0 THEN 'test-' || owner WHEN owner % 4 < 3 THEN 'o' || owner END AS owner, domain, status, modified_on, size_bytes FROM resources)"


def named(spark, d):
    prefix = F.when(F.col("id") % 5 == 0, "static-test-").when(F.col("id") % 5 < 3, "test-").otherwise("r")
    owner = F.when(F.col("owner") % 4 == 0, F.concat(F.lit("test-"), F.col("owner"))).when(F.col("owner") % 4 < 3, F.concat(F.lit("o"), F.col("owner")))
    return tables.resources(spark, d).withColumns({"id": F.concat(prefix, F.col("id")), "owner": owner})


@query("cat04_stale_tests_by_owner", f"WITH {B.RESOURCES}, {NAMED} SELECT id FROM named WHERE (starts_with(id, 'test-') OR coalesce(starts_with(owner, 'test-'), false)) AND NOT starts_with(id, 'static-test-') AND modified_on < TIMESTAMP '1999-06-01' - INTERVAL 2 DAY")
def _(spark, d):
    return catalogue.stale_tests(named(spark, d), F.expr("TIMESTAMP '1999-06-01 00:00:00'")).select("id")


@query("cat05_dry_run_report", f"""WITH {B.RESOURCES}, {NAMED}, reasoned AS (SELECT size_bytes, CASE WHEN domain >= 150 THEN 'orphan_doc' WHEN status = 'failed' THEN 'ttl' WHEN starts_with(id, 'test-') OR starts_with(owner, 'test-') AND NOT starts_with(id, 'static-test-') THEN 'test_stale' END AS category FROM named),
 flags(category, dry_run) AS (VALUES ('orphan_doc', false), ('ttl', true), ('test_stale', false), ('blob', true)), sums AS (SELECT category, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM reasoned WHERE category IS NOT NULL GROUP BY 1)
 SELECT category, dry_run, coalesce(n, 0) AS n, CASE WHEN dry_run THEN 0 ELSE coalesce(n, 0) END AS deleted, coalesce(bytes, 0) AS bytes, CASE WHEN dry_run THEN 0 ELSE coalesce(bytes, 0) END AS freed FROM flags LEFT JOIN sums USING (category)""")
def _(spark, d):
    """Candidates of deletion by category, each id in its first one; only the categories without a dry run are deleted."""
    r = named(spark, d)
    found = {"orphan_doc": r.filter("domain >= 150"), "ttl": r.filter("status = 'failed'"), "test_stale": catalogue.stale_tests(r, F.expr(NOW_SQL)), "blob": r.limit(0)}
    return catalogue.reconciliation(r, found, {"orphan_doc": False, "test_stale": False})


@query("cat06_nested_listing", B.resources("SELECT id, owner, size_bytes, count(*) OVER () AS total FROM resources WHERE status = 'completed' AND tag = '1-URGENT' AND domain % 3 = 1 ORDER BY size_bytes DESC, id LIMIT 25 OFFSET 25"))
def _(spark, d):
    """The second page of a listing by a nested field and a tag, with the number of all rows."""
    r = tables.resources(spark, d).withColumns({"tags": F.array("tag", F.lit("all")), "source": F.struct((F.col("domain") % 3).alias("name"))})
    rows = catalogue.listing(r, {"status": "completed", "source.name": 1}, {"tags": "1-URGENT"})
    return catalogue.counted_page(rows, "size_bytes", 1, 25).select("id", "owner", "size_bytes", "total")


@query("cat07_children_of_owner", f"WITH {B.RESOURCES}, {TYPED}, d AS (SELECT domain, min(owner) AS owner FROM resources GROUP BY domain) SELECT domain, kind, count(*) AS n FROM typed JOIN d USING (domain, owner) WHERE kind IN ('grids', 'inventories') GROUP BY ALL")
def _(spark, d):
    """What of a domain's own owner keeps it from being deleted; exports and other owners' rows do not."""
    t = typed(spark, d)
    return catalogue.children(t.groupBy("domain").agg(F.min("owner").alias("owner")), t)


@query("src01_tree_table", B.trees(f"SELECT {PKEY}, x, y, fia_species_code, dbh, height, crown_ratio, fia_status_code FROM trees WHERE fia_status_code = 1"))
def _(spark, d):
    """A written tree table read with its needed columns and live trees only."""
    path = files.shared_path(spark, "trees")
    tables.trees(spark, d).withColumn("unused", F.lit("x")).write.parquet(path)
    return ingest.read_trees(spark, path, tuple(K))


@query("join07_composed_grids", f"{CELLS}, s AS (SELECT row, col, sum(CASE WHEN fia_status_code = 1 THEN 1 ELSE 0 END) AS live FROM located WHERE fia_species_code = 122 GROUP BY row, col) SELECT row, col, n AS all_n, live AS pine_live FROM cells FULL JOIN s USING (row, col)")
def _(spark, d):
    """Two grids on one lattice, cell for cell, after their lattices have been found the same."""
    square = Lattice(500000.0, 5201000.0, 10.0, 100, 100)
    pine = tables.located(tables.trees(spark, d)).filter("fia_species_code = 122").groupBy("row", "col").agg(F.sum(F.when(F.col("fia_status_code") == 1, 1).otherwise(0)).alias("live"))
    return compose.aligned({"all": compose.Grid(tables.cells(spark, d).select("row", "col", "n"), square, "EPSG:32611"), "pine": compose.Grid(pine, square, "EPSG:32611")})


@query("join08_cropped_grid", f"{CELLS} SELECT CAST(row - 20 AS INT) AS row, CAST(col - 30 AS INT) AS col, n FROM cells WHERE row BETWEEN 20 AND 69 AND col BETWEEN 30 AND 69")
def _(spark, d):
    grid = compose.Grid(tables.cells(spark, d).select("row", "col", "n"), Lattice(500000.0, 5201000.0, 10.0, 100, 100), "EPSG:32611")
    return compose.cropped(grid, Lattice(500300.0, 5200800.0, 10.0, 50, 40))


@query("src22_export_bands", f"{CELLS} SELECT row, col, max_height, n FROM cells")
def _(spark, d):
    return compose.chosen_bands(tables.cells(spark, d), ["max_height", "n"])


@query("src22_shared_nodata", "SELECT s_nationkey AS grid, count(DISTINCT coalesce(CAST(s_suppkey % 3 AS VARCHAR), 'none')) = 1 AS is_uniform, CASE WHEN count(DISTINCT coalesce(CAST(s_suppkey % 3 AS VARCHAR), 'none')) = 1 THEN max(CAST(s_suppkey % 3 AS DOUBLE)) END AS nodata FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS s_suppkey FROM supplier) GROUP BY 1")
def _(spark, d):
    bands = tables.table(spark, d, "supplier").selectExpr("s_nationkey AS grid", "s_suppkey AS band", "CAST(nullif(s_suppkey % 3, 0) AS DOUBLE) AS nodata")
    return compose.uniform_nodata(bands)


STACK = f"""WITH {B.TREES}, v AS (SELECT CAST(floor(height / 5) AS INT) AS k, CAST(floor((5201000 - y) / 50) AS INT) AS j, CAST(floor((x - 500000) / 50) AS INT) AS i, sum(height) AS density FROM trees GROUP BY ALL),
 canopy AS (SELECT *, 60 + (i * 7 + j) % 40 AS wet, 1000 + (i + j * 3) % 900 AS savr FROM v WHERE k > 0 OR i % 3 > 0), surface AS (SELECT j, i, density / 40 AS load, density / 1000 AS depth, 5 + (i + j) % 30 AS wet, CASE WHEN i % 4 = 0 THEN 0 ELSE 2000 END AS savr FROM v WHERE k = 1),
 s AS (SELECT coalesce(k, 0) AS k, coalesce(c.j, s.j) AS j, coalesce(c.i, s.i) AS i, coalesce(density, 0) AS own, coalesce(load, 0) / 5 AS more, coalesce(c.wet, 0) / 100 AS wet, coalesce(s.wet, 0) / 100 AS wet_s, coalesce(depth, 0) AS depth, coalesce(c.savr, 0) AS savr, coalesce(s.savr, 0) AS savr_s FROM canopy c FULL JOIN surface s ON c.k = 0 AND c.j = s.j AND c.i = s.i),
 r AS (SELECT *, CASE WHEN k > 0 THEN savr WHEN own + more > 0 THEN (own * savr + more * savr_s) / (own + more) ELSE 0 END AS ratio FROM s)"""


def stack_inputs(spark, d):
    v = coarse(spark, d)
    canopy = v.filter("k > 0 OR i % 3 > 0").withColumns({"moisture": 60 + (F.col("i") * 7 + F.col("j")) % 40, "savr": 1000 + (F.col("i") + F.col("j") * 3) % 900})
    surface = v.filter("k = 1").select("j", "i", (F.col("density") / 40).alias("load"), (F.col("density") / 1000).alias("depth"), (5 + (F.col("i") + F.col("j")) % 30).alias("moisture"), F.when(F.col("i") % 4 == 0, 0).otherwise(2000).alias("savr"))
    return canopy, surface


for how, wet in (("max", "greatest(wet, wet_s)"), ("mean", "CASE WHEN own + more > 0 THEN (own * wet + more * wet_s) / (own + more) ELSE 0 END")):
    @query(f"src24_fire_stack_{how}", f"{STACK} SELECT k, j, i, round(own + more, 6) AS rho, round(CASE WHEN k > 0 THEN wet ELSE {wet} END, 9) AS moisture, round(CASE WHEN k = 0 THEN depth ELSE 0 END, 6) AS depth, CASE WHEN ratio > 0 THEN round(2 / ratio, 9) ELSE 0 END AS size FROM r")
    def _(spark, d, how=how):
        out = compose.fire_stack(*stack_inputs(spark, d), dz=5.0, moisture=how)
        return out.select("k", "j", "i", *(F.round(c, n).alias(c) for c, n in (("rho", 6), ("moisture", 9), ("depth", 6), ("size", 9))))


@query("join03_first_plot", f"{CELLS}, p AS (SELECT p_partkey % 50 + 1 AS code, min(p_partkey) AS cn FROM part GROUP BY 1) SELECT row, col, n - 2 AS code, CAST(coalesce(cn, -9999) AS BIGINT) AS cn FROM cells LEFT JOIN p ON n - 2 = p.code")
def _(spark, d):
    """Each cell's code by a table with several plots a code: the least plot, no data outside of the table."""
    plots = tables.table(spark, d, "part").select((F.col("p_partkey") % 50 + 1).alias("key"), F.col("p_partkey").alias("cn"))
    return compose.first_match(tables.cells(spark, d).select("row", "col", (F.col("n") - 2).alias("code")), "code", plots, "key", "cn", -9999).select("row", "col", "code", "cn")


@query("src15_checked_upload", f"{CELLS} SELECT col * CAST(10 AS DOUBLE) + 5 AS x, row * CAST(10 AS DOUBLE) + 5 AS y, n AS stems, max_height AS top FROM cells WHERE col * 10 + 5 BETWEEN 180 AND 620 AND row * 10 + 5 BETWEEN 80 AND 520")
def _(spark, d):
    """Bands named by their position, after the upload's cells have been found square and in the domain."""
    c = tables.cells(spark, d).select((F.col("col") * 10.0 + 5).alias("x"), (F.col("row") * 10.0 + 5).alias("y"), F.col("n").alias("band_1"), F.col("max_height").alias("band_2"))
    box = (200.0, 100.0, 600.0, 500.0)
    lattice = compose.upload_lattice(c, ["stems", "top"], "EPSG:32611", "EPSG:32611", box)
    return generation.ingest_cells(c, {"band_1": "stems", "band_2": "top"}, box, lattice.cell, 2).drop("regular")
