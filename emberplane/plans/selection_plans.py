"""Queries over the choice of datasets for a region and what each contributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, lattices
from ..registry import query
from ..sources import tables
from .spatial_plans import BOXES, boxes

#: The region: 50 x 50 cells of 20 m. A dataset's footprint is its box, a cell belongs to it by its centre.
HELD = """named AS (SELECT 's' || id AS name, density, minx, miny, maxx, maxy FROM boxes),
 held AS MATERIALIZED (SELECT name, density, r.range * 1000 + c.range AS cell FROM named, range(50) r, range(50) c WHERE r.range * 20 + 10 BETWEEN miny AND maxy AND c.range * 20 + 10 BETWEEN minx AND maxx)"""
ROW = "name, place, cells, cells / CAST({total} AS DOUBLE) AS share, density, CAST(floor(density * cells * CAST({area} AS DOUBLE)) AS BIGINT) AS expected_points"
GROWN = HELD.replace("minx, miny, maxx, maxy FROM boxes", "minx - 120 AS minx, miny - 120 AS miny, maxx + 120 AS maxx, maxy + 120 AS maxy FROM boxes")
PINS = ["s4", "s2", "s9", "s1", "s3", "s7"]
LEAST_PIN = 0.02


def region(spark):
    return tables.lattice(spark, 50, 50).select((F.col("row") * 1000 + F.col("col")).alias("cell"))


def datasets(spark, d, grow=0.0):
    """Footprints, grown by some metres, on cells of 20 m, and names with densities."""
    b = boxes(spark, d).withColumn("name", F.concat(F.lit("s"), F.col("id")))
    b = b.select("name", "density", *((F.col(c) + s * grow).alias(c) for c, s in (("minx", -1), ("miny", -1), ("maxx", 1), ("maxy", 1))))
    return lattices.boxes_on_cells(b, 20.0).select((F.col("row") * 1000 + F.col("col")).alias("cell"), "name"), b.select("name", "density")


AUTOMATIC = f"""WITH RECURSIVE {BOXES}, {HELD},
 turn AS (SELECT CAST(-1 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS taken, '' AS name, CAST(0 AS DOUBLE) AS density, CAST(0 AS BIGINT) AS cells
  UNION ALL SELECT place + 1, list_concat(taken, gained), name, density, len(gained) FROM (SELECT t.place, t.taken, h.name, h.density, list(h.cell) AS gained FROM turn t, held h
   WHERE NOT list_contains(t.taken, h.cell) GROUP BY t.place, t.taken, h.name, h.density) QUALIFY row_number() OVER (ORDER BY len(gained) DESC, density DESC, name DESC) = 1)
 SELECT {ROW.format(total=2500, area=400)} FROM turn WHERE place >= 0"""


@query("geo13_ordered_contributions", AUTOMATIC)
def _(spark, d):
    """The datasets chosen by what they add, in their order, each with its own cells and the points that it should give."""
    return coverage.select_datasets(region(spark), *datasets(spark, d), 400.0)


@query("geo12_pinned_selection", f"""WITH RECURSIVE {BOXES}, {GROWN}, pins AS (SELECT unnest({PINS}) AS name, unnest(range({len(PINS)})) AS at),
 turn AS (SELECT CAST(-1 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS taken, '' AS name, CAST(0 AS BIGINT) AS cells
  UNION ALL SELECT t.place + 1, CASE WHEN count(h.cell) >= {LEAST_PIN} * 2500 THEN list_concat(t.taken, list(h.cell) FILTER (h.cell IS NOT NULL)) ELSE t.taken END, p.name, count(h.cell)
   FROM turn t JOIN pins p ON p.at = t.place + 1 LEFT JOIN held h ON h.name = p.name AND NOT list_contains(t.taken, h.cell) WHERE 2500 - len(t.taken) >= {LEAST_PIN} * 2500 GROUP BY t.place, t.taken, p.name)
 SELECT {ROW.format(total=2500, area=400).replace("place", "row_number() OVER (ORDER BY place) - 1 AS place", 1)} FROM turn JOIN (SELECT DISTINCT name, density FROM held) USING (name) WHERE cells >= {LEAST_PIN} * 2500""")
def _(spark, d):
    """Six pinned datasets in the user's order: an earlier one keeps what they share."""
    return coverage.select_datasets(region(spark), *datasets(spark, d, 120.0), 400.0, pins=PINS, enough=LEAST_PIN)


#: Footprints of every third dataset grown by 450 m, and a region of 20 x 20 cells in the middle, which several hold alone.
WIDE = """named AS (SELECT 's' || id AS name, density, minx - grow AS minx, miny - grow AS miny, maxx + grow AS maxx, maxy + grow AS maxy FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 450 ELSE 0 END AS grow FROM boxes)),
 held AS (SELECT name, density, r.range * 1000 + c.range AS cell FROM named, range(15, 35) r, range(15, 35) c WHERE r.range * 20 + 10 BETWEEN miny AND maxy AND c.range * 20 + 10 BETWEEN minx AND maxx)"""


@query("geo12_complete_dataset", f"WITH {BOXES}, {WIDE}, whole AS (SELECT name, density, count(*) AS cells FROM held GROUP BY ALL HAVING count(*) >= 396) SELECT name, 0 AS place, cells, cells / CAST(400 AS DOUBLE) AS share, density, CAST(floor(density * cells * CAST(400 AS DOUBLE)) AS BIGINT) AS expected_points FROM whole ORDER BY density DESC, name DESC LIMIT 1")
def _(spark, d):
    """Of the datasets that hold 99 % of the region by themselves, the densest alone."""
    b = boxes(spark, d).withColumns({"name": F.concat(F.lit("s"), F.col("id")), "grow": F.when(F.col("id") % 3 == 0, 450.0).otherwise(0.0)})
    b = b.select("name", "density", *((F.col(c) + s * F.col("grow")).alias(c) for c, s in (("minx", -1), ("miny", -1), ("maxx", 1), ("maxy", 1))))
    middle = tables.lattice(spark, 35, 35).filter("row >= 15 AND col >= 15").select((F.col("row") * 1000 + F.col("col")).alias("cell"))
    held = lattices.boxes_on_cells(b, 20.0).select((F.col("row") * 1000 + F.col("col")).alias("cell"), "name")
    return coverage.select_datasets(middle, held, b.select("name", "density"), 400.0)


@query("geo15_region_points", f"SELECT least(1, round(sum(share), 6)) AS covered, CAST(sum(expected_points) AS BIGINT) AS expected_points FROM ({AUTOMATIC})")
def _(spark, d):
    return coverage.coverage_share(coverage.select_datasets(region(spark), *datasets(spark, d), 400.0))
