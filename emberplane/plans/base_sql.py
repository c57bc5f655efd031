"""Common table expressions that give DuckDB the derived tables of emberplane.sources.tables."""

TREES = """trees AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CAST(500000 AS DOUBLE) + CAST((l_orderkey*7919 + l_partkey*31 + l_linenumber*104729) % 100000 AS DOUBLE)/CAST(100 AS DOUBLE) AS x,
 CAST(5200000 AS DOUBLE) + CAST((l_partkey*6151 + l_suppkey*17 + l_orderkey*13) % 100000 AS DOUBLE)/CAST(100 AS DOUBLE) AS y,
 CASE l_suppkey % 6 WHEN 0 THEN 122 WHEN 1 THEN 202 WHEN 2 THEN 93 WHEN 3 THEN 15 WHEN 4 THEN 746 ELSE NULL END AS fia_species_code,
 CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS fia_status_code,
 CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) + l_quantity*CAST(1.7 AS DOUBLE) END AS dbh,
 CAST(1.5 AS DOUBLE) + CAST((l_orderkey*3 + l_partkey*7) % 4000 AS DOUBLE)/CAST(100 AS DOUBLE) AS height,
 CAST(0.2 AS DOUBLE) + l_discount*CAST(5 AS DOUBLE) AS crown_ratio FROM lineitem)"""
#: The stems of a region of several squares, under the name of those of one.
REGION = f"""{TREES.replace("trees AS", "square AS", 1)}, trees AS (SELECT * REPLACE (x + 1000 * (l_orderkey // 3000 % 8) AS x, y - 1000 * (l_orderkey // 24000) AS y) FROM square)"""
LOCATED = "located AS (SELECT *, CAST(floor((5201000 - y)/10) AS INT) AS row, CAST(floor((x - 500000)/10) AS INT) AS col FROM trees)"
CELLS = "cells AS (SELECT row, col, count(*) AS n, avg(height) AS mean_height, max(height) AS max_height FROM located GROUP BY row, col)"
SURFACE = "surface AS (SELECT CAST(floor((5201000 - y)/5) AS INT) AS row, CAST(floor((x - 500000)/5) AS INT) AS col, count(*) AS n, max(height) AS z, min(height) AS low FROM trees GROUP BY 1, 2)"
CODES = "codes AS (SELECT *, CASE WHEN n % 7 = 3 THEN 32767 ELSE CAST(91 + (row // 8 * 7 + col // 8 * 13 + n % 3) % 45 AS INT) END AS code FROM surface)"
POINTS = """points AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CAST((l_orderkey*7919 + l_partkey*31 + l_linenumber*104729) % 100000 AS INT) AS X, CAST((l_partkey*6151 + l_suppkey*17 + l_orderkey*13) % 100000 AS INT) AS Y,
 CAST((l_orderkey*3 + l_partkey*7) % 4000 + 100000 AS INT) AS Z, CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 7 END AS classification FROM lineitem)"""
RESOURCES = """resources AS (SELECT o_orderkey AS id, o_custkey AS owner, o_custkey % 200 AS domain,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 CAST(o_orderdate AS TIMESTAMP) AS modified_on, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderpriority AS tag FROM orders)"""
LATTICE = "lattice AS (SELECT CAST(a.range AS INT) AS row, CAST(b.range AS INT) AS col FROM range(100) a, range(100) b)"


def trees(sql: str) -> str:
    return f"WITH {TREES} {sql}"


def cells(sql: str) -> str:
    return f"WITH {TREES}, {LOCATED}, {CELLS} {sql}"


def points(sql: str) -> str:
    return f"WITH {POINTS} {sql}"


def resources(sql: str) -> str:
    return f"WITH {RESOURCES} {sql}"


def lattice(sql: str) -> str:
    return f"WITH {LATTICE} {sql}"


def surface(sql: str) -> str:
    return f"WITH {TREES}, {SURFACE} {sql}"


def codes(sql: str) -> str:
    return f"WITH {TREES}, {SURFACE}, {CODES} {sql}"


def region(sql: str) -> str:
    """A query of the one square on the stems of the region."""
    return sql.replace(TREES, REGION)


def window(reach: int) -> str:
    """off(dr, dc): the offsets of a square window."""
    return f"off AS (SELECT CAST(a.range - {reach} AS INT) AS dr, CAST(b.range - {reach} AS INT) AS dc FROM range({2 * reach + 1}) a, range({2 * reach + 1}) b)"
