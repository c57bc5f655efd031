"""Queries over catalogue rows and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue
from ..registry import query
from ..sources import tables
from ..streaming import dispatches
from . import base_sql as B

NOW_SQL = "TIMESTAMP '2001-09-01 00:00:00'"
OWNERS = "owners AS (SELECT c_custkey AS owner, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 2000 END AS ttl, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 30 END AS failed_ttl FROM customer WHERE c_custkey % 3 = 0)"


def owners(spark, d):
    own = tables.table(spark, d, "customer").filter("c_custkey % 3 = 0")
    days = lambda n: F.when(F.col("c_mktsegment") != "BUILDING", n)
    return own.select(F.col("c_custkey").alias("owner"), days(2000).alias("ttl"), days(30).alias("failed_ttl"))


def domains(spark, d):
    return tables.table(spark, d, "customer").filter("c_custkey % 200 < 150").select((F.col("c_custkey") % 200).alias("domain"))


TTL = f"{OWNERS}, aged AS (SELECT r.*, CASE WHEN o.owner IS NOT NULL THEN o.ttl ELSE 180 END AS ttl, CASE WHEN o.owner IS NOT NULL THEN o.failed_ttl ELSE 14 END AS failed_ttl FROM resources r LEFT JOIN owners o USING (owner))"


@query("cat01_owner_ttl", f"WITH {B.RESOURCES}, {TTL} SELECT id, ttl, failed_ttl FROM aged")
def _(spark, d):
    return catalogue.with_ttl(tables.resources(spark, d), owners(spark, d)).select("id", "ttl", "failed_ttl")


@query("cat02_expired", f"WITH {B.RESOURCES}, {TTL}, due AS (SELECT *, CASE WHEN status = 'failed' THEN failed_ttl ELSE ttl END AS days FROM aged) SELECT id FROM due WHERE days IS NOT NULL AND modified_on < {NOW_SQL} - to_days(CAST(greatest(days, 7) AS INT))")
def _(spark, d):
    return catalogue.expired(catalogue.with_ttl(tables.resources(spark, d), owners(spark, d)), F.expr(NOW_SQL)).select("id")


@query("cat03_orphans", B.resources(f"SELECT id FROM resources WHERE domain NOT IN (SELECT c_custkey % 200 FROM customer WHERE c_custkey % 200 < 150) AND modified_on < {NOW_SQL} - INTERVAL 24 HOUR"))
def _(spark, d):
    return catalogue.orphans(tables.resources(spark, d), domains(spark, d), F.expr(NOW_SQL)).select("id")


@query("cat04_stale_tests", "SELECT o_orderkey FROM orders WHERE starts_with('test-' || o_orderkey, 'test-1') AND o_orderdate < DATE '1995-01-01'")
def _(spark, d):
    return tables.table(spark, d, "orders").filter(F.concat(F.lit("test-"), F.col("o_orderkey").cast("string")).startswith("test-1") & (F.col("o_orderdate") < "1995-01-01")).select("o_orderkey")


@query("cat05_reconciliation", B.resources(f"""SELECT reason, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT id, size_bytes, CASE WHEN domain >= 150 THEN 'orphan' WHEN status = 'failed' THEN 'failed' WHEN modified_on < TIMESTAMP '1995-01-01' THEN 'old' END AS reason FROM resources) WHERE reason IS NOT NULL GROUP BY reason"""))
def _(spark, d):
    r = tables.resources(spark, d)
    tagged = [r.filter(c).select("id", F.lit(n).alias("reason")) for n, c in (("orphan", "domain >= 150"), ("failed", "status = 'failed'"), ("old", "modified_on < TIMESTAMP '1995-01-01'"))]
    one = catalogue.first_reason(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), ["orphan", "failed", "old"])
    return r.join(one, "id").groupBy("reason").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("cat06_listing", B.resources("SELECT id, owner, status FROM resources WHERE tag IN ('1-URGENT') AND status = 'completed'"))
def _(spark, d):
    r = tables.resources(spark, d).withColumn("tags", F.array("tag", F.lit("all")))
    return r.filter(F.array_contains("tags", "1-URGENT") & (F.col("status") == "completed")).select("id", "owner", "status")


@query("cat07_children_per_domain", B.resources("SELECT domain, owner % 4 AS kind, count(*) AS n FROM resources WHERE owner % 4 <> 3 GROUP BY ALL"))
def _(spark, d):
    return tables.resources(spark, d).withColumn("kind", F.col("owner") % 4).filter("kind <> 3").groupBy("domain", "kind").agg(F.count("*").alias("n"))


@query("cat08_stale_derived", B.resources("SELECT a.id FROM resources a JOIN resources b ON b.id = a.id - 1 WHERE a.size_bytes % 3 IS DISTINCT FROM b.size_bytes % 3"))
def _(spark, d):
    r = tables.resources(spark, d)
    source = r.select((F.col("id") + 1).alias("id"), (F.col("size_bytes") % 3).alias("was"))
    return r.join(source, "id").filter(~(F.col("size_bytes") % 3).eqNullSafe(F.col("was"))).select("id")


@query("agg14_usage", B.resources("SELECT owner, count(*) AS n, count(*) FILTER (WHERE status IN ('pending', 'running')) AS active, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM resources GROUP BY owner"))
def _(spark, d):
    return catalogue.usage(tables.resources(spark, d))


@query("agg15_quota_verdict", B.resources("SELECT owner, CASE WHEN a >= 8 THEN 'active' WHEN n >= 14 THEN 'count' WHEN b >= 1500000 THEN 'storage' END AS violated FROM (SELECT owner, count(*) AS n, count(*) FILTER (WHERE status IN ('pending', 'running')) AS a, sum(size_bytes) AS b FROM resources GROUP BY owner)"))
def _(spark, d):
    return catalogue.verdict(catalogue.usage(tables.resources(spark, d)), {"active": 8, "count": 14, "storage": 1_500_000}).select("owner", "violated")


@query("win10_top_listing", B.resources("SELECT id, size_bytes FROM resources ORDER BY size_bytes DESC, id LIMIT 20 OFFSET 10"))
def _(spark, d):
    return catalogue.page(tables.resources(spark, d), "size_bytes", 10, 20).select("id", "size_bytes")


@query("join14_orphan_anti_join", B.resources("SELECT count(*) AS n FROM resources WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = owner AND c_nationkey < 20)"))
def _(spark, d):
    keep = tables.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("owner"))
    return tables.resources(spark, d).join(keep, "owner", "left_anti").agg(F.count("*").alias("n"))


@query("set01_concat_and_dedupe", "SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return tables.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(tables.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).dropDuplicates(["k"])


@query("set03_difference", "SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    return tables.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(tables.table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("set07_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return catalogue.page(tables.table(spark, d, "orders"), "o_orderdate", 100, 50, "o_orderkey").select("o_orderkey")


@query("st02_weekly_budget", "SELECT user_id, date_trunc('week', CAST(ts AS TIMESTAMP)) AS week, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return dispatches.weekly(tables.table(spark, d, "events")).withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("st02_weekly_budget_stream", "SELECT user_id, date_trunc('week', CAST(ts AS TIMESTAMP)) AS week, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    source = spark.readStream.schema(tables.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    return dispatches.drained(dispatches.weekly(source), "complete").withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("st05_current_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return dispatches.current(tables.table(spark, d, "events"))


@query("st05_current_status_stream", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    """The status log as a stream: one row of state per user, in whatever order its events come."""
    source = spark.readStream.schema(tables.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    return dispatches.drained(dispatches.current(source), "complete")


@query("st06_incremental_summary_stream", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def _(spark, d):
    source = spark.readStream.schema(tables.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return dispatches.drained(source.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "complete")
