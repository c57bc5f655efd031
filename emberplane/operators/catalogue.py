"""Retention, orphans, quotas and listings over catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR_DAYS = 7


def with_ttl(rows: DataFrame, owners: DataFrame, default: tuple[int, int] = (180, 14)) -> DataFrame:
    """rows with days to live of finished and of failed rows. An owner's row, where there is one, decides
    even by null (never); owners(owner, ttl, failed_ttl)."""
    o = owners.withColumn("known_", F.lit(True))
    out = rows.join(o, "owner", "left")
    return out.withColumns({"ttl": F.when(F.col("known_"), F.col("ttl")).otherwise(default[0]), "failed_ttl": F.when(F.col("known_"), F.col("failed_ttl")).otherwise(default[1])}).drop("known_")


def expired(rows: DataFrame, now: Column, protected: str = "static-test-") -> DataFrame:
    """Rows past their days (the failed clock for failed rows; at least FLOOR_DAYS); null times and protected ids stay."""
    days = F.greatest(F.when(F.col("status") == "failed", F.col("failed_ttl")).otherwise(F.col("ttl")), F.lit(FLOOR_DAYS))
    days = F.when(F.when(F.col("status") == "failed", F.col("failed_ttl")).otherwise(F.col("ttl")).isNotNull(), days)
    return rows.filter((F.col("modified_on") < now - F.make_dt_interval(days)) & ~F.col("id").cast("string").startswith(protected))


def orphans(rows: DataFrame, parents: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows without a parent domain, unless younger than `hours`; an unknown age counts as old."""
    return rows.join(parents.select("domain").distinct(), "domain", "left_anti").filter(F.coalesce(F.col("modified_on") < now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(True)))


def usage(rows: DataFrame) -> DataFrame:
    """Per owner: rows, active rows, bytes (nulls ignored)."""
    return rows.groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("pending", "running")).alias("active"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def verdict(use: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first limit that is reached: active, count, storage."""
    out = F.lit(None).cast("string")
    for name, column in (("storage", "bytes"), ("count", "n"), ("active", "active")):
        out = F.when(F.col(column) >= limits[name], F.lit(name)).otherwise(out)
    return use.withColumn("violated", out)


def first_reason(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(id, reason): each id under one reason, the first of the order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("reason"))
    return rows.groupBy("id").agg(F.min_by("reason", rank).alias("reason"))


def page(rows: DataFrame, sort: str, offset: int, limit: int, ties: str = "id") -> DataFrame:
    """A page of a listing, highest first."""
    return rows.orderBy(F.desc(sort), ties).offset(offset).limit(limit)


def usage_by_kind(rows: DataFrame) -> DataFrame:
    """rows(owner, kind, status, size_bytes) to (owner, kind, all_kinds, n, active, bytes): a row for each kind of an owner, and one
    with all_kinds for the owner's total."""
    sums = F.count("*").alias("n"), F.count_if(F.col("status").isin("pending", "running")).alias("active"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    out = rows.groupingSets([["owner", "kind"], ["owner"]], "owner", "kind").agg((F.grouping("kind") == 1).alias("all_kinds"), *sums)
    return out.select("owner", "kind", "all_kinds", "n", "active", "bytes")


LIMITS = {"active": "active", "count": "n", "storage": "bytes", "weekly": "used"}


def quota_verdicts(use: DataFrame, limits: DataFrame, weekly: DataFrame) -> DataFrame:
    """use(owner, tier, kind, n, active, bytes) against limits(tier, kind, active_limit, count_limit, storage_limit, weekly_limit) and
    weekly(owner, kind, used), the dispatches of the week: `violated`, the first limit reached of active, count, storage and weekly,
    with `current`, `most` and `retry`, whether waiting helps. A null limit is not checked, no counter counts as 0."""
    u = use.join(limits, ["tier", "kind"], "left").join(weekly.select("owner", "kind", "used"), ["owner", "kind"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    found = F.lit(None).cast("struct<violated: string, current: long, most: long, retry: boolean>")
    for name, column in reversed(LIMITS.items()):
        most = F.col(f"{name}_limit").cast("long")
        hit = F.struct(F.lit(name).alias("violated"), F.col(column).cast("long").alias("current"), most.alias("most"), F.lit(name == "active").alias("retry"))
        found = F.when(F.col(column) >= most, hit).otherwise(found)
    return u.withColumn("f_", found).select("owner", "kind", "f_.violated", "f_.current", "f_.most", "f_.retry")


def stale_tests(rows: DataFrame, now: Column, days: int = 2, protected: str = "static-test-") -> DataFrame:
    """Rows of tests, by the id's or the owner's prefix, older than `days`; protected ids and unknown ages stay."""
    test = F.col("id").startswith("test-") | F.coalesce(F.col("owner").startswith("test-"), F.lit(False))
    return rows.filter(test & ~F.col("id").startswith(protected) & (F.col("modified_on") < now - F.make_dt_interval(F.lit(days))))


def reconciliation(rows: DataFrame, found: dict[str, DataFrame], dry_run: dict[str, bool]) -> DataFrame:
    """rows(id, size_bytes) and the ids found in each category, in the order in which they count, to (category, dry_run, n, deleted, bytes,
    freed): an id counts in its first category only; a dry run deletes nothing. Categories without a row are listed, too."""
    spark, names = rows.sparkSession, list(found)
    ids = None
    for name, df in found.items():
        own = df.select("id", F.lit(name).alias("reason"))
        ids = own if ids is None else ids.unionByName(own)
    one = first_reason(ids, names)
    sums = rows.join(one, "id").groupBy(F.col("reason").alias("category")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    out = spark.createDataFrame([(n, dry_run.get(n, True)) for n in names], "category string, dry_run boolean").join(sums, "category", "left").fillna(0, ["n", "bytes"])
    real = lambda c: F.when(F.col("dry_run"), F.lit(0)).otherwise(F.col(c))
    return out.select("category", "dry_run", "n", real("n").alias("deleted"), "bytes", real("bytes").alias("freed"))


def listing(rows: DataFrame, equal: dict[str, object] | None = None, contains: dict[str, object] | None = None) -> DataFrame:
    """Rows whose fields (nested by dots) have the values, and whose arrays contain the others; all conditions hold. A null field or
    array never matches."""
    for field, value in (equal or {}).items():
        rows = rows.filter(F.col(field) == value)
    for field, value in (contains or {}).items():
        rows = rows.filter(F.array_contains(field, value))
    return rows


def counted_page(rows: DataFrame, sort: str | None, number: int, size: int, descending: bool = True, ties: str = "id") -> DataFrame:
    """A page (from 0) of a listing with `total`, the number of rows on all pages; by default the highest first."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    order = [F.desc(sort) if descending else F.asc(sort), ties] if sort else [ties]
    return rows.orderBy(*order).offset(number * size).limit(size).join(F.broadcast(total))


#: Kinds that keep a domain from being deleted; exports do not.
CHILDREN = ("grids", "inventories", "features", "pointclouds")


def children(domains: DataFrame, rows: DataFrame) -> DataFrame:
    """domains(domain, owner) and rows(domain, owner, kind) to (domain, kind, n): what of the same owner still hangs on each domain."""
    own = rows.filter(F.col("kind").isin(*CHILDREN)).groupBy("domain", "owner", "kind").agg(F.count("*").alias("n"))
    return domains.select("domain", "owner").join(own, ["domain", "owner"]).groupBy("domain", "kind").agg(F.sum("n").alias("n"))
