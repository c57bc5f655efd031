"""Event streams: weekly counters, current status, draining a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import shared_path


def weekly(events: DataFrame) -> DataFrame:
    """Events per user and ISO week; windows of seven days start on Mondays (the epoch is a Thursday)."""
    week = F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days")
    return events.groupBy("user_id", week.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("week"), "n")


def weekly_by(events: DataFrame, owner: str, kind: str) -> DataFrame:
    """events(ts, owner, kind) to (owner, kind, week, used): what each owner has dispatched of each kind in each ISO week."""
    week = F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days")
    return events.groupBy(F.col(owner).alias("owner"), F.col(kind).alias("kind"), week.alias("w")).agg(F.count("*").alias("used")).select("owner", "kind", F.col("w.start").alias("week"), "used")


def current(events: DataFrame) -> DataFrame:
    """The last event type of each user (ties of time: the later id)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and return the last state of its result, written by foreachBatch."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    last = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{number}")
        last["path"] = f"{out}/batch-{number}"

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last["path"]) if last else spark.createDataFrame([], stream.schema)


def appended(stream: DataFrame) -> DataFrame:
    """Run a stream over all there is and return every row it gave; a batch that is run again replaces itself."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/rows/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def uploads(stream: DataFrame, path: str, size: str, largest: int, time: str | None = None, again: str | None = None) -> DataFrame:
    """New objects once each by path, with their verdict: completed, or failed where empty, unknown or too large.

    With a `time` column and the longest delay `again` of a second delivery ("7 days"), a path is forgotten when
    the watermark has passed it by that delay, so the state is bounded by the traffic of that time; without, no
    path is ever forgotten, and the state grows with the number of paths."""
    ok = F.col(size).isNotNull() & (F.col(size) > 0) & (F.col(size) <= largest)
    once = stream.withWatermark(time, again).dropDuplicatesWithinWatermark([path]) if time and again else stream.dropDuplicates([path])
    return once.select(path, F.when(ok, "completed").otherwise("failed").alias("status"))


def tile_offsets(stream: DataFrame) -> DataFrame:
    """stream(tile, id) to (tile, id, place): a running number within the tile across batches. The only
    state of a tile is how many points it has had; its points come in Arrow batches, never all at once."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def number(key, batches, state):
        at = state.get[0] if state.exists else 0
        for b in batches:
            yield b.assign(tile=key[0], place=range(at, at + len(b)))[["tile", "id", "place"]]
            at += len(b)
        state.update((at,))

    return stream.groupBy("tile").applyInPandasWithState(number, "tile long, id long, place long", "n long", "append", GroupStateTimeout.NoTimeout)


def complete_up_to(arrived: DataFrame, last: DataFrame) -> DataFrame:
    """arrived(tile, idx) and last(tile, last_idx): per tile the first index that is still missing and
    whether all up to its last one are there, in whatever order they came."""
    order = F.row_number().over(Window.partitionBy("tile").orderBy("idx")) - 1
    run = arrived.filter("idx >= 0").distinct().withColumn("k_", order).filter("idx = k_").groupBy("tile").agg((F.max("idx") + 1).alias("next"))
    out = last.join(run, "tile", "left").withColumn("next", F.coalesce("next", F.lit(0).cast("long")))
    return out.select("tile", "next", (F.col("next") > F.col("last_idx")).alias("final"))


def prefixes(stream: DataFrame) -> DataFrame:
    """stream(cloud, idx) to (cloud, since, upto): how far each cloud is complete, whenever that grows. Indices below `upto`
    have all arrived, in whatever order and however often, with points or without.

    A cloud's state is its prefix and the runs of indices that have arrived beyond the first gap; its arrivals come
    in Arrow batches, never all at once."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches, state):
        import numpy as np
        import pandas as pd

        since, starts, ends = state.get if state.exists else (0, [], [])
        upto, starts, ends = since, np.array(starts, np.int64), np.array(ends, np.int64)
        for b in batches:
            new = np.unique(b["idx"].dropna().to_numpy(np.int64))
            new = new[new >= upto]
            breaks = np.flatnonzero(np.diff(new) > 1)
            lows, highs = new[np.append(0, breaks + 1)[: len(new)]], new[np.append(breaks, len(new) - 1)[: len(new)]] + 1
            starts, ends = np.append(starts, lows), np.append(ends, highs)
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
            first = np.append(True, starts[1:] > ends[:-1])[: len(starts)]  # runs that touch become one
            starts, ends = starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)[: int(first.sum())]]
            if len(starts) and starts[0] <= upto:
                upto, starts, ends = max(upto, int(ends[0])), starts[1:], ends[1:]
        state.update((upto, starts.tolist(), ends.tolist()))
        if upto > since:
            yield pd.DataFrame({"cloud": [key[0]], "since": [since], "upto": [upto]})

    return stream.groupBy("cloud").applyInPandasWithState(fold, "cloud long, since long, upto long", "upto long, starts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


def finished_tiles(stream: DataFrame, schedule: DataFrame) -> DataFrame:
    """stream(cloud, idx) and schedule(cloud, tile, last) to (cloud, tile), once for each tile, as soon as all of its cloud's
    indices up to the tile's last one have arrived."""
    grown = prefixes(stream).withColumn("last", F.explode(F.sequence("since", F.col("upto") - 1)))
    return grown.join(schedule.select("cloud", "tile", F.col("last").cast("long").alias("last")), ["cloud", "last"]).select("cloud", "tile")
