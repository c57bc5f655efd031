"""Helpers shared by the corpus operators: written intermediates, text hashing, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only local mode (tests) may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^,]*\]|\[.*,.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor; shuffle files of the
    finished write are released at once, so the disk peak is that of one job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberplane-{uuid.uuid4().hex}/{tag}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    back = spark.read.schema(df.schema).parquet(path)
    _made[back] = path
    return back


_made: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables that `written` made and that nothing reads any more."""
    for df in tables:
        path = _made.pop(df, None) if df is not None else None
        if path:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)


def spare_name(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    return name + "_" * (1 + max(map(len, docs.columns)))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column (and its name) that tells all rows apart and ascends with doc_id, nulls last.

    Where ids are there and differ, they are the key themselves; else a copy is written that is numbered by id and a
    hash of the text, so that rows that share an id, or have none, are documents of their own."""
    name = spare_name(docs, "row")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    hashed = spare_name(docs, "hash")
    order = [F.col("doc_id").asc_nulls_last(), hashed]
    return files.numbered(docs.withColumn(hashed, F.xxhash64(F.col("text").cast("string"))), [], order, name).drop(hashed), name


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Cut a batch into row ranges of about `limit` bytes of text (one row at least)."""
    text = batch.column(column)
    ends = np.cumsum(text_lengths(text))
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_lengths(text: pa.Array) -> np.ndarray:
    return text_buffer(text)[1][1:] - text_buffer(text)[1][:-1]


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array (nulls count as empty) and the n + 1 offsets into them."""
    if text.null_count:
        text = text.fill_null("")
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        text, kind = text.cast(pa.string()), np.int32
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i (mod 2^64) for i < n, kept for the longest n so far."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the polynomial hash of raw[s:e], still to be multiplied by BASE^-s."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:-1], out=out[1:])
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Masks of the first 0 to 8 bytes of a little-endian word of eight.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


LONG_WORD = 256


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space, A-Z lower-cased) of
    every text, in order, and the n + 1 offsets of each text's words.

    Eight bytes at a time go through `mix`, so no word structure makes hashes meet; the few words
    over LONG_WORD bytes take the head of their BLAKE2 digest."""
    raw, ends = text_buffer(text)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    gap = SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    starts, stops = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    size = stops - starts
    low = np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), (len(raw) + 1,), (1,))
    hashes = mix(size.astype(np.uint64) * BASE)
    at, left = np.arange(len(size)), np.minimum(size, LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        hashes[at] = mix(hashes[at] ^ (eight[starts[at] + k] & HEAD[np.minimum(left[at] - k, 8)]))
        at = at[left[at] > k + 8]
        if not len(at):
            break
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[w] = int.from_bytes(hashlib.blake2b(low[starts[w] : stops[w]].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(starts, ends)


def shingle_sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; fewer words make one shingle, none none."""
    words, at = word_hashes(text)
    # Unrelated odd factors: with related ones (1, 3, 5, 7, 9) repeated words gave equal sums.
    weight = list(mix(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1))
    whole = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        whole += words[k : len(words) - n + 1 + k] * weight[k] if len(whole) else whole
    whole = mix(whole)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= n:
            out.append(np.unique(whole[s : e - n + 1]))
        elif e > s:
            short = (words[s:e] * np.array(weight[: e - s])).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(short + np.uint64(e - s)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component the least node.

    Alternating large-star and small-star steps; each round is a minimum per node (combined
    before the shuffle) and an equi-join, so a hub with any number of neighbours is no hot task.
    Nodes without an edge to another node are not returned.
    """
    up, down = F.greatest(a, b), F.least(a, b)
    now = written(edges.filter(F.col(a) != F.col(b)).select(up.alias("u"), down.alias("v")).distinct(), "edges")
    while True:
        # A forest of stars: every node points to one centre at most, and no centre points on.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        loose = ends.groupBy("x").agg(F.sum("out").alias("o"), F.max("into").alias("i")).filter("o > 1 OR (o = 1 AND i = 1)")
        if loose.isEmpty():
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            _made[out] = _made[now]
            return out
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u")
        step = small.select("u", F.col("w").alias("v")).unionByName(small.filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")))
        was, now = now, written(step.distinct(), "edges")
        discard(was)
