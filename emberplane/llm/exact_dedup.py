"""Exact deduplication by content-defined chunk recipes.

Each text, without ASCII white space, is cut where a rolling hash of the last 32 bytes says so
(about every 2 KB, 256 bytes at least), so equal texts are cut alike. A chunk's identifier is a
64-bit hash; it is verified when all chunks of the corpus that carry it have one 128-bit digest,
and else replaced by a hash of both. Documents are equal when their ordered identifier lists are
equal; of each text only its identifiers and its SHA-256 (the exact check that follows) move.

Nulls count as empty texts; all empty texts are equal to each other. Rows that share an id are
one document: they stay or go together, and each is returned. Among equally long texts the
smallest id stays; a row without id stays only if no row of its group has one. A very long text
takes memory in proportion in one task. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hash, slices, written

WINDOW, CUT_BITS, LEAST = 32, 11, 256
WHITE = b"\t\n\v\f\r "
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(77)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Ends of 32-byte windows whose hash allows a cut."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        shifted = h[:-width] << np.uint32(width)
        h[width:] += shifted
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def recipes(texts: list[bytes]) -> list[tuple[np.ndarray, list[bytes]]]:
    """Chunk identifiers and digests of each text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    places, total = cut_places(raw) if len(raw) else np.zeros(0, np.int64), prefix_hash(raw)
    down, out, at = powers(len(raw) + 1)[1], [], 0
    for text in texts:
        end, ends = at + len(text), []
        last = at
        for place in places[np.searchsorted(places, at + WINDOW) : np.searchsorted(places, end)].tolist():
            if place - last >= LEAST:
                ends.append(place)
                last = place
        if end > at:
            ends.append(end)
        stops = np.array(ends, np.int64)
        starts = np.concatenate([[at], stops[:-1]]).astype(np.int64) if ends else stops
        ids = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        digests = [hashlib.blake2b(text[s - at : e - at], digest_size=16).digest() for s, e in zip(starts.tolist(), ends, strict=True)]
        out.append((ids.view(np.int64), digests))
        at = end
    return out


def _build(batches):
    for batch in batches:
        for part in slices(batch, 1):
            texts = [(t or "") for t in part.column(1).to_pylist()]
            plain = [t.encode("utf-8", "surrogatepass").translate(None, WHITE) for t in texts]
            made = recipes(plain)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in plain]),
                    pa.array([x for x, _ in made], pa.list_(pa.int64())),
                    pa.array([x for _, x in made], pa.list_(pa.binary())),
                ],
                ["doc_id", "n_chars", "text_sha256", "ids", "digests"],
            )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = written(docs.mapInArrow(_build, "doc_id long, n_chars long, text_sha256 string, ids array<long>, digests array<binary>"), "recipes")

    store = made.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.digests").alias("digest")).distinct()
    unsure = store.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    unsure = written(unsure, "unsure")
    if not unsure.isEmpty():
        hit = made.select("doc_id", F.explode("ids").alias("id")).join(unsure, "id").select("doc_id").distinct().withColumn("hit", F.lit(True))
        again = F.zip_with("ids", "digests", lambda i, d: F.xxhash64(i, d))
        made = made.join(hit, "doc_id", "left").withColumn("ids", F.when(F.col("hit"), again).otherwise(F.col("ids")))

    # Two steps of sums and minima, which combine before the shuffle; written, so that copies met by the join can be split.
    best = made.groupBy("ids", "text_sha256", "n_chars").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    best = best.groupBy("ids", "text_sha256").agg(F.max_by("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("n_chars"))).alias("keep_id"), F.sum("n").alias("group_size"))
    out = made.select("doc_id", "ids", "text_sha256").join(written(best, "best"), ["ids", "text_sha256"])
    kept = F.when(F.col("keep_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
