"""Removal of every byte that a repeated string of `length` bytes covers.

A suffix sort of depth `length`, made block by block over a cover sample:

* Cover sample. In each window of `length` bytes the least hash of its 64-byte strings is the
  window's sample. Equal windows have equal samples wherever they lie, so, like a difference
  cover, the sample is met at the same distance from both of two equal suffixes; but it needs about
  1.5 places in 100 where a cover of fixed places with period 133 needs 9 in 100.
* Ranks of the sample. Neighbouring windows of one text with one sample form a run. A run is named
  by the digest of the bytes it spans; runs of one sample and one digest tie in full, so all
  suffixes that start in them are repeated. Samples that occur once need no sort at all. This
  resolves the long ties: copies and long passages never reach the byte level.
* Suffix buckets. What is left are suffixes of samples that have several different runs, at the
  edges of passages. One representative of each such run is opened, and its suffixes are ordered by
  sample and by the key of their `length` bytes, one bucket of samples at a time, which bounds the
  disk that a bucket takes. Suffixes with equal keys are repeated.

Samples (of 64 bytes) and keys (of `length` bytes) are 64-bit polynomial hashes, digests of runs (of
any length, where a polynomial has strings that meet by construction) are XXH3 of the run's bytes.
Keys and digests are always compared together with the sample; two different strings of one corpus
with n windows meet with a probability of about n^2 / 2^129.

Strings start and end within one text. A null text has no bytes. Rows that share an id are one
document only if also their texts are equal; `doc_id` is returned for each row (fully repeated
rows count as repeats of each other). A very long text takes some 60 bytes of memory per byte in one
task, and two GB at most. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, powers, prefix_hash, slices, text_buffer, written

GRAM = 64
RUNS = "sample long, digest long, doc long, lo int, hi int, twice boolean"


def keys_of(total: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` neighbouring values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def runs(text: pa.Array, length: int):
    """Per run: text number, sample, digest, first and last window start, whether the sample occurs twice in it."""
    raw, ends = text_buffer(text)
    if len(raw) < length:
        return None
    total, down = prefix_hash(raw), powers(len(raw) + 1)[1]
    every = np.arange(len(raw) - GRAM + 1)
    gram = keys_of(total, down, every, every + GRAM)
    wide = length - GRAM + 1
    least = slide(gram, wide, np.minimum)
    start = np.arange(len(least))
    own = np.searchsorted(ends, start, "right") - 1
    good = start + length <= ends[own + 1]
    # Places that are the least of a window of their text, to see samples that occur twice close by.
    held = np.where(good, least, np.uint64(0))
    most = slide(np.concatenate([np.zeros(wide - 1, np.uint64), held, np.zeros(wide - 1, np.uint64)]), wide, np.maximum)
    place = np.flatnonzero(most == gram)
    near = (gram[place[1:]] == gram[place[:-1]]) & (np.diff(place) <= wide)
    double = np.unique(gram[place[1:][near]])
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    sample, doc = least[first], own[first]
    view, name = memoryview(raw), xxhash.xxh3_64_intdigest
    digest = np.array([name(view[s:e]) for s, e in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
    return doc, sample, digest, first - ends[doc], last - ends[doc], np.isin(sample, double)


def removed_bytes(docs: DataFrame, length: int = 200, buckets: int = 1) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    buckets: in how many parts the opened suffixes are sorted, one after the other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows are known by their id, or where some share one or have none, all by a hash of id and text.
    own = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()
    docs = docs.withColumn("doc", F.col("doc_id") if own else F.xxhash64("doc_id", "text"))

    def find(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = runs(part.column(1), length)
                if found is not None:
                    doc, sample, digest, lo, hi, twice = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sample.view(np.int64)), pa.array(digest.view(np.int64)), part.column(0).take(pa.array(doc)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(twice)],
                        [x.split()[0] for x in RUNS.split(", ")],
                    )

    made = written(docs.select("doc", "text").mapInArrow(find, RUNS), "runs")
    about = made.groupBy("sample").agg(F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.max("twice").alias("again"))
    about = about.filter("n > 1 OR again").select("sample", (F.col("again") | (F.col("d0") != F.col("d1"))).alias("mixed"))
    shared = written(made.join(about, "sample"), "shared")

    discard(made)
    # Runs of a sample and digest that occur again: every suffix in them is repeated.
    named = shared.filter("mixed").groupBy("sample", "digest").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.max("twice").alias("twice"))
    named = written(named, "named")
    tied = shared.filter("NOT mixed").select("doc", "lo", "hi").unionByName(shared.filter("mixed").join(named.filter("n > 1").select("sample", "digest"), ["sample", "digest"], "left_semi").select("doc", "lo", "hi"))

    # One run of each name is opened: the first in its document, for a document may hold it more often.
    chosen = shared.filter("mixed").join(named.select("sample", "digest", "doc"), ["sample", "digest", "doc"])
    chosen = chosen.groupBy("sample", "digest", "doc").agg(F.min(F.struct("lo", "hi")).alias("r")).select("sample", "doc", "r.lo", "r.hi")
    chosen = chosen.groupBy("doc").agg(F.collect_list(F.struct("sample", "lo", "hi")).alias("runs"))
    opened = written(docs.select("doc", "text").join(chosen, "doc").select("doc", "text", "runs"), "opened")
    loose = None
    for b in range(buckets):
        suffix = _suffixes(opened, length, b, buckets)
        again = suffix.groupBy("sample", "key").agg(F.count("*").alias("n")).filter("n > 1").select("sample", "key")
        found = suffix.join(again, ["sample", "key"]).groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("at"))
        found = written(found.mapInArrow(_stretches, "doc long, lo int, hi int"), "loose")
        loose = found if loose is None else loose.unionByName(found)

    spans = tied.unionByName(loose).groupBy("doc").agg(F.collect_list(F.struct("lo", F.col("hi") + length)).alias("spans"))
    rows = docs.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _suffixes(opened: DataFrame, length: int, bucket: int, buckets: int) -> DataFrame:
    """(sample, key of the first `length` bytes, doc, at) of the suffixes of the opened runs of one bucket of samples."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                raw, ends = text_buffer(part.column(1))
                total, down = prefix_hash(raw), powers(len(raw) + 1)[1]
                lists = part.column(2)
                flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), n)
                sample, lo, hi = (flat.field(k).to_numpy() for k in range(3))
                mine = (sample.astype(np.uint64) >> np.uint64(40)) % np.uint64(buckets) == bucket
                row, sample, lo, hi = row[mine], sample[mine], lo[mine].astype(np.int64), hi[mine].astype(np.int64)
                if not len(row):
                    continue
                size = hi - lo + 1
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                start = at + np.repeat(ends[row], size)
                key = keys_of(total, down, start, start + length)
                for k in range(0, len(at), 1 << 18):
                    s = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(sample, size)[s]), pa.array(key[s].view(np.int64)), part.column(0).take(pa.array(np.repeat(row, size)[s])), pa.array(at[s].astype(np.int32))], ["sample", "key", "doc", "at"]
                    )

    return opened.mapInArrow(run, "sample long, key long, doc long, at int")


def _stretches(batches):
    """Sorted places to stretches of neighbours."""
    for batch in batches:
        docs, lo, hi = [], [], []
        for doc, at in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at = at.values.to_numpy()
            edge = np.flatnonzero(np.diff(at) != 1)
            lo.append(at[np.concatenate([[0], edge + 1])])
            hi.append(at[np.concatenate([edge, [len(at) - 1]])])
            docs += [doc] * (len(edge) + 1)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32))], ["doc", "lo", "hi"])


def _cut(batches):
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            if spans.is_valid and len(spans.values):
                lo, hi = (spans.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.concatenate([[0], np.flatnonzero(lo[1:] > hi[:-1]) + 1])
                for s, e in zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True):
                    kept.update(raw[at:s])
                    removed, n, at = removed + e - s, n + 1, e
            kept.update(raw[at:])
            out.append((doc, len(raw), removed, n, kept.hexdigest()))
        if out:
            a, b, c, d, e = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, b, c, d)), pa.array(e)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
