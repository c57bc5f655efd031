"""Cost-balanced packing of token ids into sequences.

A sequence costs its length plus, for each piece in it, the square of the piece's length over
the capacity (attention stays within a piece). Documents are packed in blocks of about two
million ids as Spark's tasks read them, so nothing is shuffled and a block's memory is bounded.
In a block, each document first gives its full sequences; the remainders, in descending
length, go to the lowest-cost sequence with room. The sequences hold exactly what the block has:
what finds no room whole is cut into the gaps, and the last few hundred ids fill sequences whose
lengths are powers of two. So no sequence needs padding.

A null text is empty and still has its end id. Rows that share an id are packed each for itself.
Sequence ids are unique (task number and counter) and, for the same input files and read
settings, the same on every run. A very long text takes memory in proportion in one task. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

BLOCK_IDS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one block, and the number of sequences."""
    out, used = [], 0
    whole = lengths // capacity
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            out.append((d, k * capacity, capacity, used, 0))
            used += 1
    left = lengths - whole * capacity
    full, tail = divmod(int(left.sum()), capacity)
    caps = [capacity] * full + [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    room, fill, cost = np.array(caps, np.int64), np.zeros(len(caps), np.int64), np.zeros(len(caps))
    order = np.argsort(-left, kind="stable")
    later = []

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, used + s, int(fill[s])))
        fill[s] += n
        room[s] -= n
        cost[s] += n + n * n / capacity

    for d in order.tolist():
        n = int(left[d])
        if not n:
            break
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(d, int(whole[d]) * capacity, n, int(fits[np.argmin(cost[fits])]))
        else:
            later.append(d)
    gaps = iter(np.flatnonzero(room)[np.argsort(cost[room > 0], kind="stable")].tolist())
    s = next(gaps, None)
    for d in later:
        start, n = int(whole[d]) * capacity, int(left[d])
        while n:
            if not room[s]:
                s = next(gaps)
                continue
            k = min(n, int(room[s]))
            put(d, start, k, s)
            start, n = start + k, n - k
    return out, used + len(caps)


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """One row per piece of docs(doc_id, text): where in its document and in which sequence it lies."""

    def run(batches):
        coder, base = encoder(tokenizer, kind), TaskContext.get().partitionId() << 32
        ids, held, ends, total, sequence = [], [], [], 0, 0

        def block():
            nonlocal sequence
            lengths, tokens = np.concatenate(ends), memoryview(np.concatenate(held)).cast("B")
            first = (np.cumsum(lengths) - lengths).tolist()
            pieces, n = pack_block(lengths, capacity)
            rows = [(ids[d], at, k, zlib.crc32(tokens[4 * (first[d] + at) : 4 * (first[d] + at + k)]), int(lengths[d]), base + sequence + s, off) for d, at, k, s, off in pieces]
            sequence += n
            for x in (ids, held, ends):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                own, at = coder.encode_array(part.column(1))
                held.append(np.insert(own, at[1:], end_id).astype("<u4"))
                ends.append(np.diff(at) + 1)
                ids += part.column(0).to_pylist()
                total += len(held[-1])
                if total >= BLOCK_IDS:
                    yield block()
                    total = 0
        if held:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
