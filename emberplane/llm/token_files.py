"""Token-id files: whole texts encoded, coded in segments of `idcoder`, written and read through Spark.

Documents are range-partitioned and sorted by id; each partition's ids are coded in segments of about
eight million ids (whole documents). The files are Parquet tables of (part, segment, n_ids, payload),
so that they can lie in any store that Spark writes; parts and segments ascend with the ids.

A null text is empty and has its end id only. Rows that share an id each have their own entry, in
any order among them; null ids come first and are stored as -2^63. Extra columns are ignored.
A very long text takes memory in proportion in one task. An empty table makes no segment.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices
from .idcoder import decode_segment, encode_segment
from .tokens import encoder

SEGMENT_IDS = 1 << 23
#: Bytes of text whose different pieces are encoded at once.
SLICE = 8 << 20
LOWEST = -(1 << 63)


def encoded(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """(part, segment, n_ids, payload) of docs(doc_id, text) in ascending id order."""

    def run(batches):
        coder, part_id = encoder(tokenizer, kind), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        ids, held, size, segment = [], [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part_id, pa.int64()), (segment, pa.int64()), (size, pa.int64()), (encode_segment(ids, held), pa.binary()))], ["part", "segment", "n_ids", "payload"])

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                new = part.column(0).to_pylist()
                for doc, own in zip(new, coder.encode(part.column(1)), strict=True):
                    ids.append(LOWEST if doc is None else doc)
                    held.append(own + end)
                    size += len(own) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield row()
                        ids, held, size, segment = [], [], 0, segment + 1
        if ids:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return laid.mapInArrow(run, "part long, segment long, n_ids long, payload binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int) -> None:
    encoded(docs, tokenizer, kind, end_id).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            docs, lengths, ids = decode_segment(batch.column(2)[row].as_py())
            raw, at, crcs, starts = memoryview(ids.tobytes()), 0, [], []
            for n in lengths.tolist():
                starts.append(at)
                crcs.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                at += n
            fixed = [pa.array([batch.column(k)[row].as_py()] * len(docs), pa.int64()) for k in (0, 1)]
            names = ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array([None if d == LOWEST else d for d in docs.tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, lengths.tolist(), crcs))], names)


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))  # a row per file
    inner = sizes.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    places = inner.join(before, "part").select("part", "segment", (F.col("inner") + F.col("part_start")).alias("base"))
    docs = files.select("part", "segment", "payload").mapInArrow(_decode, "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "segment"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
