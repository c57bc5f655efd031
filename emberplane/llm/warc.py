"""WARC archives of pages, and their capture history by an external merge of sorted index runs.

Writing: of equal payloads (by SHA-256; at least `least_bytes` long) the one with the largest page_id is stored as a
`response`, the others as `revisit` records that refer to it. A record is one row of Spark's text writer, whose line
separator is the end of a WARC record, so archives lie wherever Spark can write. Pages are dealt by id and payload to
archives of about `archive_bytes`, so equal payloads do not meet in one task. Archives are compressed as a whole (Spark's
writer makes one gzip member per file, not one per record); offsets and lengths count the plain bytes, and without
compression they cut records out of the files.

Reading: each archive is parsed by its Content-Length fields, every stored payload is measured and its digest checked
(a difference is an error), and the archive's captures are sorted by URL key and time: one run per archive. The runs are
cut at common keys (a range shuffle on the whole key, which splits even one URL with many captures); each task merges the
slices of its range, one per run, by a loser tree, so log2(k) comparisons per capture. Their order over all ranges is the
capture history: `place` counts it from 0 by URL key, time, page_id, archive and offset.

A null html is an empty payload. A null or empty url becomes `urn:page:<page_id>`; blanks and line ends in one are percent-encoded.
A row without page_id is always a response, as nothing could refer to it; rows that repeat the largest page_id of a payload
are each a response. Ties in URL and time follow page_id (nulls first). A payload takes memory in proportion in one task, an
archive must stay under 2 GB. Other columns are ignored, whatever their names; an empty table gives an empty history.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, written

ARCHIVE_BYTES, RANGE = 32 << 20, 200_000
CRLF, GZIP = "\r\n", b"\x1f\x8b"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)([^?#]*)(\?[^#]*)?", re.S)
CAPTURE = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits make four characters."""

    def char(h: Column, i: Column) -> Column:
        five = F.conv(F.substring(h, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(BASE32), F.floor(five / F.pow(F.lit(32), 3 - i % 4)).cast("int") % 32 + 1, F.lit(1))

    # The array of one binds the digest to a name, so that it is computed once and not once per character.
    return F.transform(F.array(F.sha1(payload)), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: char(h, i)), ""))[0]


def crawl_time(page_id: Column) -> Column:
    """A time for tables that have none: ids are seconds of the crawl."""
    return F.timestamp_add("SECOND", F.coalesce(page_id, F.lit(0)) % (1 << 30), F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'"))


def record(captured: Column) -> Column:
    """The text of a record of (page_id, url, payload, refers_to), without the line ends that close it."""
    lines = lambda *x: F.concat(*(part if isinstance(part, Column) else F.lit(part) for part in x))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("urn:page:"), page))
    for sign in "\r\n\t ":
        url = F.replace(url, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    again = F.col("refers_to").isNotNull()
    http = lines(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ", F.octet_length("payload").cast("string"), CRLF * 2)
    body = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    refers = F.when(again, lines(f"WARC-Profile: {REVISIT}{CRLF}WARC-Refers-To: <urn:page:", F.col("refers_to").cast("string"), f">{CRLF}")).otherwise(F.lit(""))
    head = lines(
        f"WARC/1.1{CRLF}WARC-Type: ", F.when(again, F.lit("revisit")).otherwise(F.lit("response")), f"{CRLF}WARC-Record-ID: <urn:page:", page, f">{CRLF}WARC-Date: ", F.replace(captured.cast("string"), F.lit(" "), F.lit("T")),
        f"Z{CRLF}WARC-Target-URI: ", url, f"{CRLF}WARC-Payload-Digest: sha1:", sha1_base32(F.col("payload")), CRLF, refers, f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: ",
    )
    return F.transform(F.array(body), lambda b: F.concat(head, F.octet_length(b).cast("string"), F.lit(CRLF * 2), b))[0]


def write_archives(pages: DataFrame, path: str, captured: Column | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Archives of pages(page_id, url, html) under `path`. `captured` is a TIMESTAMP_NTZ in UTC of the columns of `pages`."""
    time = crawl_time(F.col("page_id").cast("long")) if captured is None else captured
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), time.alias("captured"))
    held = held.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    keys = written(held.select("page_id", "sha", F.octet_length("payload").alias("bytes")), "payloads")
    # The largest id per payload combines before the shuffle; only ids and digests move to find who refers to it.
    same = keys.filter(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes))
    best = written(same.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "largest")
    refers = same.join(best, "sha").filter("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()

    total = keys.agg(F.sum("bytes")).first()[0] or 0
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    dealt = held.repartition(n, "page_id", "sha").join(refers, ["page_id", "sha"], "left")
    dealt.select(record(F.col("captured")).alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
    discard(keys, best)


def url_key(url: str) -> str:
    """Host reversed, without www and default ports, then path and sorted query: pages of a site lie together."""
    host, path, query = URL.match(url).groups()
    host = re.sub(r"^www\d*\.", "", re.sub(r":(80|443)$", "", host.rpartition("@")[2].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    return ",".join(reversed(host.split("."))) + ")" + (path or "/") + ("?" + "&".join(sorted(query[1:].split("&"))) if query else "")


def captures(data: bytes, archive: str) -> Iterator[tuple]:
    """The captures of one archive, in its order; a broken record or a payload unlike its digest is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split(CRLF) if end >= 0 else [""]
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields.get("Content-Length", -1))
        stop = end + 4 + size
        if lines[0] != "WARC/1.1" or size < 0 or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: no record at {at}")
        http = data.find(b"\r\n\r\n", end + 4, stop) + 4
        n = int(re.search(rb"\r\nContent-Length: (\d+)", data[end + 4 : http])[1])
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response" and (stop - http != n or base64.b32encode(hashlib.sha1(memoryview(data)[http:stop]).digest()).decode() != digest):
            raise ValueError(f"{archive}: the payload at {at} differs from its digest")
        page, other = (fields.get(f, "").removeprefix("<urn:page:").removesuffix(">") for f in ("WARC-Record-ID", "WARC-Refers-To"))
        url = fields["WARC-Target-URI"]
        yield url_key(url), fields["WARC-Date"], int(page) if page else None, url, kind, int(other) if other else None, n, digest, archive, at, stop + 4 - at
        at = stop + 4


def order(row: tuple) -> tuple:
    """Where a capture lies in the history."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _runs(batches):
    schema = [f.split(" ") for f in CAPTURE.split(", ")]
    for batch in batches:
        for path, content in zip(*(batch.column(c) for c in ("path", "content")), strict=True):
            name = path.as_py().rpartition("/")[2]
            raw = content.as_buffer().to_pybytes()
            run = sorted(captures(gzip.decompress(raw) if raw[:2] == GZIP else raw, name), key=order)
            columns = [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(zip(*run, strict=True), schema, strict=True)] if run else []
            if run:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(run)))], [*(f for f, _ in schema), "seq"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under `path`, each archive's a run in the order of its `seq`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_runs, CAPTURE + ", seq long")


def merge(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, index) of all keys of sorted runs in order. Inner nodes of the tree hold the loser of their match; after the
    winner has left, its successor plays only against the losers on its way up."""
    k = len(runs)
    at, heads = [0] * k, [(0, *r[0]) if r else (1,) for r in runs]
    won, lost = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], lost[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = won[1] if k > 1 else 0
    while k and heads[best][0] == 0:
        yield best, at[best]
        at[best] += 1
        heads[best] = (0, *runs[best][at[best]]) if at[best] < len(runs[best]) else (1,)
        node = (best + k) // 2
        while node:
            if heads[lost[node]] < heads[best]:
                best, lost[node] = lost[node], best
            node //= 2


def _merge(batches):
    """One range: the slices of its runs, each in the order of `seq`, merged by their keys."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    run = np.unique(table.column("archive").to_numpy(), return_inverse=True)[1]
    rows = np.lexsort((table.column("seq").to_numpy(), run))
    names = [f.split(" ")[0] for f in CAPTURE.split(", ")]
    keys = [order(r) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True)]
    slices = [s.tolist() for s in np.split(rows, np.flatnonzero(np.diff(run[rows])) + 1)]
    merged = [slices[r][i] for r, i in merge([[keys[x] for x in s] for s in slices])]
    out = table.select(names).take(pa.array(merged))
    out = out.append_column("part_", pa.array([TaskContext.get().partitionId()] * len(merged), pa.int32())).append_column("local_", pa.array(range(len(merged)), pa.int64()))
    yield from out.to_batches(max_chunksize=10_000)


def capture_history(runs: DataFrame, most: int = RANGE) -> DataFrame:
    """The captures of sorted runs with `place`, their position in the order of URL key and time over all archives."""
    runs = written(runs, "runs")
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // most))
    ranges = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "offset")
    merged = written(ranges.mapInArrow(_merge, CAPTURE + ", part_ int, local_ long"), "history")
    sizes = merged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # a row per range
    out = merged.join(before, "part_").withColumn("place", F.col("before_") + F.col("local_")).drop("part_", "local_", "before_")
    discard(runs)
    return out
