"""Source divergence audit on run-length columns: how far apart the term use of a language's sources is.

Terms are counted per (lang, source) in each task before anything is shuffled; a language keeps the terms of
at least `least_docs` of its documents. Each kept term has a sparse vector of its counts by source. The
vocabulary of a language is numbered in the order of these vectors, so that equal counts of a source lie
together, and cut into blocks of `block` terms. In a block each source is one column of runs of equal counts
(absent terms are runs of 0). A pair of sources intersects its run boundaries, and each segment gives f times
its length; the sums over blocks are the pair's divergence.

A task holds one block of the columns, whatever the size of a source; the pairs are those of the report itself.
Probabilities and f are whole numbers: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).

A null text, lang or source counts as ''. A group whose documents have no kept term has counts of 0 and is
reported like any other; a language without kept terms gives pairs of value 0 and no terms. A lone source has
no pairs. Ties in value are ranked by the UTF-8 order of the item. Repeated rows and ids count as documents of
their own (ids are not read). A very long text is counted in pieces of PIECE bytes. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from .common import slices, written

SCALE, BLOCK = 10**9, 1 << 14
PIECE, HELD = 4 << 20, 1 << 19
#: Bytes of terms stay (A-Z lower-cased), all other ASCII becomes a space.
TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(raw: bytes):
    """The terms of translated bytes, list by list; no term is cut."""
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def _count(batches):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for part in slices(batch, 2):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in pieces(text.encode("utf-8", "surrogatepass").translate(TERM)):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n) - before
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact at any count."""
    up = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + 2 * terms).cast("decimal(20,0)")) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def encoded(counts: np.ndarray, total: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Run starts of a column of counts, and each run's probability."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1])
    return starts, np.array([1 + SCALE * (c + 2) // (total + 2 * terms) for c in counts[starts].tolist()], np.int64)


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """The sum of f over two run-length columns: each segment between boundaries of either counts by its length."""
    cuts = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], cuts, "right") - 1] for x in (a, b))
    return int(((p - q) ** 2 // (p + q) * np.diff(cuts, append=size)).sum())


def block_pairs(key, cells: pa.Table, groups: pa.Table, width: int) -> pa.Table:
    """Partial sums of all pairs of a language's sources over one block of its vocabulary."""
    lang, block = (k.as_py() for k in key)
    at, source, n = (cells.column(c).to_numpy() for c in ("place", "source_id", "n"))
    own = np.argsort(source, kind="stable")
    ids = np.array(sorted(groups.column("source_id").to_pylist()))
    ends = np.searchsorted(source[own], ids, "left"), np.searchsorted(source[own], ids, "right")
    total = dict(zip(*(groups.column(c).to_pylist() for c in ("source_id", "total")), strict=True))
    terms = groups.column("terms")[0].as_py() if len(ids) else 0
    size = min(width, terms - block * width)
    columns = []
    for k, lo, hi in zip(ids.tolist(), *ends, strict=True):
        counts = np.zeros(max(size, 1), np.int64)
        counts[at[own[lo:hi]] - block * width] = n[own[lo:hi]]
        columns.append(encoded(counts, total[k], terms) if size > 0 else None)
    a, b = np.triu_indices(len(ids), 1)
    values = [apart(columns[x], columns[y], size) if size > 0 else 0 for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(ids[a], pa.int32()), "b": pa.array(ids[b], pa.int32()), "value": pa.array(values, pa.int64())})


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source): pairs of sources, and each source's most over-used terms."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))  # a cell per source of the language
    placed = files.numbered(kept.filter(F.col("docs") >= least_docs).drop("docs"), ["lang"], ["cells", "term"], "place")
    cells = placed.select("lang", "term", "all", "place", F.explode("cells").alias("c")).select("lang", "term", "all", "place", "c.source", "c.n")

    by_lang = placed.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    groups = docs.select(*named).distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.withColumn("source_id", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).fillna(0, ["total", "terms", "lang_total"])  # a row per source
    groups = written(groups, "groups")  # read four times

    found = cells.join(groups.drop("source_id"), ["lang", "source"])
    found = found.withColumns({"p": probability(F.col("n"), F.col("total"), F.col("terms")), "q": probability(F.col("all"), F.col("lang_total"), F.col("terms"))}).filter("p > q")
    terms = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))

    blocks = groups.select("lang", "source_id", "total", "terms", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("terms") / block).cast("int") - 1))).alias("block"))
    runs = cells.join(groups.select("lang", "source", "source_id"), ["lang", "source"]).select("lang", F.floor(F.col("place") / block).cast("int").alias("block"), "place", F.col("source_id").alias("source_id"), "n")
    sums = runs.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(lambda key, x, y: block_pairs(key, x, y, block), "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda key, to: groups.select("lang", F.col("source_id").alias(key), F.col("source").alias(to))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
