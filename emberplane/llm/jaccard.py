"""N-gram Jaccard join: which documents share nearly the same set of word shingles.

Prefix filtering in rare-first order. Every set is put in one total order, rare shingles
first; two sets of Jaccard similarity t or more must then share a shingle among the first
n - ceil(t n) + 1 of each. Candidates are pairs that share such a prefix shingle and pass the
length and positional filters; each is verified once, first by the suffix filter and then by
the exact intersection.

* Rarity is counted over all shingles of all documents: each slice of documents sends its distinct
  shingles (32 bits of each in a bucket, with the count in the slice) to the buckets of hashes, which
  send back one byte of rarity each. A bucket has about 2^20 of them whatever the input, and a
  frequent shingle one entry per slice at most. Hashes that meet there cost candidates, never links.
* A shingle of one document only joins nothing, so it only moves the positions of the others; most
  documents have a whole prefix of such shingles and leave here.
* Equal texts travel once; documents with equal sets become one class before anything is joined.
* Positional filter: the shingle that a pair shares first, at places i and j, leaves
  min(a - i, b - j) shingles to share at most. A pair within the threshold passes at its first.
* Where a prefix shingle has k members, not all k^2 pairs are made. Each round takes leaders of each
  shingle, those whose place of it is first (a document that its copies vary has the fewest shingles
  of its own): one in the first round, then 32 times as many in each. Members are paired with leaders,
  links are joined into components, and pairs within one component need no test, as they could not
  change the result. A leader has then met all members and leaves; a shingle whose members are
  all in one component is settled. Rounds go on until no shingle is left.
* Pairs are verified by their shingle sets, never by their texts. Shingles are 64-bit hashes; two of
  the shingles of one pair collide with probability of about n^2 / 2^65.

Nulls, and texts without words, have an empty set and link with nothing (also not with each
other). Rows that share an id count as one document with the shingles that each row has; every
row is returned; a null id takes no part in links but by the class of an equal text. A very long
text costs memory for its own shingles (24 bytes a word) in one task. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, shingle_sets, text_lengths, written

SLICE_BYTES, BUCKET_SHINGLES, GROWTH = 4 << 20, 1 << 20, 32
U32 = np.uint64(32)


def sliced(docs: DataFrame) -> DataFrame:
    """(slice, ids, shas, texts) of docs(doc_id, sha, text): some SLICE_BYTES of text a row."""

    def run(batches):
        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            own = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(k).combine_chunks()) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([base + n]), *lists], ["slice", "ids", "shas", "texts"])

        for batch in batches:
            ends = np.cumsum(text_lengths(batch.column(2)) + 64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= SLICE_BYTES or at < batch.num_rows:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    return docs.select("doc_id", "sha", "text").mapInArrow(run, "slice long, ids array<long>, shas array<string>, texts array<string>")


def slice_sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Shingle sets of the documents of a slice, and all their shingles in order."""
    sets = shingle_sets(texts, n)
    return sets, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def rarity(slices: DataFrame, n: int) -> DataFrame:
    """(slice, bucket, codes): for the distinct shingles of a slice in one bucket, ascending, the rarity.
    Code 0: in one document only; else about 8 log2 of the number of documents."""
    total = slices.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.octet_length(t), F.lit(0)))).alias("n")).first()[0] or 0
    bits = max(6, int(total // 6 // BUCKET_SHINGLES).bit_length())  # words of six bytes and a space, or so
    down, low = np.uint64(64 - bits), np.uint64(0xFFFFFFFF)

    def spread(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shingle, count = np.unique(slice_sets(batch.column(1)[k].values, n)[1], return_counts=True)
                edge = np.searchsorted(shingle >> down, np.arange((1 << bits) + 1, dtype=np.uint64))
                key, count = ((shingle >> (down - U32)) & low).astype("<u4"), np.minimum(count, 65535).astype("<u2")
                own = np.flatnonzero(np.diff(edge))
                rows = [(key[edge[b] : edge[b + 1]].tobytes(), count[edge[b] : edge[b + 1]].tobytes()) for b in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["slice", "bucket", "keys", "counts"])

    def count(table: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("keys", "<u4"), ("counts", "<u2")))
        _, at = np.unique(keys, return_inverse=True)
        held = np.bincount(at, weights=counts)
        part, power = np.frexp(held)
        code = np.minimum(np.floor((part * 2 - 1) * 8) + (power - 1) * 8, 255).astype(np.uint8)[at].tobytes()
        ends = np.cumsum([len(x) // 4 for x in table.column("keys").to_pylist()]).tolist()
        return pa.table([table.column("slice"), table.column("bucket"), pa.array([code[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["slice", "bucket", "codes"])

    made = slices.select("slice", "texts").mapInArrow(spread, "slice long, bucket int, keys binary, counts binary")
    return made.groupBy("bucket").applyInArrow(count, "slice long, bucket int, codes binary")


def prefixes(slices: DataFrame, codes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document: sha, id, n (set size); and of those that others may link with k1, k2 (digest of the
    set), the set, and the shingles of its prefix that others have too (toks), with their places (poss)."""
    names = ["sha", "id", "n", "k1", "k2", "shingles", "toks", "poss"]

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        code = np.frombuffer(b"".join(right.sort_by("bucket").column("codes").to_pylist()), np.uint8)
        for row in range(left.num_rows):
            own = {c: left.column(c)[row].values for c in ("ids", "shas", "texts")}
            sets, flat = slice_sets(own["texts"], n)
            _, at = np.unique(flat, return_inverse=True)
            common = code[at] if len(flat) else code
            end = 0
            for sha, doc, s in zip(own["shas"].to_pylist(), own["ids"].to_pylist(), sets, strict=True):
                mine, end = common[end : end + len(s)], end + len(s)
                most, known = len(s) - (num * len(s) + den - 1) // den + 1, np.flatnonzero(mine)
                alone = len(s) - len(known)
                if not len(s) or alone >= most or doc is None:
                    out.append((sha, doc, len(s), None, None, None, None, None))
                    continue
                order = known[np.lexsort((s[known], mine[known]))][: most - alone]
                k1, k2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
                out.append((sha, doc, len(s), k1, k2, s.astype("<u8").tobytes(), s[order].view(np.int64), np.arange(alone, alone + len(order))))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)

    both = slices.groupBy("slice").cogroup(codes.groupBy("slice"))
    return both.applyInArrow(build, "sha string, id long, n long, k1 long, k2 long, shingles binary, toks array<long>, poss array<long>")


def may_link(num: int, den: int) -> Column:
    """Length and positional bounds for a posting and a leader (columns with l_)."""
    a, b = F.col("l_n"), F.col("n")
    overlap = F.least(a - F.col("l_pos"), b - F.col("pos"))
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (overlap * (num + den) >= (a + b) * num)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Lower bound of the size of the symmetric difference: split both at a pivot and compare sizes."""
    if depth == 0 or len(x) == 0 or len(y) == 0:
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if suffix_bound(x, y, 3) > (len(x) + len(y)) * (den - num) // (den + num):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) of components (u, v) those whose similarity reaches num / den, by their whole sets."""

    def test(batches):
        for batch in batches:
            hold = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(hold, pa.bool_()))

    side = {x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("u", "v", "sa", "sb").mapInArrow(test, "u long, v long")


def linked(known: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Components of the classes known(id, n, toks, poss, shingles), round by round: (node, component) tables, each
    of which sends components of the rounds before it (at first: ids) to what they have grown to."""
    posting = known.select("id", "n", F.explode(F.arrays_zip("toks", "poss")).alias("p")).select("id", "n", F.col("p.toks").alias("tok"), F.col("p.poss").alias("pos"))
    shared = posting.groupBy("tok").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("tok")
    open_ = written(posting.join(shared, "tok").withColumn("comp", F.col("id")), "open")
    sets = written(known.select("id", "shingles").join(open_.select("id").distinct(), "id", "left_semi"), "sets")

    cols, fits, grown = ["id", "n", "pos", "comp"], may_link(num, den), []
    tested, done = None, []
    while not open_.isEmpty():
        turn = len(grown)
        seat = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(GROWTH**turn))
        first = F.col("pos") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
        lead = open_.withColumn("first", first).groupBy("tok", seat.alias("seat")).agg(*(F.min_by(x, "first").alias(f"l_{x}") for x in cols)).drop("seat")
        pairs = open_.join(lead, "tok").filter((F.col("l_comp") != F.col("comp")) & fits)
        ids, comps = ("l_id", "id"), ("l_comp", "comp")
        pairs = pairs.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b"), F.least(*comps).alias("u"), F.greatest(*comps).alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        done.append(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = written(verified(pairs, sets, num, den).distinct(), "links")
        grown.append(components(found, "u", "v"))
        discard(found)
        # Leaders have met all members; what is left counts while its members lie in several components.
        now = open_.join(lead.select("tok", F.col("l_id").alias("id")), ["tok", "id"], "left_anti")
        now = now.join(grown[-1].withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
        mixed = now.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
        was, open_ = open_, written(now.join(mixed, "tok", "left_semi"), "open")
        discard(was)
    discard(open_, sets, *done)
    return grown


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, class_id (least id with an equal set),
    component_id (least id reachable by links of similarity num / den or more, itself included)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    own = written(docs.select("doc_id", "sha"), "own")
    again = own.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1")
    again = own.join(again, "sha").filter("doc_id <> least").select("doc_id", "sha")
    slices = written(sliced(docs.join(again, ["doc_id", "sha"], "left_anti")), "slices")
    codes = written(rarity(slices, n), "rarity")
    made = written(prefixes(slices, codes, n, num, den), "prefixes")
    discard(slices, codes)

    # Rows that share id and text, or null ids, may still be there twice: a class has one of them.
    first = made.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    known = made.filter("k1 IS NOT NULL").join(first, ["k1", "k2"]).filter("id = rep").dropDuplicates(["id", "k1", "k2"])
    known = written(known.select("id", "n", "toks", "poss", "shingles"), "classes")
    grown = linked(known, num, den)
    discard(known)

    about = made.groupBy("sha").agg(F.max("n").alias("n_shingles"), F.min("id").alias("id"), F.max("k1").alias("k1"), F.max("k2").alias("k2"))
    about = about.join(first, ["k1", "k2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    about = about.withColumn("comp", F.col("rep"))
    for step in grown:
        about = about.join(step.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
    # An empty set links with nothing: each such row is its own class.
    about = written(about.select("sha", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"), F.when(F.col("n_shingles") > 0, F.col("comp")).alias("comp")), "about")
    discard(made, *grown)
    own = own.join(about, "sha")  # both sides dealt anew, so that the copies of one text can be split
    return own.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))


MEET = 1024


def candidates(known: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): all pairs of classes known(id, n, toks, poss) that share a prefix shingle within the bounds, each once.

    A shingle's members are dealt to blocks of about MEET; every two blocks of a shingle meet in a key of their own, so
    that a frequent shingle is many small joins and no hot one."""
    posting = known.select("id", "n", F.explode(F.arrays_zip("toks", "poss")).alias("p")).select("id", "n", F.col("p.toks").alias("tok"), F.col("p.poss").alias("pos"))
    sizes = posting.groupBy("tok").agg(F.count("*").alias("k")).filter("k > 1").select("tok", F.ceil(F.col("k") / MEET).cast("int").alias("blocks"))
    own = posting.join(sizes, "tok").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")
    left = dealt.filter("own = x").select("tok", "x", "y", *(F.col(c).alias(f"l_{c}") for c in ("id", "n", "pos")))
    both = left.join(dealt.filter("own = y"), ["tok", "x", "y"]).filter(((F.col("x") < F.col("y")) | (F.col("l_id") < F.col("id"))) & may_link(num, den))
    return both.select(F.least("l_id", "id").alias("a"), F.greatest("l_id", "id").alias("b")).distinct()


def ngram_jaccard_pairs(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of docs(doc_id, text): each row's doc_id, n_shingles and class_id (least id with an equal set), and every pair
    (a, b) of class ids whose sets reach the similarity, with `shared`, how many shingles they have in common, n_a and n_b.

    As ngram_jaccard_join, but all pairs of different sets are tested, also within a component; copies are not paired with
    each other, as their class says it. Rows that share an id but not the text, and null ids, are members of their text's class."""
    members = written(ngram_classes(docs, n), "members")
    least = members.filter("doc_id = class_id").dropDuplicates(["class_id"]).select(F.col("class_id").alias("doc_id"), "text")
    slices = written(sliced(least.withColumn("sha", F.sha2("text", 256))), "slices")
    codes = written(rarity(slices, n), "rarity")
    known = written(prefixes(slices, codes, n, num, den).filter("k1 IS NOT NULL").select("id", "n", "toks", "poss", "shingles"), "classes")
    discard(slices, codes)

    def test(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "sa", "sb")), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if similar(x, y, num, den):
                    rows.append((a.as_py(), b.as_py(), len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            names = ["a", "b", "shared", "n_a", "n_b"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names)

    pairs = written(candidates(known, num, den), "pairs")
    side = {x: known.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"}
    found = written(pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long, shared long, n_a long, n_b long"), "links")
    discard(known, pairs)
    return members.drop("text"), found


def ngram_classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, n_shingles, class_id): rows with equal non-empty sets have one class, the least of their ids; others their own id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def digest(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), n)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "text", "n_shingles", "set_key"])

    made = written(docs.mapInArrow(digest, "doc_id long, text string, n_shingles long, set_key binary"), "sets")
    least = written(made.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "least")
    return made.join(least, "set_key", "left").select("doc_id", "text", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, n_links): with how many other rows each row of `members` is linked, the copies of its class included."""
    sizes = members.filter("n_shingles > 0").groupBy("class_id").agg(F.count("*").alias("size"))
    ends = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("to")))
    reach = ends.join(sizes.withColumnsRenamed({"class_id": "to"}), "to").groupBy("class_id").agg(F.sum("size").alias("others"))
    total = sizes.join(reach, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked_rows = members.filter("n_shingles > 0").join(total, "class_id").select("doc_id", "n_links")
    return linked_rows.unionByName(members.filter("n_shingles = 0").select("doc_id", F.lit(0).cast("long").alias("n_links")))
