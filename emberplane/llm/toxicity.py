"""Toxicity by class-conditional Kneser-Ney models.

Two models of byte sequences, of toxic and of ordinary texts, score every text. The difference of
the two log-likelihoods is normalised by length twice: over the whole text (by the square root of
its length) and over each run of one of `WINDOWS` bytes, of which the highest counts, so that one
expression shows in a long text. The score is a logistic function of both and of the log of the
length (a longer text has higher runs by chance). Bytes rather than words, so that compounds and inflections of an expression
share its counts. Each model predicts a byte from the five before it, with absolute discounts;
it backs off to continuation counts (in how many different longer contexts the byte followed
the last two), and these to counts that both models share, of all documents. A rare
expression, whose counts the discounts use up, gets the shared probability from both models.

Bounds of the fit: `per_class` training rows and `class_bytes` bytes of text of each class at most (in
expectation; chosen by a hash of the id; a row of over a sixteenth of that is not learned from) and
2^18 hashed cells of shared counts. Every run of bytes of these rows keeps its
own counts, single ones too, and the discounts alone decide what backs off; the table that is
broadcast thus grows with the text of the training rows, by 24 to 48 bytes per distinct run (40 to
80 while the discount is chosen). One fifth of the training rows is kept out of the counts; it chooses the
discount and the length of the runs, by the least loss, and fits the logistic function.

All texts are scored whole, whatever their length; a very long one takes memory in proportion in
one task. An empty table gives an empty result.

Null texts and those under six bytes have differences of zero. Without rows of both classes
every score is 0. Rows that share an id are scored each for itself; a document with several
labels is trained on each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, slices, text_buffer, written

ORDER = 6
CELL_BITS = 18
DISCOUNTS = (0.25, 0.75, 1.5)
WINDOWS = (8, 12, 20, 32)


def sequences(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of six bytes of the buffer as integers, and where each text's begin and end."""
    raw, ends = text_buffer(text)
    low = LOWER[raw].astype(np.int64)
    n = max(0, len(low) - ORDER + 1)
    key = np.zeros(n, np.int64)
    for k in range(ORDER):
        key = (key << 8) | low[k : k + n]
    starts = np.minimum(ends[:-1], n)
    return key, starts, np.maximum(np.minimum(ends[1:] - ORDER + 1, n), starts)


def inside(key: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which runs lie within one text."""
    step = np.zeros(len(key) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:-1]) > 0


def cell(three: np.ndarray) -> np.ndarray:
    return (mix(three.astype(np.uint64)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def shared_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all documents: counts of three bytes by hashed cell, and of two bytes."""

    def count(batches):
        total = np.zeros((1 << CELL_BITS) + (1 << 16), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                key, s, e = sequences(part.column(0))
                three = key[inside(key, s, e)] & 0xFFFFFF
                total[: 1 << CELL_BITS] += np.bincount(cell(three), minlength=1 << CELL_BITS)
                total[1 << CELL_BITS :] += np.bincount(three >> 8, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    got = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << CELL_BITS) + (1 << 16))
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out[: 1 << CELL_BITS], out[1 << CELL_BITS :]


def sequence_counts(rows: DataFrame) -> DataFrame:
    """(key, n0, n1) of rows(toxic, text): how often ordinary and toxic texts have the six bytes."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                key, s, e = sequences(part.column(1))
                toxic = np.repeat(part.column(0).to_numpy(zero_copy_only=False), e - s)
                found, again = np.unique(key[inside(key, s, e)], return_inverse=True)
                n = [np.bincount(again[toxic == c], minlength=len(found)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, n)], ["key", "n0", "n1"])

    return rows.mapInArrow(count, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Places:
    """Where each of some distinct integer keys has its place in a table."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.zeros(len(keys), np.int64)
        self.tries, left = 0, np.arange(len(keys))
        while len(left):
            at = self._place(keys[left], self.tries)
            self.tries += 1
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            done = np.flatnonzero(free)[first]
            self.keys[at[done]], self.at[left[done]] = keys[left[done]], at[done]
            left = np.delete(left, done)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "at"}

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((mix(keys.astype(np.uint64)) >> self.shift).astype(np.int64) + k) & self.mask


class Lookup:
    """Integer keys to one value each; absent keys give 0."""

    def __init__(self, places: Places, values: np.ndarray):
        self.places, self.values = places, np.zeros(len(places.keys), np.float32)
        self.values[places.at] = values

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.places._place(keys, 0)
        seen = self.places.keys[at]
        hit = seen == keys
        out = np.where(hit, self.values[at], 0.0)
        left = np.flatnonzero(~hit & (seen != -1))
        for k in range(1, self.places.tries):
            if not len(left):
                break
            at = self.places._place(keys[left], k)
            seen = self.places.keys[at]
            good = seen == keys[left]
            out[left[good]], hit[left[good]] = self.values[at[good]], True
            left = left[~good & (seen != -1)]
        return out, hit


class Model:
    """The difference of the two log-probabilities of a byte: of known runs of six bytes as a whole,
    of others as the sum of what their first five and their last three bytes give."""

    def __init__(self, six, five, three, two, shared, places: list[Places], d: float, which: int):
        def found(t, keys, names):  # of a table sorted by its keys
            if not len(t["key"]):
                return [np.zeros(len(keys)) for _ in names]
            at = np.minimum(np.searchsorted(t["key"], keys), len(t["key"]) - 1)
            ok = t["key"][at] == keys
            return [np.where(ok, t[n][at], 0.0) for n in names]

        def freed(t, keys):  # per class: the context's count, and how much of it is free
            n0, f0, n1, f1 = found(t, keys, ("n0", f"f{which}_0", "n1", f"f{which}_1"))
            return [(n0, f0), (n1, f1)]

        def level(keys, counts, above, low):
            out = []
            for c in (0, 1):
                n, free = above[c]
                own = np.maximum(counts[c] - d, 0) if counts is not None else 0
                out.append(np.where(n > 0, (own + free * low[c]) / np.maximum(n, 1), low[c]))
            return out

        def share(keys):
            p = (shared[0][cell(keys)] + 0.5) / (shared[1][keys >> 8] + 128)
            return [np.minimum(p, 1.0)] * 2

        def lows(keys):  # probability by the last three bytes
            return level(keys, found(three, keys, ("n0", "n1")), freed(two, keys >> 8), share(keys))

        def lookup(table, places, p):  # by parts, as a table may be long
            keys, out = table["key"], np.zeros(len(table["key"]))
            for k in range(0, len(keys), 1 << 18):
                own = slice(k, k + (1 << 18))
                a, b = p(keys[own], (table["n0"][own], table["n1"][own]))
                out[own] = np.log(np.maximum(b, 1e-12)) - np.log(np.maximum(a, 1e-12))
            return Lookup(places, out)

        self.six = lookup(six, places[0], lambda keys, n: level(keys, n, freed(five, keys >> 8), lows(keys & 0xFFFFFF)))
        self.five = lookup(five, places[1], lambda keys, n: level(keys, None, freed(five, keys), [1.0, 1.0]))
        self.three = lookup(three, places[2], lambda keys, n: lows(keys))

    def differences(self, text: pa.Array, windows: tuple[int, ...] = WINDOWS) -> np.ndarray:
        """Per text: the difference over the root of its length, log length, the highest mean of a run of each length."""
        key, s, e = sequences(text)
        gain, hit = self.six.get(key)
        miss = np.flatnonzero(~hit)
        gain[miss] = self.five.get(key[miss] >> 8)[0] + self.three.get(key[miss] & 0xFFFFFF)[0]
        total = np.concatenate([[0.0], np.cumsum(gain)])
        n = e - s
        whole = (total[e] - total[s]) / np.sqrt(np.maximum(n, 1))
        tops = []
        for window in windows:
            top = whole / np.sqrt(np.maximum(n, 1))  # of texts shorter than a run
            long = np.flatnonzero(n > window)
            if len(long):
                run = (total[window:] - total[:-window]) / window
                edges = np.stack([s[long], e[long] - window + 1], 1).ravel()
                top[long] = np.maximum.reduceat(np.append(run, -np.inf), edges)[::2]
            tops.append(top)
        return np.stack([whole, np.log1p(n), *tops], 1)


def fit(docs: DataFrame, labelled: DataFrame) -> list[Model] | None:
    def pulled(df):
        t = df.toArrow().sort_by("key")
        return {c: t[c].to_numpy() for c in t.column_names}

    def contexts(counts):
        free = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(d))).cast("float").alias(f"f{k}_{c}") for k, d in enumerate(DISCOUNTS) for c in (0, 1)]
        return counts.groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"), *free)

    six = written(sequence_counts(labelled.select("toxic", "text")).withColumns({c: F.col(c).cast("int") for c in ("n0", "n1")}), "six")
    three = written(six.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(*(F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).cast("int").alias(f"n{c}") for c in (0, 1))), "three")
    total = six.agg(F.sum("n0"), F.sum("n1")).first()
    if not total[0] or not total[1]:
        return None
    tables = [pulled(six), pulled(contexts(six)), pulled(three), pulled(contexts(three))]
    places = [Places(t["key"]) for t in tables[:3]]
    shared = shared_counts(docs)
    return [Model(*tables, shared, places, d, k) for k, d in enumerate(DISCOUNTS)]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (the last is the offset) by Newton's method, with a small ridge, and the loss.
    The two differences never count against toxicity: a weight below zero is dropped."""
    w = np.zeros(x.shape[1] + 1)
    if not len(x) or y.min() == y.max():
        w[1] = 1.0
        return w, 0.0
    scale = x.std(0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - x.mean(0)) / scale, np.ones(len(x))])
    used = np.ones(z.shape[1], bool)
    while True:
        part, v = z[:, used], np.zeros(used.sum())
        ridge = np.append(np.ones(len(v) - 1), 1e-3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(ridge), part.T @ (y - p) - ridge * v)
            v += step
            if abs(step).max() < 1e-8:
                break
        full = np.zeros(z.shape[1])
        full[used] = v
        wrong = np.flatnonzero(full[:2] < 0)
        if not len(wrong):
            break
        used[wrong] = False
    margin = np.clip(z @ full, -30, 30)
    w[:-1] = full[:-1] / scale
    w[-1] = full[-1] - (w[:-1] * x.mean(0)).sum()
    return w, float(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean())


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 10_000, class_bytes: int = 64 << 20) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, score. labels(doc_id, toxic) of rows where `train` holds are learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(train & F.col("toxic").isin(0, 1))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    pick, share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)), {c: min(1.0, per_class / n) for c, n in sizes.items()}
    known = known.filter(pick < F.when(F.col("toxic") == 1, int(1_000_000 * share[1])).otherwise(int(1_000_000 * share[0])))
    # Two times `per_class` ids at most, whatever the size of the tables: the texts stay where they are.
    rows = written(docs.join(F.broadcast(known), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5))), "labelled")
    # Long rows are thinned once more, so that what is counted, pulled and broadcast is bounded by bytes, too.
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= class_bytes // 16)
    for c, size in rows.groupBy("toxic").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect():
        if size > class_bytes:
            share[c] *= class_bytes / size
            again = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * class_bytes / size)
            rows = rows.filter((F.col("toxic") != c) | again)
    models = fit(docs, rows.filter("fold > 0"))
    if models is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    spark = docs.sparkSession.sparkContext
    shared = spark.broadcast(models)
    width = 2 + len(WINDOWS)
    names = [f"z{k}" for k in range(width * len(DISCOUNTS))]

    def measure(batches):
        for batch in batches:
            for part in slices(batch, 1):
                z = np.concatenate([m.differences(part.column(1)) for m in shared.value], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, z.T)], ["x", *names])

    fold = rows.filter("fold = 0").select(F.col("toxic").cast("long").alias("x"), "text").mapInArrow(measure, "x long, " + ", ".join(f"{z} double" for z in names)).toPandas()
    fits = {}
    for k in range(len(DISCOUNTS)):
        for j, window in enumerate(WINDOWS):
            own = [names[width * k + c] for c in (0, 2 + j, 1)]
            fits[k, window] = logistic(fold[own].to_numpy(), fold.x.to_numpy())
    which, window = min(fits, key=lambda x: fits[x][1])
    weights = fits[which, window][0]
    # Back to the share of toxic rows among all labels, where one class was thinned more.
    weights[-1] += float(np.log(share[0] / share[1]))
    chosen = spark.broadcast(models[which])

    def score(batches):
        for batch in batches:
            for part in slices(batch, 1):
                z = chosen.value.differences(part.column(1), (window,))[:, [0, 2, 1]]
                z = np.clip(z @ weights[:-1] + weights[-1], -500, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double")
