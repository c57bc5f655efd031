"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams
(log odds of the n-gram between the languages whose bit is 1 and the others) gives a margin for
the text. Decoding sums, for each language, the logistic losses of its bits, each weighted by how
well its classifier did on training rows, and takes the least. The result is ambiguous when the
two best languages are too close.

All training rows are counted (per language and hashed n-gram: a table of a fixed width). The
bits' weights are measured on a sample of about `weight_rows` of them.
A null text, or one without a letter, is `und` with score 0. Without any training row every text
is `und`. Rows that share an id are predicted each for itself; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, spare_name, text_buffer

BITS = 15
ORDERS = (1, 2, 3)
#: Bytes of text at a time: each takes about 60 bytes of memory.
SLICE = 1 << 18


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: all splits of few languages, else a random code of 8 log2(k) bits or more."""
    if k <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).reshape(-1, k).T
    rng = np.random.default_rng(7)
    return rng.choice(np.array([1, -1], np.int8), (k, 8 * int(np.ceil(np.log2(k)))))


def buckets(raw: np.ndarray, ends: np.ndarray):
    """For each order: hashed n-grams of the whole buffer and where each text's begin and end."""
    low = LOWER[raw].astype(np.uint32)
    code = np.zeros(len(low), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(low) < n:
            return
        code = low[n - 1 :] + (code[: len(low) - n + 1] << np.uint32(8))
        if n in ORDERS:
            yield (code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BITS), ends[:-1], np.maximum(ends[1:] - n + 1, ends[:-1])


def train_counts(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their n-gram counts, from rows(lang, text)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                langs = part.column(0).to_pylist()
                raw, ends = text_buffer(part.column(1))
                for code, s, e in buckets(raw, ends):
                    for lang in set(langs):
                        if lang not in total:
                            total[lang] = np.zeros(1 << BITS, np.int64)
                        own = [code[a:b] for x, a, b in zip(langs, s.tolist(), e.tolist(), strict=True) if x == lang]
                        total[lang] += np.bincount(np.concatenate(own), minlength=1 << BITS)
        for lang, n in total.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["lang", "cell", "n"])

    got = rows.select("lang", "text").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = got["lang"].to_pylist()
    langs = sorted(set(names))
    place = {x: k for k, x in enumerate(langs)}
    out = np.zeros((len(langs), 1 << BITS))
    out[[place[x] for x in names], got["cell"].to_numpy()] = got["n"].to_numpy()
    return langs, out


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Per hashed n-gram and bit: smoothed log odds; languages count alike, however much text they have."""
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    out = np.zeros((1 << BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        out[:, b] = np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0))
    return out


def margins(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean log odds of each text's n-grams, per bit."""
    parts = [_margins(part.column(0), weights) for part in slices(pa.record_batch([text], ["text"]), 0, SLICE)]
    return np.concatenate([np.zeros((0, weights.shape[1])), *parts])


def _margins(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    raw, ends = text_buffer(text)
    total, n = np.zeros((len(ends) - 1, weights.shape[1])), np.zeros(len(ends) - 1)
    for code, s, e in buckets(raw, ends):
        some = np.flatnonzero(e > s)
        edges = np.stack([s[some], e[some]], 1).ravel()
        picked = np.zeros((len(code) + 1, weights.shape[1]), np.float32)
        np.take(weights, code, axis=0, out=picked[:-1], mode="clip")
        if len(some):
            total[some] += np.add.reduceat(picked, edges, axis=0)[::2]
            n[some] += (e - s)[some]
    return total / np.maximum(n, 1)[:, None]


def fit_language(known: DataFrame, weight_rows: int, sharpness: float, margin: float):
    """From known(doc_id, lang, text): a function of texts and whether each has a letter, giving
    languages, scores and ambiguities; None without rows."""
    langs, counts = train_counts(known)
    if not langs:
        return None
    code = codewords(len(langs))
    model = known.sparkSession.sparkContext.broadcast((bit_weights(counts, code), code))

    def right(batches):
        place = {x: k for k, x in enumerate(langs)}
        for batch in batches:
            for part in slices(batch, 1):
                weights, code = model.value
                truth = code[[place[x] for x in part.column(0).to_pylist()]]
                good = (margins(part.column(1), weights) * truth > 0).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(good)), pa.int32()), pa.array(good.astype(np.int64)), pa.array([part.num_rows] * len(good), pa.int64())], ["bit", "good", "n"])

    rows = max(1, known.count())
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1_000_000, 1 + 1_000_000 * weight_rows // rows)).select("lang", "text")
    tested = sample.mapInArrow(right, "bit int, good long, n long").groupBy("bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect() if code.shape[1] else []
    trust = np.ones(code.shape[1])
    for r in tested:
        error = (r.n - r.good + 0.5) / (r.n + 1)
        trust[r.bit] = max(0.05, 0.5 * np.log((1 - error) / error))
    trust /= max(trust.sum(), 1e-9)

    def decode(text: pa.Array, letter: np.ndarray):
        weights, code = model.value
        z = sharpness * margins(text, weights)
        loss = (np.logaddexp(0, -z[:, None, :] * code[None]) * trust).sum(2)
        p = np.exp(-code.shape[1] * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best, top = p.argmax(1), np.sort(p, 1)[:, ::-1]
        gap = top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0)
        return [langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)], np.where(letter, top[:, 0], 0.0), (gap < margin) | ~letter

    return decode


LETTER = r"\p{L}"


def _fitted(docs: DataFrame, train: Column, weight_rows: int, sharpness: float, margin: float):
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return fit_language(known, weight_rows, sharpness, margin), F.coalesce(F.col("text").cast("string").rlike(LETTER), F.lit(False))


def identify_language(docs: DataFrame, train: Column, weight_rows: int = 4000, sharpness: float = 12.0, margin: float = 0.02) -> DataFrame:
    """Per row of docs(doc_id, text, lang): doc_id, lang_pred, score (0 to 1), ambiguous.

    train: which rows' lang and text may be learned from (rows without lang never are).
    sharpness: factor from mean log odds to the margin in the loss. margin: least gap of the two
    best languages' probabilities for a result that is not ambiguous.
    """
    decode, letter = _fitted(docs, train, weight_rows, sharpness, margin)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), letter.alias("letter"))
    if decode is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))

    def predict(batches):
        for batch in batches:
            for part in slices(batch, 1):
                lang, score, unsure = decode(part.column(1), part.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, train: Column, weight_rows: int = 4000, sharpness: float = 12.0, margin: float = 0.02) -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified and not ambiguous."""
    decode, letter = _fitted(docs, train, weight_rows, sharpness, margin)
    if decode is None:
        return docs.filter(F.lit(False))
    place = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for part in slices(batch, place):
                unsure = decode(part.column(place), part.column(part.num_columns - 1).to_numpy(zero_copy_only=False))[2]
                yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1]).filter(pa.array(~unsure))

    spare = spare_name(docs, "letter")
    return docs.select("*", letter.alias(spare)).mapInArrow(keep, docs.schema)
