"""Benchmark decontamination: which documents hold a benchmark item, up to a share of edits.

Texts are compared as UTF-8 bytes with A-Z lower-cased and white space runs as one space.
An item of m bytes that may have k edits is cut into k + 1 pieces. Of any occurrence within the
limit some piece is unchanged, and the pieces can be walked in a ring from one of these so that
the first l hold at most l - 1 edits. So every place where a document has the first bytes of a
piece (eight at most) is looked at: of the next piece one half must stand unchanged, at most one
byte aside; then as many of the item's runs of four and of five bytes as k edits must leave
(m - 3 - 4 k and m - 4 - 5 k) must stand in the surroundings; what is left is verified by the exact
edit distance of the item to the best part of the surroundings. No step drops an occurrence within
the limit.

The items travel as a broadcast index, in blocks of at most `block_bytes` of item text each (the
size is summed first); documents are read once per block and nothing is shuffled.
Null or blank items match nothing; an item so short that its share of edits is none must occur
unchanged. Items of few bytes with an edit have pieces of a few bytes, which occur often, so each
costs more than a long one. Null texts hold nothing. Rows that share an id are each searched, and
repeated rows give repeated results; extra columns are ignored; an empty table on either side gives
an empty result. A very long text takes memory in proportion in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices

SHIFT, LONGEST, GRAMS = 16, 8, (4, 5)
TABLE_BITS, HITS, ROWS = 22, 1 << 18, 2048
#: Bytes of verification masks at a time.
MASKS = 4 << 20
SCHEMA = "doc_id long, item_id long, edit_distance int, item_bytes int, start int"
FOLD = bytes(LOWER)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: White space is one space in every text, so no text has this byte.
END = b"\n"


def plain(text: str | None) -> bytes:
    return " ".join((text or "").split()).encode("utf-8", "surrogatepass").translate(FOLD)


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw but the last seven, the first byte lowest."""
    return np.lib.stride_tricks.as_strided(raw.view(np.uint8)[:8].view("<u8"), (max(0, len(raw) - 7),), (1,))


def low(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """32-bit hashes of the n bytes from each place."""
    return (((word & low(n)) * ODD) >> np.uint64(32)).astype(np.uint32)


def distance(masks: dict[int, int], m: int, text: bytes, limit: int) -> int:
    """Least edit distance of a pattern of m bytes to any part of text (bit-parallel columns)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(h | up)) & full
        mh = up & h
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1, mh << 1
        up = (mh | ~(v | ph)) & full
        down = ph & v
    return best


class Pieces:
    """The pieces of the items whose pieces have `size` bytes at least, by a hash of these."""

    def __init__(self, size: int, texts: list[bytes], own: list[int], limits: np.ndarray):
        self.size, rows = size, []
        for i in own:
            m, n = len(texts[i]), int(limits[i]) + 1
            at = [j * m // n for j in range(n + 1)]
            for j in range(n):
                after = texts[i][at[j + 1] : at[j + 1] + size] if j + 1 < n else b""
                rows.append((int.from_bytes(texts[i][at[j] : at[j] + size], "little"), i, at[j], at[j + 1] - at[j], int.from_bytes(after, "little"), j + 1 == n))
        word, item, offset, length, after, last = (np.array(c) for c in zip(*rows, strict=True))
        word, after = word.astype(np.uint64), after.astype(np.uint64)
        slot = self.slots(word)
        order = np.argsort(slot, kind="stable")
        self.word, self.item, self.offset, self.length, self.after, self.last = (c[order] for c in (word, item, offset, length, after, last))
        self.first = np.searchsorted(slot[order], np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
        self.present = self.first[1:] > self.first[:-1]

    def slots(self, word: np.ndarray) -> np.ndarray:
        return (((word & low(self.size)) * ODD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def places(self, word: np.ndarray):
        """(item, start of the item) of every piece found in place, if the next piece has one edit at most."""
        slot = self.slots(word)
        at = np.flatnonzero(self.present[slot])
        lo = self.first[slot[at]].astype(np.int64)
        n = self.first[slot[at] + 1] - lo
        ends = np.cumsum(n)
        half, q = self.size // 2, self.size
        a, b = low(half), low(q - half)
        done = 0
        while done < len(at):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
            k = n[done:to]
            which = np.repeat(lo[done:to] - np.cumsum(k) + k, k) + np.arange(k.sum())
            place = np.repeat(at[done:to], k)
            same = (word[place] & low(q)) == self.word[which]
            which, place = which[same], place[same]
            follow, want = word[np.minimum(place + self.length[which], len(word) - 1)], self.after[which]
            rest = want >> np.uint64(8 * half)
            near = self.last[which] | ((follow & a) == (want & a))
            for shift in (half - 1, half, half + 1):
                # Nine bytes would be needed for the last half of eight, one byte on: seven of these are enough.
                part = min(q - half, 8 - shift) if shift >= 0 else 0
                near |= ((follow >> np.uint64(8 * max(shift, 0))) & low(part)) == (rest & low(part))
            yield self.item[which[near]], place[near] - self.offset[which[near]]
            done = to


class Index:
    """A block of items: their pieces, runs of four bytes, and verification masks."""

    def __init__(self, items: list[tuple[int, bytes]], max_rate: float):
        # Without an edit an item of less than LONGEST bytes is one short piece: it is looked for as it is.
        whole = lambda t: len(t) < LONGEST and int(max_rate * len(t)) == 0
        self.short = [(i, t) for i, t in items if t and whole(t)]
        items = sorted(((i, t) for i, t in items if t and not whole(t)), key=lambda x: (len(x[1]), x[0]))
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        # An item that may be edited throughout needs no piece; one byte less keeps a piece of one byte.
        self.limits = np.minimum((max_rate * self.sizes).astype(np.int64), self.sizes - 1)
        sizes = np.minimum(LONGEST, self.sizes // (self.limits + 1))
        self.pieces = [Pieces(int(q), self.texts, np.flatnonzero(sizes == q).tolist(), self.limits) for q in np.unique(sizes)]
        # Runs of bytes of each item, in one table of hashes per length, with a shift per item.
        self.shift = np.random.default_rng(11).integers(0, 1 << 32, len(self.texts), np.uint32)
        bits = min(26, max(16, int(64 * self.sizes.sum()).bit_length()))
        self.down, self.held = np.uint32(32 - bits), {n: np.zeros(1 << bits, bool) for n in GRAMS}
        for i, t in enumerate(self.texts):
            for n, held in self.held.items():
                held[(grams(words(np.frombuffer(t + END * 7, np.uint8))[: len(t) - n + 1], n) + self.shift[i]) >> self.down] = True
        self.masks: dict[int, dict[int, int]] = {}

    def alike(self, gram: np.ndarray, n: int, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether some part of lo..hi of an item's size and edits has enough of its runs of n bytes.

        gram goes on for the longest lo..hi past its end."""
        m, k = self.sizes[item], self.limits[item]
        width = int((hi - lo).max(initial=0))
        here = np.lib.stride_tricks.sliding_window_view(gram, width)[lo]
        here += self.shift[item][:, None]
        here >>= self.down
        here = self.held[n][here] & (np.arange(width) < (hi - lo)[:, None])
        least = m - n + 1 - n * k
        good = np.count_nonzero(here, axis=1) >= least
        some = np.flatnonzero(good)
        total = np.zeros((len(some), width + 1), np.int32)
        np.cumsum(here[some], axis=1, out=total[:, 1:])
        ends = np.minimum(np.arange(width + 1) + (m + k - n + 1)[some, None], width)
        good[some] = (np.take_along_axis(total, ends, 1) - total).max(1) >= least[some]
        return good

    def distances(self, item: np.ndarray, texts: list[bytes]) -> list[int]:
        """`distance` of each item to its text, side by side; patterns end at the highest bit of their last word."""
        found, at = [], 0
        while at < len(texts):
            words = -(-int(self.sizes[item[at]]) // 64)
            to = min(len(texts), at + max(1, MASKS // (2048 * words)))
            # Items are in order of their size; a wide one later in the batch would widen all.
            words = -(-int(self.sizes[item[at:to]].max()) // 64)
            found += self._distances(item[at:to], texts[at:to], words)
            at = to
        return found

    def _distances(self, item: np.ndarray, texts: list[bytes], words: int) -> list[int]:
        own, which = np.unique(item, return_inverse=True)
        masks = np.zeros((words, len(own) * 256), np.uint64)
        for k, i in enumerate(own.tolist()):
            m = int(self.sizes[i])
            bit = np.arange(64 * words - m, 64 * words)
            np.add.at(masks, (bit >> 6, k * 256 + np.frombuffer(self.texts[i], np.uint8).astype(np.int64)), np.uint64(1) << (bit & 63).astype(np.uint64))
        score = self.sizes[item]
        free = 64 * words - score - 64 * np.arange(words)[:, None]  # unused bits of each word
        full = np.where(free >= 64, np.uint64(0), ~np.uint64(0) << np.clip(free, 0, 63).astype(np.uint64))
        width = max(map(len, texts))
        column = np.frombuffer(b"".join(t.ljust(width, END) for t in texts), np.uint8).reshape(len(texts), width).T + (which * 256)[None]
        up, down, best, one, top = full.copy(), np.zeros_like(full), score.copy(), np.uint64(1), np.uint64(63)
        for c in column:
            eq = masks[:, c]
            v, own = eq | down, eq & up
            h = own + up
            carry = h < own
            for w in range(1, words):
                h[w] += carry[w - 1]
                carry[w] |= carry[w - 1] & (h[w] == 0)
            h ^= up
            h |= eq
            ph, mh = (down | ~(h | up)) & full, up & h
            score = score + (ph[-1] >> top).astype(np.int64) - (mh[-1] >> top).astype(np.int64)
            np.minimum(best, score, out=best)
            high = ph >> top, mh >> top
            ph <<= one
            mh <<= one
            ph[1:] |= high[0][:-1]
            mh[1:] |= high[1][:-1]
            up = (mh | ~(v | ph)) & full
            down = ph & v
        return best.tolist()

    def mask(self, i: int) -> dict[int, int]:
        if i not in self.masks:
            out: dict[int, int] = {}
            for k, c in enumerate(self.texts[i]):
                out[c] = out.get(c, 0) | 1 << k
            self.masks[i] = out
        return self.masks[i]

    def search(self, texts: list[bytes]):
        """(text, item id, distance, item bytes, start) of every item found; the best place of each."""
        for k, text in enumerate(texts):
            for i, t in self.short:
                at = text.find(t)
                if at >= 0:
                    yield k, i, 0, len(t), at
        if not self.texts or not texts:
            return
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        word = words(np.frombuffer(END.join([*texts, END * 8]), np.uint8))
        room = np.zeros(int((self.sizes + 2 * self.limits).max()) + SHIFT, np.uint32)
        gram = {n: np.concatenate([grams(word, n), room]) for n in GRAMS}
        # One candidate per item and line of SHIFT starts; a start may lie before the text.
        back = int((self.sizes + self.limits).max()) // SHIFT + 1
        lines = int(begin[-1]) // SHIFT + 2 * back + 2
        keys = [np.unique(item * lines + start // SHIFT + back) for p in self.pieces for item, start in p.places(word)]
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        item, start = key // lines, (key % lines - back) * SHIFT
        best: dict[tuple[int, int], tuple[int, int]] = {}
        m, k = self.sizes[item], self.limits[item]
        lo, hi = np.maximum(start - k, 0), np.minimum(start + SHIFT + m + k, begin[-1])
        jobs, parts = [], []
        for part in range(0, len(key), ROWS):
            left = np.arange(part, min(part + ROWS, len(key)))
            for n in GRAMS:
                left = left[self.alike(gram[n], n, item[left], lo[left], hi[left])]
            for j in left.tolist():
                # A line may hold starts in two texts or more.
                for d in range(int(np.searchsorted(begin, lo[j], "right")) - 1, min(int(np.searchsorted(begin, hi[j], "left")), len(texts))):
                    jobs.append((j, d))
                    parts.append(texts[d][max(0, int(lo[j] - begin[d])) : max(0, int(hi[j] - begin[d]))])
        for (j, d), found in zip(jobs, self.distances(item[[j for j, _ in jobs]], parts), strict=True):
            i = int(item[j])
            if found <= k[j] and found < best.get((d, i), (int(m[j]),))[0]:
                best[d, i] = found, max(0, int(start[j] - begin[d]))
        for (d, i), (found, s) in best.items():
            yield d, self.ids[i], found, len(self.texts[i]), s


def find_items(docs: DataFrame, items: DataFrame, max_rate: float = 0.15, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document of docs(doc_id, text) and item of items(item_id, text) that it holds with
    at most max_rate edits per byte: doc_id, item_id, edit_distance, item_bytes, start."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(Index(sorted((r.item_id, plain(r.text)) for r in own if r.item_id is not None), max_rate))

        def search(batches, index=index):
            for batch in batches:
                for part in slices(batch, 1):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[k], i, found, m, s) for k, i, found, m, s in index.value.search([plain(t) for t in part.column(1).to_pylist()])]
                    if rows:
                        a, b, c, d, e = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(e, pa.int32())], [x.split()[0] for x in SCHEMA.split(", ")])

        found = docs.mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)
