"""Token ids as compressed binary segments: an adaptive context-mixing coder of range ANS.

An id is coded by up to three decisions. Was it the id that last followed the two ids before it
(order 2)? Else, the one that last followed the id before it (order 1)? Else which of the ids that
were missed before (order 0); one that is new there has its high byte coded by adaptive order-0
frequencies, and its low byte by those of that high byte. The probability of the first two decisions
is mixed from adaptive counters chosen by the order-2 entry's confidence, by the order-1 entry's
confidence and agreement, and by all of these, each weighted by how well it has predicted so far.
All arithmetic is exact, so any machine decodes what another wrote.

The ids of a segment are cut in lanes of some STEPS ids, a NumPy lane each, which go side by side and
share one model: it is brought up to date after every round of up to ROUND ids of each lane. So a
segment is decoded as a whole; each BLOCK ids have their own CRC-32. It holds whole documents:

    magic "EMB3" | u32 documents | u32 blocks | u64 ids | u32 large ids
    i64 document ids | u64 lengths | u32 block CRC-32s | u32 large ids | u64 lanes' states | u32 words

Numbers are little-endian; a block's CRC-32 is that of its ids as little-endian u32. Ids from LARGE
on are coded as LARGE and kept as they are beside the lanes, so all ids of 32 bits have a code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES, STEPS, ROUND = 16_384, 4096, 2048, 8
MAGIC, LARGE = b"EMB3", 0xFFFF
TOTAL_BITS, HASH_BITS, MIX_BITS, SLOT_BITS = 15, 18, 12, 18
TOTAL, MIX, SLOTS = 1 << TOTAL_BITS, 1 << MIX_BITS, 1 << SLOT_BITS
BITS, LEAST = MIX_BITS + SLOT_BITS, 1 << 31
NONE = LARGE
NEW = 1 << 16
GAIN = 48
CONTEXTS = 128
#: An entry is its id times 8 and a confidence; this is added after a miss (of confidences 2 to 7) or a hit, else it is replaced.
MOVE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 0, 1, 1, 1, 1, 1, 1, 0], np.int32)
KEPT = np.arange(16) > 1


class Bytes:
    """Adaptive frequencies of one byte in several contexts per lane, brought up to date now and then where they have grown."""

    def __init__(self, lanes: int, contexts: int = 1):
        n = lanes * contexts
        self.counts, self.cum, self.built = np.ones((n, 256), np.int32), np.zeros((n, 257), np.uint16), np.full(n, 256, np.int32)
        self.total = self.built.copy()
        self.cum[:] = np.arange(257) * (TOTAL // 256)
        self.flat = self.cum.ravel()

    def rebuild(self) -> None:
        grown = self.total - self.built
        due = np.flatnonzero((grown > 0) & ((grown * 8 >= self.built) | (self.built == 256)))
        for at in range(0, len(due), 4096):
            some = due[at : at + 4096]
            # Products are below 2^53 and quotients far from the next whole number, so the whole part is exact.
            share = (self.counts[some] * float(TOTAL - 256) / self.total[some, None]).astype(np.uint16) + np.uint16(1)
            self.cum[some, 1:] = np.cumsum(share, axis=1, dtype=np.uint16)
            self.cum[some, 256] = TOTAL
        self.built[due] = self.total[due]

    def span(self, tables: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = tables * 257 + symbol
        low = self.flat[at].astype(np.int64)
        return low, self.flat[at + 1].astype(np.int64) - low

    def find(self, tables: np.ndarray, value: np.ndarray) -> np.ndarray:
        return (self.cum[tables, 1:256] <= value[:, None]).sum(axis=1)

    def seen(self, tables: np.ndarray, symbol: np.ndarray) -> None:
        np.add.at(self.counts.ravel(), tables * 256 + symbol, GAIN)
        np.add.at(self.total, tables, GAIN)


class Mixer:
    """Probability of a hit (of MIX) in each context, from counters of several groupings of the contexts."""

    def __init__(self, *groups: np.ndarray):
        self.groups, self.error = groups, [MIX // 2] * len(groups)
        self.hits, self.all = np.zeros((2, CONTEXTS), np.int64)
        self.own = [np.full(CONTEXTS, MIX // 4) for _ in groups]

    def learn(self, hits: np.ndarray, tries: np.ndarray) -> None:
        n = int(tries.sum())
        if not n:
            return
        for k, p in enumerate(self.own):
            self.error[k] += (int((hits * (MIX - p) + (tries - hits) * p).sum()) // n - self.error[k]) >> 3
        self.hits += hits
        self.all += tries
        old = self.all > 1 << 18
        self.hits[old] >>= 1
        self.all[old] >>= 1
        # Sums of whole numbers below 2^53 are exact.
        sums = [(np.bincount(g, self.hits).astype(np.int64), np.bincount(g, self.all).astype(np.int64)) for g in self.groups]
        self.own = [((h * MIX + MIX // 4) // (t + 1))[g] for g, (h, t) in zip(self.groups, sums, strict=True)]

    def predict(self) -> np.ndarray:
        weight = [(MIX + 64 - e) ** 2 >> 8 for e in self.error]
        return sum(w * p for w, p in zip(weight, self.own, strict=True)) // sum(weight)


class Model:
    """What all lanes of a segment have learnt so far."""

    def __init__(self):
        self.two, self.one = np.full(1 << HASH_BITS, NONE << 3, np.int32), np.full(1 << 16, NONE << 3, np.int32)
        every = np.arange(CONTEXTS)
        self.first, self.second = Mixer(every >> 4, every & 15, every), Mixer(every >> 1 & 7, every)
        self.counts, self.missed, self.total, self.built = np.zeros(1 << 16, np.int64), [], 0, 0
        self.high, self.low = Bytes(1), Bytes(1, 256)
        self._mix()
        self._share()

    def _mix(self) -> None:
        """Per context, the ends of the shares of order 2 and of order 1 (which has none if both agree)."""
        self.a = np.clip(self.first.predict(), 4, MIX - 12)
        self.b = self.a + np.clip((MIX - self.a) * self.second.predict() >> MIX_BITS, 1, MIX - 8 - self.a)
        self.b[1::2] = self.a[1::2]
        self.low2, self.low1, self.width = self.a << SLOT_BITS, self.b << SLOT_BITS, MIX - self.b
        self.part = 1 / self.width

    def _share(self) -> None:
        """Deal the slots of order 0 to the ids missed so far, and what is left to NEW."""
        seen, self.built = np.flatnonzero(self.counts), self.total
        self.size = np.zeros(NEW + 1, np.int64)
        if len(seen):
            room = SLOTS - len(seen) - max(16, min(SLOTS // 4, SLOTS * len(seen) // (2 * self.total)))
            self.size[seen] = self.counts[seen] * room // self.total + 1
        self.size[NEW] = SLOTS - self.size.sum()
        self.start, ids = np.cumsum(self.size) - self.size, np.append(seen, NEW)
        self.slot = np.repeat(ids.astype(np.int32), self.size[ids])

    def look(self, two: np.ndarray, one: np.ndarray):
        """Places and entries of order 2, entries of order 1, and contexts."""
        at = (two * 0x9E3779B1 + one * 0x85EBCA6B >> 12) & ((1 << HASH_BITS) - 1)
        e2, e1 = self.two.take(at), self.one.take(one)
        return at, e2, e1, (e2 & 7) << 4 | (e1 & 7) << 1 | ((e1 ^ e2) < 8)

    def spans(self, context: np.ndarray, hit2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of hits of order 2 or else 1."""
        a = self.low2[context]
        return np.where(hit2, 0, a), np.where(hit2, a, self.low1[context] - a)

    def learn(self, at, e2, one, e1, context, now, hit2, hit1) -> None:
        missed = now[~(hit2 | hit1)]
        none, only1, *both = np.bincount(context << 2 | hit2 << 1 | hit1, minlength=4 * CONTEXTS).reshape(CONTEXTS, 4).T
        self.first.learn(sum(both), none + only1 + sum(both))
        none[1::2] = only1[1::2] = 0
        self.second.learn(only1, none + only1)
        self._mix()
        # Where an entry meets several ids in one round, the last one counts.
        instead = (now << 3 | 1).astype(np.int32)
        for table, place, entry, hit in ((self.two, at, e2, hit2), (self.one, one, e1, hit1)):
            case = entry & 7 | hit.astype(np.int32) << 3
            table[place] = np.where(KEPT.take(case), entry + MOVE.take(case), instead)
        self.missed.append(missed)
        self.total += len(missed)
        if self.total > self.built and (self.total - self.built) * 8 >= self.built:
            np.add.at(self.counts, np.concatenate(self.missed), 1)
            self.missed = []
            self._share()
        self.high.rebuild()
        self.low.rebuild()


def _rounds(steps: int):
    t = 0
    while t < steps:
        to = min(steps, t + min(ROUND, max(1, t // 16)))
        yield t, to
        t = to


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _put(x: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int, out: list) -> np.ndarray:
    full = np.flatnonzero(x >= size << (63 - bits))
    over = x[full]
    out.append(over.astype(np.uint32))
    x[full] = over >> 32
    q = x // size
    return (q << bits) + (x - q * size) + start


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of the lanes and words. What lanes code is settled forward, and coded backward."""
    lanes, steps = _lanes(len(ids))
    model, all_ids = Model(), np.zeros((steps + 2, lanes), np.int32)
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = ids
    all_ids[2:] = padded.reshape(lanes, steps).T
    starts, sizes = np.empty((2, steps, lanes), np.uint32)
    extra = {}
    for t, to in _rounds(steps):
        two, one, now = (all_ids[t + k : to + k].ravel().astype(np.int64) for k in range(3))
        at, e2, e1, context = model.look(two, one)
        hit2, hit1 = e2 >> 3 == now, e1 >> 3 == now
        own, hit = model.size.take(now), hit2 | hit1
        new = np.flatnonzero((own == 0) & ~hit)
        first = model.start.take(now)
        own[new], first[new] = model.size[NEW], model.start[NEW]
        width = model.width.take(context)
        start, size = model.low1.take(context) + first * width, own * width
        hit = np.flatnonzero(hit)
        start[hit], size[hit] = model.spans(context[hit], hit2[hit])
        if len(new):
            high, low = now[new] >> 8, now[new] & 255
            spans = [*model.high.span(high * 0, high), *model.low.span(high, low)]
            step, lane = np.divmod(new, lanes)
            for k in np.unique(step).tolist():
                here = step == k
                extra[t + k] = (lane[here], *(s[here] for s in spans))
            model.high.seen(high * 0, high)
            model.low.seen(high, low)
        starts[t:to], sizes[t:to] = start.reshape(-1, lanes), size.reshape(-1, lanes)
        model.learn(at, e2, one, e1, context, now, hit2, hit1)
    x, out = np.full(lanes, LEAST, np.int64), []
    for t in range(steps - 1, -1, -1):
        if t in extra:
            lane, start1, size1, start2, size2 = extra[t]
            x[lane] = _put(_put(x[lane], start2, size2, TOTAL_BITS, out), start1, size1, TOTAL_BITS, out)
        x = _put(x, starts[t], sizes[t].astype(np.int64), BITS, out)
    return x, np.concatenate(out[::-1])


class _Words:
    def __init__(self, words: np.ndarray):
        self.words, self.at = words, 0

    def fill(self, x: np.ndarray) -> np.ndarray:
        low = np.flatnonzero(x < LEAST)
        x[low] = x[low] << 32 | self.words[self.at : self.at + len(low)]
        self.at += len(low)
        return x


def _byte(model: Bytes, tables: np.ndarray, x: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    value = x & (TOTAL - 1)
    symbol = model.find(tables, value)
    start, size = model.span(tables, symbol)
    return symbol, words.fill(size * (x >> TOTAL_BITS) + value - start)


def _decode(n: int, x: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes, steps = _lanes(n)
    model, source, all_ids = Model(), _Words(words), np.zeros((steps + 2, lanes), np.int64)
    for t, to in _rounds(steps):
        seen, fresh = [], []
        for k in range(t, to):
            at, e2, e1, context = model.look(all_ids[k], all_ids[k + 1])
            value, width = x & ((1 << BITS) - 1), model.width.take(context)
            rest = value - model.low1.take(context)
            # Whole parts are exact: with the half, quotients are 2^-13 from the next whole number at least. Hits have a slot, too, for now.
            now = model.slot.take(((np.maximum(rest, 0) + 0.5) * model.part.take(context)).astype(np.int64))
            below, size = model.start.take(now) * width, model.size.take(now) * width
            over = rest - below
            hit = np.flatnonzero(rest < 0)
            of, got = context[hit], value[hit]
            hit2 = got < model.low2[of]
            start, size[hit] = model.spans(of, hit2)
            over[hit], now[hit] = got - start, np.where(hit2, e2[hit], e1[hit]) >> 3
            x = source.fill(size * (x >> BITS) + over)
            new = np.flatnonzero(now == NEW)
            all_ids[k + 2] = now
            if len(new):
                high, left = _byte(model.high, new * 0, x[new], source)
                low, x[new] = _byte(model.low, high, left, source)
                all_ids[k + 2, new] = high << 8 | low
                fresh.append(all_ids[k + 2, new])
            seen.append((at, e2, e1, context))
        at, e2, e1, context = map(np.concatenate, zip(*seen, strict=True))
        one, now = all_ids[t + 1 : to + 1].ravel(), all_ids[t + 2 : to + 2].ravel()
        for ids in fresh:
            model.high.seen(ids * 0, ids >> 8)
            model.low.seen(ids >> 8, ids & 255)
        model.learn(at, e2, one, e1, context, now, e2 >> 3 == now, e1 >> 3 == now)
    if source.at != len(words) or (x != LEAST).any():
        raise ValueError("the lanes do not end where they should")
    return all_ids[2:].T.ravel()[:n]


def encode_segment(docs: list[int], ids: list[bytes]) -> bytes:
    """A segment of whole documents; ids as little-endian uint32 bytes."""
    whole = np.frombuffer(b"".join(ids), "<u4")
    n = -(-len(whole) // BLOCK)
    large = whole[whole >= LARGE]
    states, words = _encode(np.minimum(whole, LARGE).astype(np.int32)) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    crcs = [zlib.crc32(whole[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(n)]
    head = MAGIC + struct.pack("<IIQI", len(docs), n, len(whole), len(large))
    parts = [(docs, "<i8"), ([len(x) // 4 for x in ids], "<u8"), (crcs, "<u4"), (large, "<u4"), (states, "<u8"), (words, "<u4")]
    return b"".join([head, *(np.asarray(x, kind).tobytes() for x, kind in parts)])


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths, and all ids as uint32; raises ValueError where a checksum fails."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n, total, n_large = struct.unpack("<IIQI", data[4:24])
    at, parts = 24, []
    for kind, size, count in (("<i8", 8, n_docs), ("<u8", 8, n_docs), ("<u4", 4, n), ("<u4", 4, n_large), ("<u8", 8, _lanes(total)[0] if n else 0)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += size * count
    docs, lengths, crcs, large, states = parts
    if not n:
        return docs, lengths, np.zeros(0, "<u4")
    flat = _decode(total, states.astype(np.int64), np.frombuffer(data, "<u4", offset=at)).astype("<u4")
    places = np.flatnonzero(flat == LARGE)
    if len(places) != len(large):
        raise ValueError("the large ids are damaged")
    flat[places] = large
    for k, crc in enumerate(crcs.tolist()):
        if zlib.crc32(flat[k * BLOCK : (k + 1) * BLOCK].tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return docs, lengths, flat
