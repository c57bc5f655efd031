"""Uniform numbers in [0, 1) for whole arrays of keys, made within a task: equal to the columns `uniform` and
`digest_uniform` of operators.generation at int keys (seed, row, col, k)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers digested side by side, which the processor's cache holds; of fewer than FEW of a length each goes alone.
BLOCK, FEW = 1 << 14, 32


def _words(head: bytes, numbers: np.ndarray, digits: int) -> list:
    """The sixteen words of MD5's block for head and each number, all of as many digits; a word that is alike for all is an int."""
    whole, size = len(head) // 4, len(head) + digits
    tail = np.zeros((len(numbers), (size // 4 - whole + 1) * 4), np.uint8)
    rest = head[whole * 4 :]
    tail[:, : len(rest)] = np.frombuffer(rest, np.uint8)
    left = numbers.astype(np.uint32 if digits < 10 else np.uint64)
    for k in range(digits - 1, -1, -1):
        up = left // 10
        tail[:, len(rest) + k] = left - up * 10 + 48
        left = up
    tail[:, len(rest) + digits] = 0x80
    words = [int.from_bytes(head[k * 4 : k * 4 + 4], "little") for k in range(whole)]
    words += [np.ascontiguousarray(w) for w in tail.view("<u4").T]
    return words + [0] * (14 - len(words)) + [size * 8, 0]


def _side_by_side(some: list[list], sizes: list[int]) -> list:
    """Blocks of words one behind the other."""
    out = []
    for column in zip(*some, strict=True):
        alike = all(isinstance(w, int) for w in column) and len(set(column)) == 1
        out.append(column[0] if alike else np.concatenate([np.full(n, w, np.uint32) if isinstance(w, int) else w for w, n in zip(column, sizes, strict=True)]))
    return out


def _bits(words: list, n: int) -> np.ndarray:
    """The first 52 bits of the MD5 digests of n blocks."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
            g = k
        elif k < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
            g = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
            g = (3 * k + 5) % 16
        else:
            np.invert(d, f)
            f |= b
            f ^= c
            g = 7 * k % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((SINES[k] + words[g]) & 0xFFFFFFFF)
        else:
            f += np.uint32(SINES[k])
            f += words[g]
        np.right_shift(f, np.uint32(32 - TURNS[k]), turned)
        f *= np.uint32(1 << TURNS[k])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = ((v + np.uint32(s)).byteswap().astype(np.uint64) for v, s in ((a, START[0]), (b, START[1])))
    return first << np.uint64(20) | second >> np.uint64(12)


def digests(seeds: Sequence[int], row: int, col: int, numbers: np.ndarray) -> np.ndarray:
    """A row per seed, from the MD5 digests of "seed:row:col:number", for ascending numbers from 1."""
    out, waiting, n = np.empty((len(seeds), len(numbers))), [], 0

    def settle() -> None:
        if waiting:
            made = _bits(_side_by_side([w for w, _ in waiting], [len(o) for _, o in waiting]), n)
            for k, (_, o) in zip(np.cumsum([0] + [len(o) for _, o in waiting[:-1]]), waiting, strict=True):
                o[:] = made[k : k + len(o)]

    edges = np.searchsorted(numbers, 10 ** np.arange(19))
    for seed, own in zip(seeds, out, strict=True):
        head = f"{seed}:{row}:{col}:".encode()
        for digits in range(1, 19):
            for k in range(edges[digits - 1], edges[digits], BLOCK):
                end = min(k + BLOCK, edges[digits])
                if end - k < FEW or len(head) + digits > 55:
                    own[k:end] = [int(hashlib.md5(b"%b%d" % (head, v)).hexdigest()[:13], 16) for v in numbers[k:end].tolist()]
                    continue
                if n + end - k > BLOCK:
                    settle()
                    waiting, n = [], 0
                waiting.append((_words(head, numbers[k:end], digits), own[k:end]))
                n += end - k
    settle()
    return out / 2**52


P1, P2, P3, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def _hash_int(value, before):
    """XXH64 of an int with `before` as its seed, of numbers or arrays (uint64)."""
    u = np.uint64
    h = (before + u(P5) + u(4)) ^ (value & u(0xFFFFFFFF)) * u(P1)
    h = (h << u(23) | h >> u(41)) * u(P2) + u(P3)
    h = (h ^ h >> u(33)) * u(P2)
    h = (h ^ h >> u(29)) * u(P3)
    return h ^ h >> u(32)


def hashes(seeds: Sequence[int], row: int, col: int, numbers: np.ndarray) -> np.ndarray:
    """A row per seed, from xxhash64 of the four ints."""
    h = np.array([[42]], np.uint64)
    for key in (np.array(seeds)[:, None], row, col, numbers):
        h = _hash_int(np.atleast_1d(key).astype(np.int64).view(np.uint64), h)
    return (h & np.uint64((1 << 52) - 1)) / 2**52
