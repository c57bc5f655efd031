"""Token ids of whole texts by the tokenizers library, each different piece of a slice encoded once."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

CACHE = 1 << 20
BATCH = 20_000
#: A piece that kind "words" takes as one word, whose last id, and no other, ends a word.
WORD, END, LINE = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", "</w>", 1000


def _table(found: bytes | range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(found)] = True
    return out


#: First bytes of characters that are no white space: leads of U+0085, U+00A0, U+1680, U+2000 and U+3000 are left out.
SOLID = _table([*range(0x21, 0x80), *(x for x in range(0xC3, 0xF5) if x not in (0xE1, 0xE2, 0xE3))])
ALPHA = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Without the apostrophe, which begins contractions.
PUNCT = _table(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
_open: dict[tuple, Encoder] = {}


def cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin, and the end: at texts' ends and at places where both kinds of tokenizer always cut.

    These are: a space before a character that is none; punctuation after a Latin letter; both sides of a line feed
    between characters that are no white space. Other white space stays in its piece, as its cuts depend on what
    follows. Where a byte does not tell, there is no cut."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    solid = SOLID[raw]
    cut[: n - 1] = (raw[:-1] == 32) & solid[1:]
    cut[ends[1:] - 1] = False  # a last space, whatever the next text begins with
    latin = np.zeros(n, bool)  # ends of U+00C0 to U+00FF
    latin[1:] = raw[:-1] == 0xC3
    letter = ALPHA[raw] | (latin & (raw != 0x97) & (raw != 0xB7))
    cut[1:n] |= letter[:-1] & PUNCT[raw[1:]]
    line = np.flatnonzero(raw == 10)
    line = line[(line > 0) & (line < n - 1)]
    line = line[solid[line + 1] & (((raw[line - 1] > 32) & (raw[line - 1] < 0x80)) | latin[line - 1])]
    line = line[~np.isin(line + 1, ends)]
    cut[line] = cut[line + 1] = True
    cut[ends] = True
    return np.flatnonzero(cut)


def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[first : first + n] of each row, one after the other."""
    ends = np.cumsum(n)
    return flat[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts. The texts of an array are cut where the tokenizer always cuts, and each different piece is
    encoded once.

    kind "spaced": the tokenizer cuts before a space that a word follows. kind "words": white space only separates.
    kind "whole": no pieces. Texts with the string of an added token go through the library whole. The cache keeps
    the first different pieces, up to CACHE; all ids come from the library.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.ends = kind, None
        if kind == "words":
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[k for word, k in vocab.items() if word.endswith(END)]] = True
        self.cache, self.flat, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), BATCH):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False)]
        return out

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self._ids(pieces)
        return np.frombuffer(b"".join(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number in each. Words go through the library by lines, as a line costs half."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        lines = [words[at : at + LINE] for at in range(0, len(words), LINE)]
        for line, made in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            own = np.array(made.ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[own]), prepend=-1)
            if len(size) != len(line) or size.sum() != len(own):
                own, size = self._each(line)
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _new(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if self.ends is None:
            return self._each(pieces.to_pylist())
        plain = pc.match_substring_regex(pieces, WORD)
        word = plain.to_numpy(zero_copy_only=False)
        ids, size = zip(self._words(pc.utf8_ltrim(pieces.filter(plain), " ").to_pylist()), self._each(pieces.filter(pc.invert(plain)).to_pylist()), strict=True)
        n, first = np.zeros((2, len(pieces)), np.int64)
        for k, which in enumerate((word, ~word)):
            n[which], first[which] = size[k], np.cumsum(size[k]) - size[k] + k * len(ids[0])
        return gathered(np.concatenate(ids), first, n), n

    def _known(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin there, and their number."""
        at = pc.index_in(pieces, value_set=self.cache)
        missing = at.is_null()
        new, to = pieces.filter(missing), at.fill_null(0).to_numpy().astype(np.int64)
        ids, n = self._new(new)
        to[missing.to_numpy(zero_copy_only=False)] = len(self.size) + np.arange(len(new))
        flat, size = np.concatenate([self.flat, ids]), np.concatenate([self.size, n])
        first = np.cumsum(size) - size
        if len(new) and len(size) <= CACHE:
            self.cache, self.flat, self.size = pa.concat_arrays([self.cache, new]), flat, size
        return flat, first[to], size[to]

    def encode_array(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls are empty), and the n + 1 offsets of each text's ids."""
        raw = bytes(text_buffer(text)[0])
        if self.kind == "whole" or any(x.encode() in raw for x in self.added):
            return self._texts([x or "" for x in text.to_pylist()])
        return self._pieces(text)

    def _pieces(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = text_buffer(text)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        at = cuts(raw, ends)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        flat, first, size = self._known(pieces.dictionary)
        which = pieces.indices.to_numpy()
        n = size[which]
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        return gathered(flat, first[which], n), to[np.searchsorted(at, ends)]

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Those with the string of an added token whole, the others by pieces."""
        odd = [self.kind == "whole" or any(x in t for x in self.added) for t in texts]
        rest = pa.array([t for t, x in zip(texts, odd, strict=True) if not x], pa.string())
        ids, to = self._pieces(rest)
        own, others = iter(self._ids([t for t, x in zip(texts, odd, strict=True) if x])), iter(zip(to[:-1].tolist(), to[1:].tolist(), strict=True))
        parts = [np.frombuffer(next(own), np.uint32) if x else ids[slice(*next(others))] for x in odd]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        ids, to = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    if (path, kind) not in _open:
        _open[path, kind] = Encoder(path, kind)
    return _open[path, kind]
