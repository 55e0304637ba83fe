"""Word hashes of many texts at once, straight from Arrow's UTF-8 buffers, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19  # bytes of text that are hashed at a time
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashes the words of texts; ``is_word`` tells which bytes belong to words, ``lower`` folds A-Z.

    A word is a longest run of word bytes, so bytes of 128 and more must be all in or all out. Equal words have equal hashes
    wherever they stand; different words differ but for 64-bit collisions.
    """

    def __init__(self, is_word: np.ndarray, lower: bool = True):
        codes = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
        if lower:
            codes[65:91] = codes[97:123]
        self.is_word, self.codes = is_word, np.where(is_word, codes, np.uint64(0))
        self.up, self.down = _powers(int(_MULT)), _powers(pow(int(_MULT), -1, 1 << 64))

    def spans(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each word of a block; no word crosses a cut."""
        word = self.is_word[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[cuts] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        start = np.flatnonzero(word & (~before | cut[:-1]))
        end = np.flatnonzero(word & (~after | cut[1:])) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=total[1:])
        # The second term keeps the length: runs that differ only in trailing codes of equal sum stay apart.
        return start, end, mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yields (first text, text after the last, word hashes, word offsets by text); NULL is a text without words."""
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            kind = np.int64
        else:
            texts, kind = texts.cast(pa.string()), np.int32
        if not len(texts):
            return
        at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            part = data[at[i] : at[j]]
            if len(part) <= BLOCK:
                start, _, hashes = self.spans(part, at[i : j + 1] - at[i])
                yield i, j, hashes, np.searchsorted(start, at[i : j + 1] - at[i])
            else:
                hashes = self._long(part)
                yield i, j, hashes, np.array([0, len(hashes)])
            i = j

    def _long(self, part: np.ndarray) -> np.ndarray:
        """Hashes of one text longer than a block, cut between words; a word longer than a block is hashed piece by piece."""
        found, lo = [], 0
        while lo < len(part):
            hi = min(lo + BLOCK, len(part))
            if hi < len(part):
                gaps = np.flatnonzero(~self.is_word[part[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:  # one word fills the block: take all of it
                    rest = np.flatnonzero(~self.is_word[part[hi:]])
                    end = hi + int(rest[0]) if len(rest) else len(part)
                    whole = np.zeros(1, np.uint64)
                    for k in range(lo, end, BLOCK):
                        whole = mix(whole * _MULT + self.spans(part[k : min(k + BLOCK, end)], np.zeros(1, int))[2])
                    found.append(whole)
                    lo = end
                    continue
            found.append(self.spans(part[lo:hi], np.zeros(1, int))[2])
            lo = hi
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, by the position of its first word."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, power = np.zeros(n, np.uint64), 1
    for k in range(length):
        total += hashes[k : k + n] * np.uint64(power)
        power = power * int(_MULT) % (1 << 64)
    return mix(total + np.uint64(length))


def runs_at(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """As ``runs``, at the given first words only."""
    total, power = np.zeros(len(starts), np.uint64), 1
    for k in range(length):
        total += hashes[starts + k] * np.uint64(power)
        power = power * int(_MULT) % (1 << 64)
    return mix(total + np.uint64(length))


def space_separated() -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z folded."""
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return Words(table)


def letters_and_digits() -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z folded."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return Words(table)
