"""Words of many texts at once, as positions and 64-bit hashes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that belong to a word, by rule.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit word over the whole word."""
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of some rows: byte ranges, row of each word, and where each row's words begin."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``limit`` bytes."""
        end = self.end if limit is None else np.minimum(self.end, self.start + limit)
        return byte_hashes(self.text, self.start, end)


def byte_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    length = (end - start).astype(np.int64)
    h = mix(length.astype(np.uint64) * _C + _B)
    todo, at = np.arange(len(start)), start.astype(np.int64)
    while len(todo):
        left = length[todo]
        h[todo] = mix(h[todo] ^ ((eight[at[todo]] & _KEEP[np.minimum(left, 8)]) * _C))
        length[todo] -= 8
        at[todo] += 8
        todo = todo[left > 8]
    return h


def find_words(text: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """Lower-case A-Z and find the runs of ``word`` bytes in each row of ``text``."""
    inside = word[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(text), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(text), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(LOWER[text], start, end, row, first)
