"""Words, shingles and their 64-bit hashes, for tasks that work on Arrow batches.

Words are runs of bytes other than ASCII white space, A to Z lower-cased and no other byte changed. A word's
hash is a polynomial over its bytes, taken for all words of a text at once from running sums. Sets of shingles
are sorted arrays of 64-bit hashes: two sets compare wrongly only when two of their own shingles
collide, about one pair in 10**13.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_BASE = 0xD1342543DE82EF95  # odd, 5 modulo 8: its powers repeat as late as they can
STRETCH = 1 << 20  # bytes of a text hashed at once
TOGETHER = 1 << 18  # bytes of short texts hashed at once


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    out = (values + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)) * _MIX
    out ^= out >> _SHIFT
    out *= _MIX2
    return out ^ (out >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64), 3)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n - 1 at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def _stretch(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where each begins."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [len(data)]))
    starts, ends = edge[0::2], edge[1::2]
    powers, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts], 11), starts


def words_and_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a text in turn, and the byte at which it begins."""
    if len(text) <= STRETCH:
        return _stretch(np.frombuffer(text, np.uint8)) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
    data, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        if end < len(data):  # back to white space, or on to it where a word is longer than a stretch
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(gaps[0]) if len(gaps) else len(data)
        hashes, starts = _stretch(data[at:end])
        parts.append((hashes, starts + at))
        at = end
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


@dataclass
class Run:
    """Some texts one after the other, a line break between two, and all their words.

    ``begins``: each text's first byte, and behind the last one; ``bounds``: each text's first word, and their number.
    """

    data: bytes
    begins: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    bounds: np.ndarray

    def breaks(self) -> np.ndarray:
        """Line breaks' bytes, those between texts included."""
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)

    def inside(self, width: int) -> np.ndarray:
        """Whether each ``width`` consecutive words, by the first one, are of one text."""
        within = np.ones(max(0, len(self.hashes) - width + 1), bool)
        at = (self.bounds[1:-1, None] + np.arange(1 - width, 0)).ravel()
        within[at[(at >= 0) & (at < len(within))]] = False
        return within


def together(texts: Iterable[bytes]) -> Iterator[Run]:
    """All texts in turn, in runs of TOGETHER bytes and the text that goes beyond."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text) + 1
        if held > TOGETHER:
            yield _run(group)
            group, held = [], 0
    if group:
        yield _run(group)


def _run(group: list[bytes]) -> Run:
    data = b"\n".join(group)
    hashes, places = words_and_places(data)
    begins = np.cumsum([0] + [len(t) + 1 for t in group])
    return Run(data, begins, hashes, places, np.searchsorted(places, begins))


def word_hashes(text: bytes) -> np.ndarray:
    return words_and_places(text)[0]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in text order; fewer words make one run; none make none."""
    n = len(hashes)
    width = min(width, n)
    if n == 0:
        return hashes
    out = hashes[: n - width + 1].copy()
    for j in range(1, width):
        out ^= out >> _SHIFT
        out *= _MIX
        out += hashes[j : n - width + 1 + j]
    return mixed(out, width)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return distinct(shingles(word_hashes(text), width))


def shingle_sets(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text in turn."""
    for run in together(texts):
        every = shingles(run.hashes, width)
        for a, b in zip(run.bounds[:-1].tolist(), run.bounds[1:].tolist(), strict=True):
            yield distinct(every[a : b - width + 1] if b - a >= width else shingles(run.hashes[a:b], width))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    out = np.sort(values)
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def packed(values: np.ndarray) -> bytes:
    return values.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)
