"""Word shingles of texts as sorted arrays of 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 18
_RANDOM = np.random.default_rng(977)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A to Z count as lower case
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(size, CHUNK_BYTES + 2), base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def _chunks(texts: list[str]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        raw = text.encode()
        if part and size + len(raw) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text. Fewer words than ``width`` make one shingle; no words make none."""
    for part in _chunks(texts):
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        space = _SPACE[data]
        up, down = _powers_of(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_BYTE[data] * up[: len(data)])])
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        starts = np.flatnonzero(edge == -1)
        ends = np.flatnonzero(edge == 1)
        words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
        limits = np.cumsum([len(raw) + 1 for raw in part])
        until = np.searchsorted(starts, limits)
        counts = np.diff(np.concatenate([[0], until]))
        n = max(0, len(words) - width + 1)
        grams = np.zeros(n, np.uint64)
        for i in range(width):
            grams += words[i : i + n] * _PLACE[i]
        grams = mixed(grams)
        first = 0
        for count in counts.tolist():
            if count >= width:
                yield np.unique(grams[first : first + count - width + 1])
            elif count:
                short = np.append(words[first : first + count] * _PLACE[:count], _PLACE[32 + count])
                yield mixed(np.add.accumulate(short)[-1:])
            else:
                yield np.empty(0, np.uint64)
            first += count
    if _powers and len(_powers[0]) > 2 * CHUNK_BYTES:
        _powers.clear()  # a long text's; the process outlives the task
