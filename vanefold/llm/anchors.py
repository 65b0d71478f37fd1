"""Anchors of all windows of a byte string: where the least k-mer of each window lies, and hashes of what surrounds it.

Equal windows have their anchor at the same place, so equal windows share the k-mer at it. Windows in a row with one
anchor make a context, the bytes that they cover.
"""

from __future__ import annotations

import numpy as np

from vanefold.llm.shingles import mix

KMER = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Windows that are looked at in one go; longer texts take several.
CHUNK = 1 << 19
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE), np.full(m, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` gives the hash of any span, whatever its place."""
    up, _ = _power(len(data) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(values)
    m = -(-n // width) * width
    full = np.full(m, np.uint64(2**64 - 1))
    full[:n] = values
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, window: int) -> dict[str, np.ndarray]:
    """k-mer, context hash, first and last window start and anchor of every context of a string."""
    out: list[tuple] = []
    for at in range(0, len(raw) - window + 1, CHUNK):
        data = np.frombuffer(raw[at : at + CHUNK + window - 1], dtype=np.uint8)
        sums = prefix_sums(data)
        n = len(data) - KMER + 1
        place = np.arange(n)
        kmers = span_hash(sums, place, place + KMER)
        mark = np.uint64((1 << 20) - 1)
        least = (sliding_least((kmers & ~mark) | place.astype(np.uint64), window - KMER + 1) & mark).astype(np.int64)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        a = least[first]
        whole = span_hash(sums, first, last + window)
        context = mix(whole + (a - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (last - first).astype(np.uint64))
        out.append((kmers[a], context, first + at, last + at, a + at))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 5
    return dict(zip(("kmer", "context", "first", "last", "anchor"), parts, strict=True))
