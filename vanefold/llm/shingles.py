"""Word shingles as 64-bit hashes, for whole batches of texts at once.

Words are runs of bytes other than space and the bytes 9 to 13, after A-Z are lower-cased; `bytes.lower` and
`bytes.split` do exactly that. A shingle is five words in a row. A text of one to four words has one shingle, the whole
sequence; a text without words has none. Hashes are 64 bits wide: two shingles of one pair of texts meet by chance with
a probability below 1e-11 even at a million words a text.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from vanefold.llm.common import remembered

WORDS = 5
#: Distinct words whose hash a worker remembers.
REMEMBERED = 200_000
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(1, WORDS + 1)], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


_hashes = remembered(_WordHashes())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every shingle, in order, with repetitions."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        sizes[i] = len(w)
        words += w
    n = len(words)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = (ends[owner] - np.arange(n)) if n else np.zeros(0, dtype=np.int64)
    full = np.flatnonzero(left >= WORDS)
    h = np.zeros(len(full), dtype=np.uint64)
    for i in range(WORDS):
        h += w[full + i] * _ODD[i]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        extra = np.array([sum(int(w[ends[i] - sizes[i] + j]) * int(_ODD[j]) for j in range(sizes[i])) + int(sizes[i]) & 0xFFFFFFFFFFFFFFFF for i in short], dtype=np.uint64)
        h, who = np.concatenate([h, extra]), np.concatenate([owner[full], short])
    else:
        who = owner[full]
    return mix(h), who


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    h, who = shingle_hashes(texts)
    if len(who) and (np.diff(who) < 0).any():
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    cuts = np.searchsorted(who, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
