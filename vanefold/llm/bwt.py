"""Burrows-Wheeler transforms of shards of byte strings, merged by interleave refinement, and their repeated intervals.

Each shard's suffixes are sorted once, to the depth asked for. The merged order starts with the shards one after
another. A round extends the order by one symbol: the elements' preceding symbols are sorted stably and each element
moves on by its shard's own LF mapping, so that after h rounds the merged order is right for the first h symbols. No
suffix is compared with another shard's, and no suffix is sorted anew. Groups of neighbours that agree so far are
refined along with the order: a boundary between two neighbours stays once it is found, and its round is their common
prefix. An element alone in its group stays alone, as whatever it moves on to has those symbols too, so it leaves the
order. After `depth` rounds, what is left are intervals of two or more suffixes that share `depth` symbols.
"""

from __future__ import annotations

import numpy as np

#: Bytes of one shard.
SHARD = 1 << 14
#: Rounds after which elements alone in their groups leave the order.
EVERY = 8


def shard_transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array to `depth`, preceding symbols 1 to 256, or 0 where a string starts); each string ends with a 0 symbol of its own."""
    symbols = np.concatenate([np.concatenate([np.frombuffer(s, dtype=np.uint8).astype(np.int32) + 1, [0]]) for s in strings])
    n = len(symbols)
    starts = np.cumsum([0] + [len(s) + 1 for s in strings[:-1]])
    ends = np.flatnonzero(symbols == 0)
    key = symbols.astype(np.int64)
    key[ends] = np.arange(len(ends)) - len(ends)  # ends differ from each other and precede all symbols
    _, rank = np.unique(key, return_inverse=True)
    order, h = np.argsort(rank, kind="stable"), 1
    while h < depth and rank.max() < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - h] = rank[h:] + 1
        both = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(both, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.diff(both[order], prepend=both[order[0]]) != 0)
        h *= 2
    before = symbols[order - 1].astype(np.int16)
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    before[first[order]] = 0
    return order, before


def merged(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """Positions in the shards' joined suffix arrays, in merged order, of the suffixes that share `depth` symbols with another."""
    before = np.concatenate([b for _, b in shards]).astype(np.uint16)
    offsets = np.cumsum([0] + [len(b) for _, b in shards[:-1]])
    step = np.concatenate([o + _last_to_first(b) for o, (_, b) in zip(offsets, shards, strict=True)]).astype(np.int32)
    order = np.arange(len(before), dtype=np.int32)
    group = np.zeros(len(before), dtype=np.int32)
    for done in range(1, depth + 1):
        symbol = before[order]
        by = np.argsort(symbol, kind="stable")
        symbol, own = symbol[by], group[by]
        edge = symbol[1:] != symbol[:-1]
        edge |= own[1:] != own[:-1]
        edge |= symbol[1:] == 0  # ends agree with nothing
        group = np.zeros(len(order), dtype=np.int32)
        np.cumsum(edge, out=group[1:])
        order = step[order[by]]
        if done == depth or not done % EVERY:
            edges = np.concatenate([[True], edge, [True]])
            several = ~(edges[1:] & edges[:-1])
            order, group = order[several], group[several]
            if not len(order):
                break
    return order


def _last_to_first(before: np.ndarray) -> np.ndarray:
    """Where the suffix that is one symbol longer lies."""
    out = np.empty(len(before), dtype=np.int64)
    out[np.argsort(before, kind="stable")] = np.arange(len(before))
    return out


def repeated_starts(strings: list[bytes], depth: int, counts: list[int]) -> list[np.ndarray]:
    """For each string, the starts of its substrings of `depth` bytes that start elsewhere too, in any of the strings.

    counts[i] is how often string i occurs; all of a string that occurs twice is repeated.
    """
    shards, held, size, at = [], [], 0, 0
    where_text, where_at = [], []

    def close() -> None:
        nonlocal held, size, at
        if held:
            order, before = shard_transform(held, depth)
            owner = np.repeat(np.arange(len(held)), [len(s) + 1 for s in held])
            start = np.concatenate([np.arange(len(s) + 1) for s in held])
            where_text.append(at + owner[order])
            where_at.append(start[order])
            shards.append((order, before))
            at += len(held)
            held, size = [], 0

    for s in strings:
        held.append(s)
        size += len(s)
        if size >= SHARD:
            close()
    close()
    if not shards:
        return []
    order = merged(shards, depth)
    text, start = np.concatenate(where_text)[order], np.concatenate(where_at)[order]
    once = np.array(counts)[text] == 1
    text, start = text[once], start[once]
    by = np.lexsort((start, text))
    text, start = text[by], start[by]
    cuts = np.searchsorted(text, np.arange(len(strings) + 1))
    return [start[a:b] if n == 1 else np.arange(max(0, len(t) - depth + 1)) for a, b, t, n in zip(cuts[:-1], cuts[1:], strings, counts, strict=True)]
