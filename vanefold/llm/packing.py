"""Packing of documents into sequences of a fixed length, by non-negative least squares over length combinations.

1. Every document's ids, with an end id, are written once to the shared folder, with the part (task) that made them.
   Full windows of a document are sequences of their own. What is left of it, shorter than a window, is its rest.
2. Combinations of up to three rest lengths, and equal shares, that fill a window exactly are enumerated. How often to
   repeat each is the non-negative least squares fit to the histogram of rest lengths (as many bins as a window has
   tokens, whatever the corpus); counts are rounded and held to what there is.
3. The residual rests follow one another, longest first, and are cut where a window ends, so only the last sequence of
   the whole corpus is padded.
4. A rest's place follows from its length and its rank among rests of that length: the ranks before its part (a prefix
   sum over parts) and its rank in the part. These sums, one for each part and length, are looked up beside the ids,
   which don't move; if there are too many to broadcast, rows are dealt out by part and length. No group of equal
   lengths meets in one task.

Null and empty texts are documents of the end id alone. Repeated rows are packed each. Sequence ids are unique, not
dense: those of full windows carry their part in the high bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vanefold.llm.common import limit_batches, small, steps, texts, written
from vanefold.llm.word_ids import word_ids

WINDOW, END_ID = 2048, 1
#: Lengths (by tokens they hold) of which triples are made, and the sweeps of the fit.
TRIPLE_LENGTHS, SWEEPS = 40, 40
#: Sequence ids of full windows: part + 1 times this, plus their number in the part.
STRIDE = 1 << 40

TOKENS = "doc_id long, part long, rest int, rank long, full_before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, rest, rank of the rest in its part and length, full windows before in the part, ids)."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_ids(path), TaskContext.get().partitionId()
        end = coder._pack([end_id])
        ranks = np.zeros(window, dtype=np.int64)
        full = 0
        for b in steps(batches):
            ids = [x + end for x in coder.ids(b.column("text").to_pylist())]
            n = np.array([len(x) // coder.width for x in ids], dtype=np.int64)
            rest, rank, before = n % window, [], []
            for r, k in zip(rest.tolist(), (n // window).tolist(), strict=True):
                rank.append(int(ranks[r]))
                ranks[r] += 1
                before.append(full)
                full += k
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=[x.split()[0] for x in TOKENS.split(", ")],
            )

    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, TOKENS)


def combinations(counts: np.ndarray, window: int = WINDOW) -> list[dict[int, int]]:
    """Shallow multisets of the lengths that occur, each filling the window: length -> how many."""
    there = np.flatnonzero(counts > 0)
    there = there[there > 0]
    have = set(there.tolist())
    out: dict[tuple, dict[int, int]] = {}

    def add(*lengths: int) -> None:
        made: dict[int, int] = {}
        for x in lengths:
            made[x] = made.get(x, 0) + 1
        out[tuple(sorted(lengths))] = made

    for a in there.tolist():
        if 2 * a <= window and window - a in have:
            add(a, window - a)
        if window % a == 0 and 1 < window // a <= 64:
            add(*[a] * (window // a))
    heavy = sorted(have, key=lambda x: (-counts[x] * x, x))[:TRIPLE_LENGTHS]
    for i, a in enumerate(heavy):
        for b in heavy[i:]:
            if window - a - b in have:
                add(a, b, window - a - b)
    return list(out.values())


def non_negative_fit(columns: list[dict[int, int]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that makes |A x - counts| least, by coordinate descent; A's columns are the combinations."""
    x = np.zeros(len(columns))
    left = counts.astype(np.float64).tolist()
    norms = [float(sum(m * m for m in c.values())) for c in columns]
    items = [list(c.items()) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(items):
            step = sum(m * left[i] for i, m in c) / norms[j]
            new = max(0.0, x[j] + step)
            step = new - x[j]
            if step:
                x[j] = new
                for i, m in c:
                    left[i] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


class Plan:
    """Where the rest with a given length and rank goes."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        self.counts = counts.astype(np.int64)
        used = np.zeros(window, dtype=np.int64)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        self.sequences = 0
        columns = combinations(counts, window)
        x = non_negative_fit(columns, counts)
        for j in np.argsort(-x, kind="stable"):
            c = columns[j]
            reps = int(min(round(x[j]), *((self.counts[i] - used[i]) // m for i, m in c.items())))
            if reps <= 0:
                continue
            at = 0
            for i, m in sorted(c.items(), reverse=True):
                for _ in range(m):
                    slots.setdefault(i, []).append((int(used[i]), self.sequences, at))
                    used[i] += reps
                    at += i
            self.sequences += reps
        self.slots = {i: np.array(s, dtype=np.int64) for i, s in slots.items()}
        self.used = used
        residual = (self.counts - used) * np.arange(window)
        self.base = np.concatenate([np.cumsum(residual[::-1])[::-1][1:], [0]])  # tokens of longer residual rests

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the rest, length, sequence, offset)."""
        if rank < self.used[length]:
            s = self.slots[length]
            first, seq, at = s[np.searchsorted(s[:, 0], rank, side="right") - 1].tolist()
            return [(0, length, seq + rank - first, at)]
        pos = int(self.base[length]) + (rank - int(self.used[length])) * length
        out, start = [], 0
        while start < length:
            seq, at = divmod(pos + start, self.window)
            n = min(length - start, self.window - at)
            out.append((start, n, self.sequences + seq, at))
            start += n
        return out


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; each id of each document lies in exactly one piece."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, path, window, end_id), spark)
    per = written(tokens.groupBy("part", "rest").agg(F.count("*").alias("n")), spark)
    counts = np.zeros(window, dtype=np.int64)
    for r in per.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        counts[r["rest"]] = r["n"]
    counts[0] = 0
    plan = Plan(counts, window)
    order = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = written(per.select("part", "rest", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), spark)
    rows = tokens.join(small(before), ["part", "rest"]).select(*[x.split()[0] for x in TOKENS.split(", ")], "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = f"<u{word_ids(path).width}"
        for b in steps(batches, "ids"):
            out: list[tuple] = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "part", "rest", "rank", "full_before", "n_tokens", "before")]
            for (doc, part, rest, rank, full, n, prior), raw in zip(zip(*cols, strict=True), b.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_py(), dtype=dtype).astype("<u4")
                base = n - rest
                cuts = [(w * window, window, (part + 1) * STRIDE + full + w, 0) for w in range(n // window)]
                if rest:
                    cuts += [(base + s, m, seq, at) for s, m, seq, at in plan.places(rest, prior + rank)]
                out += [(doc, s, m, zlib.crc32(ids[s : s + m].tobytes()), n, seq, at) for s, m, seq, at in cuts]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return rows.mapInArrow(run, PIECES)
