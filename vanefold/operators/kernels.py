"""Scans of compressed vectors in cells by NumPy kernels over Arrow batches: RaBitQ, IVF+RaBitQ, OPQ and IVF+PQ.

Models (rotation, codebooks, centroids) are fitted on the driver from at most SAMPLE rows, those with the least hashes
of their ids; every row is encoded. Blocks of queries meet blocks of codes (`pairs`), so what a task holds is bounded.
Candidates meet their exact vectors in a join on the id. Ids are unique, vectors are not null and of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric, prepared
from vanefold.operators import pairs
from vanefold.operators.pairs import BLOCK
from vanefold.operators.search import _hits, live, recall, scanned, top_k
from vanefold.sources.shared import cleaned

#: Rows from which models are fitted at most.
SAMPLE = 50_000
#: Rows by which a search's recall is measured, and the recall at which widening ends.
MEASURED, TARGET = 256, 0.95


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def ready(collection: DataFrame, metric: Metric, where: Column | str | None = None) -> DataFrame:
    return live(collection, where).select("id", prepared(F.col("vector"), metric).alias("v"))


def sampled(rows: DataFrame, most: int = SAMPLE) -> np.ndarray:
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow().column("v").combine_chunks()
    return matrix(got)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T


def spread(x: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """k-means++ starts: each next row is drawn by its squared distance from the nearest one drawn before."""
    r = np.random.default_rng([seed, len(x), n])
    at = [int(r.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    for _ in range(1, n):
        total = near.sum()
        at.append(int(np.searchsorted(np.cumsum(near), r.random() * total)) if total > 0 else int(r.integers(len(x))))
        at[-1] = min(at[-1], len(x) - 1)
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at].copy()


def lloyd(x: np.ndarray, n: int, rounds: int, renormalize: bool = False, plus_plus: bool = False) -> np.ndarray:
    """Centroids after so many rounds, from evenly spaced rows or k-means++ starts.

    An empty cell takes the row that is farthest from its own centroid, so no cell stays empty while rows differ.
    """
    n = min(n, len(x))
    c = spread(x, n) if plus_plus and n else x[np.arange(n) * len(x) // max(n, 1)].copy()
    for _ in range(max(rounds, 1)):
        d = distances(x, c)
        near = d.argmin(1)
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
        for cell, row in zip(np.flatnonzero(size == 0), np.argsort(-d[np.arange(len(x)), near], kind="stable"), strict=False):
            c[cell] = x[row]
        if renormalize:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
    return c


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """A random orthonormal matrix; the seed fixes it."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Codebooks:
    """m books of at most 256 codes over equal parts of the components, after a rotation."""

    books: list[np.ndarray]
    turn: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray, m: int, ksub: int, rounds: int, turns: int = 0) -> Codebooks:
        """With turns > 0 the rotation is fitted as well: codes and rotation take turns, the latter by Procrustes."""
        if not len(x) or x.shape[1] % m:
            raise ValueError("the number of parts must divide the dimension, and there must be rows")
        own = Codebooks([], np.eye(x.shape[1]))
        for i in range(turns + 1):
            y = x @ own.turn.T
            own = Codebooks([lloyd(p, min(ksub, 256), rounds) for p in np.split(y, m, axis=1)], own.turn)
            if i < turns:
                u, _, vt = np.linalg.svd(cross_gram(x, own.decode(own.encode(x), False)))
                own = Codebooks(own.books, vt.T @ u.T)
        return own

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([distances(p, b).argmin(1) for p, b in zip(np.split(x @ self.turn.T, len(self.books), axis=1), self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, back: bool = True) -> np.ndarray:
        y = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return y @ self.turn if back else y


class ProductCells:
    """Codes of what is left of a vector beside its cell's centroid."""

    fields = (("codes", pa.binary()),)

    def __init__(self, centroids: np.ndarray, books: Codebooks, metric: Metric):
        self.centroids, self.books, self.metric = centroids, books, metric

    def encode(self, x: np.ndarray, cell: np.ndarray) -> list[pa.Array]:
        return [pa.array([c.tobytes() for c in self.books.encode(x - self.centroids[cell])], pa.binary())]

    def keys(self, q: np.ndarray, cell: int, rows: pairs.Arrays) -> np.ndarray:
        x = self.books.decode(rows["codes"]) + self.centroids[cell]
        return distances(q, x) if self.metric is Metric.L2 else -q @ x.T


class BitCells:
    """RaBitQ: the signs of the rotated rest beside the cell's centroid, with three numbers, against 4-bit queries."""

    fields = (("bits", pa.binary()), ("res_sq", pa.float64()), ("coef", pa.float64()), ("oc", pa.float64()))

    def __init__(self, centroids: np.ndarray, turn: np.ndarray, metric: Metric):
        self.centroids, self.turn, self.metric = centroids, turn, metric

    def encode(self, x: np.ndarray, cell: np.ndarray) -> list[pa.Array]:
        c = self.centroids[cell]
        r = (x - c) @ self.turn.T
        sq, total = (r * r).sum(1), np.abs(r).sum(1)
        coef = np.divide(sq, total, out=np.zeros_like(sq), where=total > 0)
        return [pa.array([b.tobytes() for b in np.packbits(r >= 0, axis=1)], pa.binary()), pa.array(sq), pa.array(coef), pa.array((x * c).sum(1))]

    def keys(self, q: np.ndarray, cell: int, rows: pairs.Arrays) -> np.ndarray:
        dim, c = q.shape[1], self.centroids[cell]
        bits = np.unpackbits(rows["bits"], axis=1)[:, :dim].astype(np.float64)
        sq, coef, oc = (rows[f] for f in ("res_sq", "coef", "oc"))
        rest = q - c
        p = rest @ self.turn.T
        low = p.min(1, keepdims=True)
        step = np.maximum((p.max(1, keepdims=True) - low) / 15, 1e-9)
        levels = np.clip(np.rint((p - low) / step), 0, 15)
        s = step * (2 * levels @ bits.T - levels.sum(1, keepdims=True)) + low * (2 * bits.sum(1)[None, :] - dim)
        inner = coef[None, :] * s
        if self.metric is Metric.L2:
            return sq[None, :] + (rest * rest).sum(1)[:, None] - 2 * inner
        return -(inner + oc[None, :] + (q @ c)[:, None] - c @ c)


def code_distance(books: Codebooks) -> np.ndarray:
    """SDC: squared L2 between all codes of each part, (part, code, code)."""
    return np.stack([((b[:, None, :] - b[None, :, :]) ** 2).sum(2) for b in books.books])


def cross_gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum over rows of the outer products of x and y, what the rotation of OPQ is fitted to."""
    return x.T @ y


def encoded(rows: DataFrame, cells: Cells) -> DataFrame:
    """(id, v, cell, codes...): each row in the cell of its nearest centroid by squared L2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                cell = distances(x, cells.centroids).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), *cells.encode(x, cell)], names=["id", "v", "cell", *(f for f, _ in cells.fields)])

    types = {pa.binary(): "binary", pa.float64(): "double"}
    return rows.mapInArrow(run, "id long, v array<double>, cell int, " + ", ".join(f"{f} {types[t]}" for f, t in cells.fields))


def _probes(q: np.ndarray, centroids: np.ndarray, metric: Metric, n: int) -> np.ndarray:
    to_cell = distances(q, centroids) if metric is Metric.L2 else -q @ centroids.T
    return np.argsort(to_cell, axis=1, kind="stable")[:, : max(1, n)]


def _cell_keys(q: pairs.Arrays, rows: pairs.Arrays, cell: int, cells: Cells) -> np.ndarray:
    return cells.keys(q["q"], cell, rows)


def cell_search(queries: DataFrame, rows: DataFrame, cells: Cells, k: int, n_probe: int, oversample: int = 1, where: Column | str | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the best rows of the probed cells; with oversample > 1 candidates are scored exactly."""
    metric = cells.metric
    asked = queries.select("query_id", prepared(F.col("vector"), metric).alias("q"))
    kept = (rows if where is None else rows.filter(where)).select("id", "v", "cell", *(f for f, _ in cells.fields))
    return scanned(asked, kept, k, oversample, metric, partial(_cell_keys, cells=cells), probes=partial(_probes, centroids=cells.centroids, metric=metric, n=n_probe))


def widened(rows: DataFrame, cells: Cells, k: int, n_probe: int, oversample: int, target: float = TARGET) -> tuple[int, int]:
    """(n_probe, oversample), doubled from those given until the recall of MEASURED rows reaches the target.

    Each measured row is a query for its k nearest other rows, as finding itself would say nothing. Probes double while
    cells are left, and oversampling until all rows are candidates, where the search is exact; so it ends.
    """
    metric, n = cells.metric, rows.count()
    asks = rows.orderBy(F.xxhash64("id"), "id").limit(MEASURED).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    if not n:
        return n_probe, oversample
    asks = asks.sparkSession.createDataFrame(asks.toArrow())
    truth = exact_blocks(asks, rows.withColumnRenamed("v", "vector"), k + 1, metric).filter("query_id != id")
    truth = truth.sparkSession.createDataFrame(truth.toArrow())  # at most MEASURED * (k + 1) rows
    while n_probe < len(cells.centroids) or k * oversample < n:
        got = cell_search(asks, rows, cells, k + 1, n_probe, oversample).filter("query_id != id")
        with cleaned(asks.sparkSession):
            reached = recall(got, truth).first()[0]
        if reached >= target:
            break
        n_probe, oversample = min(2 * n_probe, len(cells.centroids)), 2 * oversample
    return n_probe, oversample


class Int8Cells:
    """int8 codes with a scale and the squared norm a row; queries are coded alike."""

    fields = (("codes", pa.binary()), ("scale", pa.float64()), ("sqnorm", pa.float64()))

    def __init__(self, centroids: np.ndarray, metric: Metric):
        self.centroids, self.metric = centroids, metric

    @staticmethod
    def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, scales, squared norms); codes are rounded half away from zero."""
        scale = np.abs(x).max(1) / 127 if x.size else np.zeros(len(x))
        scale[scale == 0] = 1.0
        y = x / scale[:, None]
        return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127).astype(np.int8), scale, (x * x).sum(1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> list[pa.Array]:
        codes, scale, norms = self.coded(x)
        return [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(norms)]

    def keys(self, q: np.ndarray, cell: int, rows: pairs.Arrays) -> np.ndarray:
        codes = rows["codes"].view(np.int8).astype(np.float64)
        scale, norms = rows["scale"], rows["sqnorm"]
        qc, qs, qn = self.coded(q)
        inner = (qc.astype(np.float64) @ codes.T) * qs[:, None] * scale[None, :]
        return qn[:, None] + norms[None, :] - 2 * inner if self.metric is Metric.L2 else -inner


Cells = ProductCells | BitCells | Int8Cells
Built = tuple[DataFrame, Cells]


def centroids(x: np.ndarray, n_cells: int, rounds: int, metric: Metric) -> np.ndarray:
    """n_cells 0 stands for the root of the number of rows."""
    n = n_cells or max(1, int(len(x) ** 0.5))
    return lloyd(x, n, rounds, metric is Metric.COSINE, True) if n > 1 else x.mean(0, keepdims=True)


def rabitq(collection: DataFrame, metric: Metric, n_cells: int = 1, rounds: int = 12, seed: int = 1) -> Built:
    """One cell around the mean, or several (IVF+RaBitQ)."""
    rows = ready(collection, metric)
    x = sampled(rows)
    cells = BitCells(centroids(x, n_cells, rounds, metric), rotation(x.shape[1], seed), metric)
    return encoded(rows, cells), cells


def ivf_pq(collection: DataFrame, metric: Metric, n_cells: int = 0, m: int = 16, ksub: int = 256, rounds: int = 15) -> Built:
    rows = ready(collection, metric)
    x = sampled(rows)
    centres = centroids(x, n_cells, rounds, metric)
    rest = x - centres[distances(x, centres).argmin(1)]
    cells = ProductCells(centres, Codebooks.fitted(rest, m, ksub, rounds), metric)
    return encoded(rows, cells), cells


def ivf(collection: DataFrame, metric: Metric, n_cells: int = 0, rounds: int = 12) -> Built:
    """Inverted-file cells of int8 codes; their candidates are scored exactly when a search oversamples."""
    rows = ready(collection, metric)
    cells = Int8Cells(centroids(sampled(rows), n_cells, rounds, metric), metric)
    return encoded(rows, cells), cells


def opq(collection: DataFrame, metric: Metric, m: int = 16, ksub: int = 256, rounds: int = 20, turns: int = 4) -> Built:
    rows = ready(collection, metric)
    x = sampled(rows)
    cells = ProductCells(np.zeros((1, x.shape[1])), Codebooks.fitted(x, m, ksub, rounds, turns), metric)
    return encoded(rows, cells), cells


def exact_blocks(queries: DataFrame, collection: DataFrame, k: int, metric: Metric, where: Column | str | None = None) -> DataFrame:
    """The same rows as `search.exact`, for many queries. Work is queries by rows; beyond some million rows, take a search
    through cells instead."""
    q = queries.select("query_id", prepared(F.col("vector"), metric).alias("q"))
    return _hits(top_k(pairs.nearest(q, ready(collection, metric, where), k, metric, BLOCK), k), metric)
