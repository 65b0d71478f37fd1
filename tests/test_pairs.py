"""The step that scores queries against rows: no scored pair is sorted or shuffled, and copies cost little."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric, normalized, norm
from vanefold.operators import cells, graph, kernels, pairs, search

SCANS = {
    "exact": lambda q, v: search.exact(q, v, 5, Metric.COSINE),
    "int8": lambda q, v: search.int8_scan(q, v, 5, Metric.L2, 8),
    "hamming": lambda q, v: search.binary_scan(q, v, 5, Metric.COSINE, 16, 4),
    "ivf": lambda q, v: cells.ivf_search(q, *cells.ivf_built(v, Metric.COSINE, 4, 1), 5, Metric.COSINE, 3),
    "cells": lambda q, v: kernels.cell_search(q, *kernels.ivf(v, Metric.COSINE, 4, 1), 5, 4, 8),
    "knn": lambda q, v: graph.knn_edges(v, 5, Metric.COSINE),
    "knn_in_cells": lambda q, v: graph.knn_edges_in_cells(v, 5, Metric.COSINE, 4, 4),
}


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).standard_normal((900, 16))
    x[300:] = x[7]  # one large group of copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3).cache()
    return rows.filter("id % 20 = 0").selectExpr("id as query_id", "vector"), rows, x


@pytest.mark.parametrize("name", SCANS)
def test_pairs_are_scored_by_blocks(table, name):
    plan = SCANS[name](*table[:2])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "NestedLoopJoin" not in plan.split("CartesianProduct")[0]


@pytest.mark.parametrize("name", ["int8", "cells"])
def test_rows_are_not_broadcast(table, name):
    plan = SCANS[name](*table[:2])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("metric", list(Metric))
def test_copies_and_ties(table, metric):
    q, rows, x = table
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric is Metric.COSINE else x
    met = []
    for a in y[::20]:
        keys = ((y - a) ** 2).cumsum(1)[:, -1] if metric is Metric.L2 else -(y * a).cumsum(1)[:, -1]
        met.append(np.lexsort((np.arange(900), keys))[:6].tolist())
    got = search.exact(q, rows, 6, metric).orderBy("query_id", "rank").collect()
    assert [[r["id"] for r in got if r["query_id"] == i] for i in range(0, 900, 20)] == met


def test_copies_beyond_k_leave_before_rows_meet(table):
    rows = kernels.ready(table[1], Metric.L2).coalesce(1)
    packed = pairs._packed(rows.sortWithinPartitions(F.xxhash64("v"), "id"), "r_", 50, 6)
    assert packed.agg(F.sum("r_n")).first()[0] == 299 + 6


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e20])
def test_bounds_hold_at_any_scale(spark, metric, scale):
    x = np.random.default_rng(8).standard_normal((400, 8)) * scale
    x[:, 0] += 100 * scale  # keys far larger than what tells them apart
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric is Metric.COSINE else x
    a = y[5]
    keys = ((y - a) ** 2).cumsum(1)[:, -1] if metric is Metric.L2 else -(y * a).cumsum(1)[:, -1]
    got = search.exact(rows.filter("id = 5").selectExpr("id as query_id", "vector"), rows, 9, metric).orderBy("rank").collect()
    if metric is Metric.COSINE:  # the norms of NumPy differ by rounding
        assert len(got) == 9 and {r["id"] for r in got[:7]} <= set(np.argsort(keys)[:12].tolist())
    else:
        assert [r["id"] for r in got] == np.lexsort((np.arange(400), keys))[:9].tolist()


def test_many_candidates_are_selected_as_sorted():
    r = np.random.default_rng(2)
    at, keys, ids = r.integers(0, 3, 5000), r.integers(0, 40, 5000).astype(float), r.permutation(5000)
    best = pairs._Best(3, pairs.MANY)
    for part in np.array_split(np.arange(5000), 7):
        best.add(at[part], keys[part], ids[part])
        best.cut()
    for i in range(3):
        want = sorted(zip(keys[at == i], ids[at == i], strict=True))[: pairs.MANY]
        mine = best.held[0] == i
        assert sorted(zip(best.held[1][mine], best.held[2][mine], strict=True)) == want
        assert best.limit[i] == want[-1][0]


def test_norms_are_computed_once_a_row(spark):
    v = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(1, 5)]).alias("v"))
    told = v.select(normalized(F.col("v")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("SQRT") == 1
    assert v.select(norm(normalized(F.col("v")))).first()[0] == pytest.approx(1)
