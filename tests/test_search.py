"""Search operators on random vectors against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric
from vanefold.operators import cells, graph, search

SCHEMA = "id long, vector array<double>"
N, DIM, K = 120, 7, 6


def drawn(seed, n=N):
    """ids with gaps and rows of unequal length, two of them equal and one of zeros."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, DIM)) * r.uniform(0.2, 4, (n, 1))
    x[1], x[n - 1] = x[n // 2], 0
    return np.arange(n) * 3 + 2, x


@pytest.fixture(scope="module")
def table(spark):
    ids, x = drawn(11)
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA).cache()


@pytest.fixture(scope="module")
def asked(spark):
    x = drawn(12, 9)[1]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, vector array<double>").cache()


def truth(metric, k=K, keep=lambda i: True):
    ids, x = drawn(11)
    held = np.array([keep(int(i)) for i in ids])
    ids, x, q = ids[held], x[held], drawn(12, 9)[1]
    if metric is Metric.COSINE:
        x, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, q))
    keys = ((q[:, None] - x[None]) ** 2).sum(2) if metric is Metric.L2 else -(q @ x.T)
    return {a: [int(ids[i]) for i in np.lexsort((ids, np.round(keys[a], 12)))[:k]] for a in range(len(q))}


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", list(Metric))
def test_exact(table, asked, metric):
    got = found(search.exact(asked, table, K, metric))
    want = truth(metric)
    assert all(got[a] == want[a] for a in range(8))  # the last query is zero, where cosines are all equal
    assert found(search.exact(asked, table, K, metric, "id % 4 = 1"))[0] == truth(metric, K, lambda i: i % 4 == 1)[0]


def test_deleted_rows_and_more_than_there_are(table, asked):
    less = search.removed(table, table.filter("id % 7 < 3"))
    want = truth(Metric.L2, 500, lambda i: i % 7 >= 3)
    assert found(search.exact(asked, less, 500, Metric.L2)) == want
    assert search.compacted(less).count() == len(want[0])
    assert not found(search.exact(asked, table.limit(0), K, Metric.L2))


@pytest.mark.parametrize("scan", [lambda q, v: search.int8_scan(q, v, K, Metric.L2, 40), lambda q, v: search.binary_scan(q, v, K, Metric.L2, DIM, 40)])
def test_rerank_of_all_is_exact(table, asked, scan):
    assert found(scan(asked, table)) == truth(Metric.L2)


def test_upsert(spark, table, asked):
    new = asked.filter("query_id = 3").select(F.lit(2).cast("long").alias("id"), "vector")
    got = search.upserted(table, new)
    assert got.count() == N and found(search.exact(asked.filter("query_id = 3"), got, 1, Metric.L2)) == {3: [2]}


def test_unknown_metric():
    with pytest.raises(ValueError):
        Metric.parse("hamming")


def test_cells_hold_the_clusters(spark):
    r = np.random.default_rng(6)
    middles = r.uniform(-50, 50, (5, 3))
    rows = [(i, (middles[i % 5] + r.normal(size=3) * 0.1).tolist()) for i in range(60)]
    centroids, placed = cells.ivf_built(spark.createDataFrame(rows, SCHEMA), Metric.L2, 5, 3)
    assert centroids.count() == 5 and placed.groupBy("cell").agg(F.countDistinct(F.col("id") % 5).alias("n"), F.count("*").alias("m")).filter("n = 1 and m = 12").count() == 5
    q = spark.createDataFrame([(0, middles[2].tolist())], "query_id long, vector array<double>")
    assert all(i % 5 == 2 for i in found(cells.ivf_search(q, centroids, placed, 4, Metric.L2, 1))[0])


def test_merged_links(spark, table):
    e = graph.knn_edges(table, 2, Metric.L2)
    first = {r["src"]: r["dst"] for r in graph.related(e.withColumn("kind", F.lit("")), 1).collect()}
    src = 8
    far = next(i for i in (311, 314) if i != src and i not in {r["dst"] for r in e.filter(F.col("src") == src).collect()})
    m = {(r["src"], r["dst"]): r["kind"] for r in graph.merged(e, spark.createDataFrame([(src, first[src]), (src, far), (src, src), (src, 1)], "src long, dst long"), table).collect()}
    assert m[src, first[src]] == "both" and m[src, far] == "link" and (src, 1) not in m and (src, src) not in m


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
