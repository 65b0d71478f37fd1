"""Proximity graphs, order-bound graph operators and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric
from vanefold.operators import proximity, search, sequential
from vanefold.streaming import collection


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).uniform(-1, 1, (600, 12))
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "id long, vector array<float>").cache()
    return v.filter("id % 60 = 0").select(F.col("id").alias("query_id"), "vector"), v


@pytest.mark.parametrize("metric", list(Metric))
def test_graph(spark, rows, metric, monkeypatch):
    monkeypatch.setattr(proximity, "SHARD", 250)
    q, v = rows
    g = proximity.graph_built(v, metric).cache()
    want = search.exact(q, v, 5, metric)
    assert g.select("shard").distinct().count() == 3
    assert sorted(map(tuple, proximity.graph_search(q, g, 5, metric, ef=600).collect())) == sorted(map(tuple, want.collect()))
    assert search.recall(proximity.graph_search(q, g, 5, metric, ef=64), want).first()[0] >= 0.95
    few = proximity.graph_search(q, g, 5, metric, ef=16, where="id % 50 = 0")
    assert few.filter("id % 50 != 0").count() == 0 and few.count() == 50


def test_in_order(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0), (1, 3, 0.1), (2, 5, 0.5)], "src long, dst long, weight double")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "id long")
    got = {r["id"]: r["community"] for r in sequential.communities_in_order(e, n, 10).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3] and got[9] not in (got[1], got[3])
    walk = [r["id"] for r in sequential.neighborhood_in_order(e, n, 1, 2, 10).orderBy("place").collect()]
    assert walk == [1, 2, 3, 4, 5]
    assert sequential.neighborhood_in_order(e, n, 77, 2, 10).count() == 0
    assert sequential.neighborhood_in_order(e, n, 1, 2, 2).count() == 2


def test_streams(spark, tmp_path):
    schema = "seq long, id long, vector array<float>, deleted boolean"
    spark.createDataFrame([(1, 10, [1.0, 0.0], None), (2, 20, [0.0, 1.0], False), (3, 10, [0.0, 2.0], None), (4, 20, [0.0, 1.0], True)], schema).write.parquet(str(tmp_path / "in"))
    collection.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c1"), once=True).awaitTermination()
    now = collection.current(spark.read.schema(schema).parquet(str(tmp_path / "log")))
    assert [(r["id"], list(r["vector"])) for r in now.collect()] == [(10, [0.0, 2.0])]
    ask = "query_id long, vector array<float>"
    spark.createDataFrame([(0, [0.0, 1.0])], ask).write.parquet(str(tmp_path / "ask"))
    collection.answer(spark.readStream.schema(ask).parquet(str(tmp_path / "ask")), now, 3, Metric.L2, str(tmp_path / "hits"), str(tmp_path / "c2"), once=True).awaitTermination()
    assert [(r["id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [(10, 1.0)]
