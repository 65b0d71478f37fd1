"""Graphs are built once, however often what is asked of them reads their edges."""

import pytest

from vanefold.operators import graph
from vanefold.plans import catalogue


@pytest.mark.parametrize("name", ["neighborhood_keep", "neighborhood_edges", "pagerank"])
def test_graph_is_built_once(spark, monkeypatch, name):
    made, real = spark.sparkContext.accumulator(0), graph.knn_edges

    def counted(*a):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return real(*a).mapInArrow(run, "src long, dst long, weight double")

    monkeypatch.setattr(graph, "knn_edges", counted)
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert made.value == 2500


def test_mutual_reads_edges_once(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.4), (4, 4, 1.0), (5, 1, 0.1)], "src long, dst long, weight double")
    got = graph.mutual(edges)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0.5), (2, 1, 0.5), (4, 4, 1.0)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
