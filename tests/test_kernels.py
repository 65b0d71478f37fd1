"""Compressed scans against exact search, and the text sources."""

import numpy as np
import pytest

from vanefold.functions.vectors import Metric
from vanefold.operators import kernels, search
from vanefold.sources import text


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(5)
    centres = r.uniform(-1, 1, (20, 32))
    x = centres[np.arange(1500) % 20] + r.uniform(-0.1, 0.1, (1500, 32))
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "id long, vector array<float>").repartition(3).cache()
    q = spark.createDataFrame([(i, [float(y) for y in row + 0.01]) for i, row in enumerate(centres)], "query_id long, vector array<float>")
    return q, v


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("build", [lambda v, m: kernels.rabitq(v, m), lambda v, m: kernels.rabitq(v, m, 16), lambda v, m: kernels.ivf_pq(v, m, 16, 8, 64, 5), lambda v, m: kernels.opq(v, m, 8, 64, 5, 2)])
def test_recall_after_rerank(clustered, build, metric):
    q, v = clustered
    rows, cells = build(v, metric)
    got = kernels.cell_search(q, rows, cells, 10, 16, 16)
    assert search.recall(got, search.exact(q, v, 10, metric)).first()[0] >= 0.95
    odd = kernels.cell_search(q, rows, cells, 10, 16, 16, "id % 3 = 0")
    assert odd.filter("id % 3 != 0").count() == 0 and odd.count() == 200


def test_no_queries(clustered):
    q, v = clustered
    rows, cells = kernels.rabitq(v, Metric.L2)
    assert kernels.cell_search(q.limit(0), rows, cells, 10, 1).count() == 0


def test_rotations_are_orthonormal(clustered):
    r = kernels.rotation(32)
    assert np.allclose(r @ r.T, np.eye(32))
    turn = kernels.opq(clustered[1], Metric.L2, 8, 16, 3, 2)[1].books.turn
    assert np.allclose(turn @ turn.T, np.eye(32))


def test_text_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text("0,1,0\n# comment\n\n 1 , 0.5, 2\nbad,1,2\n")
    got = text.read_vectors(spark, str(tmp_path / "v.csv"), strict=False)
    assert sorted((r["id"], list(r["vector"])) for r in got.collect()) == [(0, [1.0, 0.0]), (1, [0.5, 2.0])]
    assert text.uniform_dimension(got) == 2
    with pytest.raises(Exception, match="not a vector row"):
        text.read_vectors(spark, str(tmp_path / "v.csv")).collect()
    (tmp_path / "n.tsv").write_text("1\tone\ta, b,\n2\n")
    assert sorted((r["id"], r["title"], list(r["tags"])) for r in text.read_nodes(spark, str(tmp_path / "n.tsv")).collect()) == [(1, "one", ["a", "b"]), (2, None, [])]
    (tmp_path / "l.csv").write_text("1,2\n")
    assert [tuple(r) for r in text.read_links(spark, str(tmp_path / "l.csv")).collect()] == [(1, 2)]
    rows = np.array([[1.5, 2.0], [3.0, 4.0]], "<f4")
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.int32(2).tobytes() + r.tobytes() for r in rows))
    assert [(r["id"], list(r["vector"])) for r in text.read_vecs(spark, str(tmp_path / "x.fvecs")).orderBy("id").collect()] == [(0, [1.5, 2.0]), (1, [3.0, 4.0])]
    hits = spark.createDataFrame([(0, 0, 7, 0.25)], "query_id long, rank long, id long, score double")
    assert text.hit_lines(hits).first()[0] == "0\t0\t7\t0.250000"


@pytest.mark.parametrize("metric", list(Metric))
def test_exact_blocks_equal_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(kernels, "BLOCK", 20)
    r = np.random.default_rng(4)
    x = r.standard_normal((60, 5))
    x[40:] = x[:20]  # ties
    rows = spark.createDataFrame([(i, v.tolist(), i % 9 == 0) for i, v in enumerate(x)], "id long, vector array<double>, deleted boolean").repartition(3)
    q = rows.selectExpr("id as query_id", "vector")
    want = sorted(map(tuple, search.exact(q, rows, 4, metric).collect()))
    assert sorted(map(tuple, kernels.exact_blocks(q, rows, 4, metric).collect())) == want
    assert kernels.exact_blocks(q, rows.limit(0), 4, metric).count() == 0
    assert kernels.exact_blocks(q.limit(0), rows, 4, metric).count() == 0


@pytest.mark.parametrize("build", [lambda v: kernels.rabitq(v, Metric.COSINE, 16), lambda v: kernels.ivf_pq(v, Metric.COSINE, 16, 8, 16, 4)])
def test_searches_widen_to_their_target(spark, build):
    r = np.random.default_rng(6)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.standard_normal((1200, 32)))], "id long, vector array<float>").repartition(3)
    q = v.filter("id % 30 = 0").selectExpr("id as query_id", "vector")
    rows, cells = build(v)
    truth = search.exact(q, v, 10, Metric.COSINE)
    assert search.recall(kernels.cell_search(q, rows, cells, 10, 2, 2), truth).first()[0] < 0.9
    assert search.recall(kernels.cell_search(q, rows, cells, 10, *kernels.widened(rows, cells, 10, 2, 2)), truth).first()[0] >= 0.9
