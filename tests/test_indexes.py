"""Layered and guided graphs, cells of int8 codes, stored indexes, live graphs, classifiers, export and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanefold import cli
from vanefold.functions import register
from vanefold.functions.vectors import Metric
from vanefold.operators import graph, guided, kernels, layered, live, search
from vanefold.operators.classify import TagClassifier
from vanefold.sources import store

N = 400


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(21)
    middles = r.normal(size=(12, 16))
    x = middles[np.arange(N) % 12] + r.normal(size=(N, 16)) * 0.3
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vector array<double>").cache()
    return v.filter("id % 40 = 1").select(F.col("id").alias("query_id"), "vector").cache(), v


def same(a, b):
    key = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in d.collect())
    return key(a) == key(b)


@pytest.mark.parametrize("int8", [False, True])
def test_layered_graphs(spark, rows, int8, monkeypatch):
    monkeypatch.setattr(layered, "SHARD", 150)
    q, v = rows
    g = layered.hnsw(v, Metric.COSINE, 8, 60, int8).cache()
    want = search.exact(q, v, 5, Metric.COSINE)
    assert g.select("shard").distinct().count() == 3 and g.filter(F.size("layers") > 1).count() > 0
    assert same(layered.hnsw_search(q, g, 5, Metric.COSINE, N, int8=int8), want)
    assert search.recall(layered.hnsw_search(q, g, 5, Metric.COSINE, 48, int8=int8), want).first()[0] >= 0.9
    gone = v.filter("id % 5 = 0")
    got = layered.hnsw_search(q, g, 5, Metric.COSINE, N, "id % 3 = 0", gone, int8)
    assert same(got, search.exact(q, v, 5, Metric.COSINE, "id % 3 = 0 and id % 5 != 0"))
    if not int8:
        new = spark.createDataFrame([(1000, [5.0] * 16), (3, [-5.0] * 16)], "id long, vector array<double>")
        more = layered.hnsw_added(g, new, Metric.COSINE, 3, 8, 60)
        assert same(layered.hnsw_search(q, more, 5, Metric.COSINE, N), search.exact(q, search.upserted(v, new), 5, Metric.COSINE))


def test_guided_graphs(spark, rows):
    q, v = rows
    g, books, shards = guided.built(v, Metric.L2, 16, 48, 1.2, 4, 32)
    want = search.exact(q, v, 5, Metric.L2)
    assert same(guided.search(q, g, books, 5, Metric.L2, N), want)
    assert search.recall(guided.search(q, g, books, 5, Metric.L2, 96), want).first()[0] >= 0.9
    gone = v.filter("id % 5 = 0")
    left = search.exact(q, v, 5, Metric.L2, "id % 5 != 0")
    assert same(guided.search(q, g, books, 5, Metric.L2, N, deleted=gone), left)
    assert same(guided.search(q, guided.consolidated(g, books, gone, 16, 48), books, 5, Metric.L2, N), left)
    new = spark.createDataFrame([(1000, [0.1] * 16)], "id long, vector array<double>")
    assert same(guided.search(q, guided.inserted(g, books, shards, new, Metric.L2, 16, 48), books, 5, Metric.L2, N + 1), search.exact(q, v.unionByName(new), 5, Metric.L2))


def test_cells_of_codes_and_cell_graph(rows):
    q, v = rows
    coded, held = kernels.ivf(v, Metric.COSINE)
    assert len(held.centroids) == 20
    assert same(kernels.cell_search(q, coded, held, 5, 20, N), search.exact(q, v, 5, Metric.COSINE))
    assert search.recall(kernels.cell_search(q, coded, held, 5, 20, 2), search.exact(q, v, 5, Metric.COSINE)).first()[0] >= 0.9
    key = lambda d: sorted((r["src"], r["dst"], round(r["weight"], 5)) for r in d.collect())
    assert key(graph.knn_edges_in_cells(v, 4, Metric.COSINE, 8, 8)) == key(graph.knn_edges(v, 4, Metric.COSINE))


def test_spread_starts_and_empty_cells():
    x = np.repeat(np.eye(3), [50, 30, 1], axis=0)
    assert len(np.unique(kernels.lloyd(x, 3, 4, plus_plus=True), axis=0)) == 3
    assert len(np.unique(kernels.lloyd(x, 3, 4), axis=0)) == 3
    books = kernels.Codebooks.fitted(np.random.default_rng(1).normal(size=(60, 8)), 2, 8, 5)
    table = kernels.code_distance(books)
    assert table.shape == (2, 8, 8) and np.allclose(table, table.transpose(0, 2, 1)) and np.isclose(table[1, 2, 5], ((books.books[1][2] - books.books[1][5]) ** 2).sum())


def written_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("command", [c for c in cli.DEFAULTS if c not in ("build-hnsw-q", "build-opq")])
def test_commands_store_what_they_find_again(spark, rows, tmp_path, capsys, command):
    q, v = rows
    r = v.filter("id < 120").orderBy("id").collect()
    vectors = written_lines(tmp_path / "v.csv", ["# vectors", *(f"{x['id']},{','.join(map(str, x['vector']))}" for x in r)])
    queries = written_lines(tmp_path / "q.csv", [f"{x['id']},{','.join(map(str, x['vector']))}" for x in r[:3]])
    small = {"build-pq": ["--m", "4", "--ksub", "16"], "build-ivfpq": ["--m", "4", "--ksub", "16"], "build-diskann": ["--m", "4", "--ksub", "16"]}.get(command, [])
    for _ in range(2):  # the second replaces the first
        cli.run(spark, [command, vectors, str(tmp_path / "index"), *small])
    cli.run(spark, ["search", str(tmp_path / "index"), queries, "--k", "3"])
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert len(lines) == 9 and [(x[0], x[2]) for x in lines if x[1] == "0"] == [("0", "0"), ("1", "1"), ("2", "2")]
    told = store.info(store.load(spark, str(tmp_path / "index")))
    assert told["count"] == 120 and told["dim"] == 16 and told["metric"] == "cosine" and store.kind_of(spark, str(tmp_path / "index")) == told["kind"]
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "nothing"))


def test_graph_commands(spark, rows, tmp_path, capsys):
    _, v = rows
    r = v.filter("id < 60").orderBy("id").collect()
    vectors = written_lines(tmp_path / "v.csv", [f"{x['id']},{','.join(map(str, x['vector']))}" for x in r])
    links = written_lines(tmp_path / "l.csv", ["0,1", "0,999"])
    meta = written_lines(tmp_path / "m.tsv", [f'{i}\tnote "{i}"\tt{i % 12},all' for i in range(60)])
    at = str(tmp_path / "graph")
    cli.run(spark, ["build-graph", vectors, at, "--links", links, "--meta", meta, "--k", "3"])
    cli.run(spark, ["export", at])
    doc = json.loads("".join(capsys.readouterr().out.splitlines()))
    assert [n["id"] for n in doc["nodes"]] == list(range(60)) and doc["nodes"][7]["label"] == 'note "7"' and doc["nodes"][7]["tags"] == ["all", "t7"]
    assert len(doc["edges"]) == 181 and {"source": 0, "target": 1, "weight": 1.0, "kind": "link"} in doc["edges"]
    assert doc["nodes"][0]["degree"] == 4 and all("community" in n for n in doc["nodes"])
    assert [e["weight"] for e in doc["edges"] if e["source"] == 5] == sorted((e["weight"] for e in doc["edges"] if e["source"] == 5), reverse=True)
    cli.run(spark, ["related", at, "0", "--k", "1"])
    cli.run(spark, ["by-tag", at, "t3"])
    cli.run(spark, ["suggest-tags", at, written_lines(tmp_path / "q.csv", [f"3,{','.join(map(str, r[3]['vector']))}"])])
    cli.run(spark, ["info", at])
    out = capsys.readouterr().out
    assert out.startswith("1\t1.000000\tlink\n3\tnote") and "\n3\tall\t" in out and "edges\t181" in out


def test_metadata_and_neighbourhoods(spark):
    nodes = spark.createDataFrame([(i, "old", ["x"]) for i in range(6)], "id long, title string, tags array<string>")
    meta = spark.createDataFrame([(1, " ", ["b", "a", "b"]), (2, "two", None)], "id long, title string, tags array<string>")
    new = {r["id"]: (r["title"], r["tags"]) for r in graph.with_metadata(nodes, meta).collect()}
    assert new[1] == (None, ["a", "b"]) and new[2] == ("two", []) and new[0] == (None, [])
    assert [r["tag"] for r in graph.tag_names(meta).orderBy("place").collect()] == ["a", "b"]
    edges = spark.createDataFrame([(i, (i + 1) % 6, 0.5 + i / 10, "semantic") for i in range(6)] + [(0, 3, 0.1, "link")], "src long, dst long, weight double, kind string")
    start = nodes.filter("id = 0").select("id")
    near = graph.neighborhood(edges, start, 2, "id != 1")
    assert {r["id"]: r["depth"] for r in near.collect()} == {0: 0, 3: 1, 4: 2}
    assert {(r["src"], r["dst"]) for r in graph.neighborhood_edges(edges, near, 2).collect()} == {(0, 3), (3, 4)}
    assert graph.capped(edges, 1).filter("src = 0").first()["dst"] == 1
    assert graph.described(edges, meta).first().asDict() == {"nodes": 2, "edges": 7, "tags": 2, "avg_degree": 3.5}


def test_many_rounds_can_be_planned(spark):
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 20, 1.0) for i in range(20)] + [(i, (i + 1) % 20, 0.5) for i in range(0, 20, 2)], "src long, dst long, weight double")
    nodes = spark.range(21)
    assert abs(graph.pagerank(edges, nodes, 20).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert graph.communities(edges, nodes, 9).count() == 21


def test_classifier(spark, rows):
    q, v = rows
    tagged = v.withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("id") % 12).cast("string"))))
    c = TagClassifier(tagged)
    got = {r["query_id"]: r["tag"] for r in c.suggest(q, 5, 0.5).collect()}
    assert got == {r["query_id"]: f"t{r['query_id'] % 12}" for r in q.collect()}
    other = c.add(tagged.withColumn("tags", F.array(F.lit("new"))))
    assert {r["tag"] for r in other.suggest(q).collect()} == {"new"}


def test_live_graphs(spark):
    r = np.random.default_rng(2)
    x = {i: r.normal(size=4).tolist() for i in range(8)}
    e = [(1, i, "insert", i, x[i], f"n{i}", ["odd" if i % 2 else "even"], None, 2) for i in range(6)]
    e += [(1, 6, "link", 0, None, None, None, 5, None), (1, 7, "link", 0, None, None, None, 77, None), (1, 8, "insert", 3, x[7], "again", ["z"], None, 1)]
    e += [(1, 9, "remove", 1, None, None, None, None, None), (1, 10, "insert_tagged", 6, x[0], None, None, None, 1), (1, 11, "meta", 2, None, "", ["b", "a"], None, None)]
    e += [(2, 0, "insert", 1, x[1], None, None, None, None)]
    nodes, edges = live.replayed(spark.createDataFrame(e[::-1], live.EVENTS), Metric.L2, 2)
    own = {(n["graph"], n["id"]): (n["title"], n["tags"]) for n in nodes.collect()}
    assert set(own) == {(1, i) for i in (0, 2, 3, 4, 5, 6)} | {(2, 1)}
    assert own[1, 3] == ("again", ["z"]) and own[1, 2] == (None, ["a", "b"])
    got = {(a["src"], a["dst"]): (a["weight"], a["kind"]) for a in edges.filter("graph = 1").collect()}
    assert all(1 not in k for k in got) and got[0, 5][1] in ("link", "both") and (0, 77) not in got
    assert got[6, 0] == got[0, 6] == (0.0, "semantic") and edges.filter("graph = 2").count() == 0
    assert all((b, a) in got for (a, b), (_, kind) in got.items() if kind != "link")


def test_sql_functions(spark, rows):
    _, v = rows
    v.createOrReplaceTempView("collection")
    register.register(spark, "collection")
    q = v.filter("id = 9").first()["vector"]
    got = spark.sql(f"SELECT id FROM knn_search(array({','.join(f'{x}D' for x in q)}), 3) ORDER BY place").collect()
    want = search.exact(v.filter("id = 9").select(F.col("id").alias("query_id"), "vector"), v, 3, Metric.L2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    one = spark.sql("SELECT vector_dot(array(1D, 2D), array(3D, 4D)) a, vector_l2sq(array(1D, 2D), array(3D, 4D)) b, vector_cosine(array(1D, 0D), array(2D, 0D)) c, int8_quantize(array(1D, -0.5D, 0D)) d").first()
    assert tuple(one)[:3] == (11.0, 8.0, 1.0) and one["d"] == [127, -64, 0]
