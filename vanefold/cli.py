"""Command line: `python -m vanefold.cli COMMAND ...` builds, searches and describes stored indexes and graphs.

Vectors are lines `id,v0,v1,...`; links `src,dst`; nodes `id<TAB>title<TAB>tag1,tag2`. Hits are lines of query, rank from
0, id and score, parted by tabs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric
from vanefold.operators import graph, guided, kernels, layered, search, sequential
from vanefold.operators.classify import TagClassifier
from vanefold.sources import store, text

#: The defaults of each command that builds an index.
DEFAULTS: dict[str, dict[str, int | float]] = {
    "build": {},
    "build-ivf": {"nlist": 0, "iters": 12},
    "build-hnsw": {"m": 16, "ef_construction": 200},
    "build-hnsw-q": {"m": 16, "ef_construction": 200},
    "build-pq": {"m": 16, "ksub": 256, "iters": 20},
    "build-opq": {"m": 16, "ksub": 256, "iters": 20, "opq_iters": 4},
    "build-ivfpq": {"nlist": 0, "m": 16, "ksub": 256, "iters": 15},
    "build-diskann": {"r": 32, "l_build": 96, "alpha": 1.2, "m": 16, "ksub": 256, "sample": 50_000},
}
SEARCH = {"k": 10, "oversample": 4, "nprobe": 16, "ef": 64}


def build(command: str, rows: DataFrame, metric: Metric, compact: bool = False, **own: int | float) -> store.Index:
    """The index that a build command makes of rows (id, vector)."""
    p = DEFAULTS[command] | own
    if command == "build":
        if compact:
            coded, cells = kernels.ivf(rows, metric, 1, 1)
            return store.of_cells("flat", coded.drop("v"), cells, raw=False)
        return store.Index("flat", metric, {"rows": kernels.ready(rows, metric)}, params={"raw": True})
    if command == "build-ivf":
        return store.of_cells("ivf", *kernels.ivf(rows, metric, p["nlist"], p["iters"]), **p)
    if command in ("build-hnsw", "build-hnsw-q"):
        int8 = command == "build-hnsw-q"
        made = layered.hnsw(rows, metric, p["m"], p["ef_construction"], int8)
        return store.Index("hnsw-q" if int8 else "hnsw", metric, {"rows": made}, params=p)
    if command in ("build-pq", "build-opq"):
        made = kernels.opq(rows, metric, p["m"], p["ksub"], p["iters"], p.get("opq_iters", 0))
        return store.of_cells(command[6:], *made, **p)
    if command == "build-ivfpq":
        return store.of_cells("ivfpq", *kernels.ivf_pq(rows, metric, p["nlist"], p["m"], p["ksub"], p["iters"]), **p)
    made, books, shards = guided.built(rows, metric, p["r"], p["l_build"], p["alpha"], p["m"], p["ksub"], p["sample"])
    models = {"turn": books.turn} | {f"book-{j}": b for j, b in enumerate(books.books)}
    return store.Index("diskann", metric, {"rows": made}, models, p | {"shards": shards})


def searched(index: store.Index, queries: DataFrame, k: int = 10, oversample: int = 4, nprobe: int = 16, ef: int = 64, where: str | None = None) -> DataFrame:
    """(query_id, rank, id, score) by the index's own method."""
    if index.kind == "flat" and "centroids" not in index.models:
        return search.int8_scan(queries, index.rows.withColumnRenamed("v", "vector"), k, index.metric, oversample, where)
    if index.kind in ("hnsw", "hnsw-q"):
        return layered.hnsw_search(queries, index.rows, k, index.metric, ef, where, int8=index.kind == "hnsw-q")
    if index.kind == "diskann":
        m = index.models
        books = kernels.Codebooks([m[f"book-{j}"] for j in range(sum(n.startswith("book-") for n in m))], m["turn"])
        return guided.search(queries, index.rows, books, k, index.metric, ef, where)
    raw = "v" in index.rows.columns
    return kernels.cell_search(queries, index.rows, store.cells_of(index), k, nprobe, oversample if raw else 1, where)


def build_graph(rows: DataFrame, metric: Metric, nodes: DataFrame | None, links: DataFrame | None, k: int = 10, min_weight: float | None = None, mutual: bool = False) -> store.Index:
    edges = graph.built(rows, k, metric, min_weight, mutual, links)
    meta = nodes if nodes is not None else rows.select("id", F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("tags"))
    kept = graph.with_metadata(rows.select("id"), meta).join(kernels.ready(rows, metric), "id")
    return store.Index("graph", metric, {"rows": kept, "edges": edges}, params={"k": k, "directed": True})


def _lines(df: DataFrame, *columns: str) -> None:
    for r in df.select(*columns).toLocalIterator():
        print("\t".join("" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vanefold", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, own in DEFAULTS.items():
        p = commands.add_parser(name)
        p.add_argument("vectors")
        p.add_argument("out")
        p.add_argument("--metric", default="cosine")
        if name == "build":
            p.add_argument("--compact", action="store_true")
        for key, value in own.items():
            p.add_argument(f"--{key.replace('_', '-')}", type=type(value), default=value)
    p = commands.add_parser("search")
    p.add_argument("index")
    p.add_argument("queries")
    for key, value in SEARCH.items():
        p.add_argument(f"--{key}", type=int, default=value)
    commands.add_parser("info").add_argument("index")
    p = commands.add_parser("build-graph")
    p.add_argument("vectors")
    p.add_argument("out")
    p.add_argument("--metric", default="cosine")
    p.add_argument("--links")
    p.add_argument("--meta")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--min-weight", type=float)
    p.add_argument("--mutual", action="store_true")
    for name, own in {"related": {"k": 10}, "neighborhood": {"depth": 2, "max": 50}, "by-tag": {}, "tags": {}, "export": {"iters": 20}}.items():
        p = commands.add_parser(name)
        p.add_argument("index")
        if name in ("related", "neighborhood"):
            p.add_argument("id", type=int)
        if name == "by-tag":
            p.add_argument("tag")
        for key, value in own.items():
            p.add_argument(f"--{key}", type=int, default=value)
    p = commands.add_parser("suggest-tags")
    p.add_argument("index")
    p.add_argument("queries")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--max-tags", type=int, default=5)
    p.add_argument("--min-score", type=float, default=0.15)
    return top


def run(spark: SparkSession, arguments: list[str]) -> None:
    a = parser().parse_args(arguments)
    if a.command in DEFAULTS:
        rows = text.read_vectors(spark, a.vectors)
        text.uniform_dimension(rows)
        own = {key: getattr(a, key) for key in DEFAULTS[a.command]}
        store.save(build(a.command, rows, Metric.parse(a.metric), getattr(a, "compact", False), **own), a.out)
    elif a.command == "build-graph":
        rows = text.read_vectors(spark, a.vectors)
        text.uniform_dimension(rows)
        links = text.read_links(spark, a.links) if a.links else None
        nodes = text.read_nodes(spark, a.meta) if a.meta else None
        store.save(build_graph(rows, Metric.parse(a.metric), nodes, links, a.k, a.min_weight, a.mutual), a.out)
    elif a.command == "info":
        for key, value in store.info(store.load(spark, a.index)).items():
            print(f"{key}\t{value}")
    elif a.command == "search":
        queries = text.read_vectors(spark, a.queries).withColumnRenamed("id", "query_id")
        hits = searched(store.load(spark, a.index), queries, a.k, a.oversample, a.nprobe, a.ef)
        for r in text.hit_lines(hits).toLocalIterator():
            print(r["value"])
    else:
        index = store.load(spark, a.index)
        nodes, edges = index.rows, index.tables["edges"]
        if a.command == "related":
            _lines(graph.related(edges.filter(F.col("src") == a.id), a.k).orderBy("rank"), "dst", "weight", "kind")
        elif a.command == "neighborhood":
            _lines(sequential.neighborhood_in_order(edges, nodes, a.id, a.depth, a.max).orderBy("place"), "id")
        elif a.command == "by-tag":
            _lines(graph.by_tag(nodes, a.tag).orderBy("id"), "id", "title")
        elif a.command == "tags":
            _lines(graph.tag_counts(nodes).orderBy("tag"), "tag", "n")
        elif a.command == "export":
            groups = sequential.communities_in_order(edges, nodes, a.iters)
            _lines(graph.exported(nodes, edges, groups), "line")
        else:
            queries = text.read_vectors(spark, a.queries).withColumnRenamed("id", "query_id")
            told = TagClassifier(nodes.select("id", F.col("v").alias("vector"), "tags"), index.metric).suggest(queries, a.k, a.min_score, 1, a.max_tags)
            _lines(told.orderBy("query_id", F.desc("score"), "tag"), "query_id", "tag", "score", "votes")


def main() -> None:
    spark = SparkSession.builder.appName("vanefold").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
