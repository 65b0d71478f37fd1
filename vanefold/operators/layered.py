"""Layered small-world graphs (HNSW) in shards, of vectors or of their int8 codes.

A shard is a hash of the id and is built in one task. A row's top layer is drawn from a geometric law by a hash of its
id, so a rebuild gives the same graph. A new row descends greedily from the entry to its top layer, then a beam of
ef_construction rows is thinned on each layer (a link stays where no kept one is nearer to its end), links go both ways
and are thinned again beyond M, twice M on the lowest layer. A search descends to the lowest layer and walks it with a
beam of ef. With ef of at least a shard's size results equal exact search, as rows that thinning cuts off hang on the
entry.

With int8 codes, links and walks go by what the codes stand for, and with the exact vectors kept the whole beam is
scored again by them. Rows are added by building the shards they fall in anew; deleted rows are walked over but never
returned, and leave when the graph is compacted. Ids are unique; tables without rows give graphs without rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from vanefold.functions.vectors import Metric, prepared
from vanefold.operators.kernels import Int8Cells, matrix, ready
from vanefold.operators.proximity import _scanned, _thinned, _walk
from vanefold.operators.search import BLOCK, _hits, top_k

#: Rows of one shard on average.
SHARD = 20_000
GRAPH = "shard int, id long, v array<double>, place int, layers array<array<int>>, entry int"


def top_layer(row: int, m: int) -> int:
    """floor(-ln u / ln M) with u from a hash of the id."""
    u = (xxh3_64_intdigest(int(row).to_bytes(8, "little", signed=True)) + 1) / 2**64
    return int(-np.log(u) / np.log(max(m, 2)))


def _nearest(x: np.ndarray, links: list[list[int]], at: int, q: np.ndarray) -> int:
    """Where a greedy walk by squared L2 ends."""
    best = ((x[at] - q) ** 2).sum()
    while links[at]:
        d = ((x[links[at]] - q) ** 2).sum(1)
        i = int(d.argmin())
        if d[i] >= best:
            break
        at, best = links[at][i], d[i]
    return at


def _built(x: np.ndarray, ids: np.ndarray, m: int, ef: int) -> tuple[list[list[list[int]]], int]:
    """(links by layer and place, entry)."""
    tops = [top_layer(i, m) for i in ids]
    layers: list[list[list[int]]] = [[[] for _ in ids] for _ in range(max(tops) + 1)]
    entry = 0
    for p in range(1, len(ids)):
        at = entry
        for layer in range(tops[entry], tops[p], -1):
            at = _nearest(x, layers[layer], at, x[p])
        for layer in range(min(tops[p], tops[entry]), -1, -1):
            links, most = layers[layer], 2 * m if layer == 0 else m
            met = [n for _, n in _walk(x, links, at, x[p], ef, Metric.L2)]
            links[p] = _thinned(x, p, np.array(met), m, 1.0)
            for n in links[p]:
                links[n].append(p)
                if len(links[n]) > most:
                    links[n] = _thinned(x, n, np.array(links[n]), most, 1.0)
            at = met[0]
        if tops[p] > tops[entry]:
            entry = p
    reached, todo = {entry}, [entry]
    while todo:
        for n in layers[0][todo.pop()]:
            if n not in reached:
                reached.add(n)
                todo.append(n)
    layers[0][entry] += [i for i in range(len(ids)) if i not in reached]
    return layers, entry


def _as_coded(x: np.ndarray) -> np.ndarray:
    codes, scale, _ = Int8Cells.coded(x)
    return codes * scale[:, None]


def _shards(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))


def _graph(placed: DataFrame, m: int, ef: int, int8: bool) -> DataFrame:
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        x = np.stack(frame["v"].to_numpy())
        layers, entry = _built(_as_coded(x) if int8 else x, frame["id"].to_numpy(), m, max(ef, m))
        own = [[links[p] for links in layers if p == entry or links is layers[0] or links[p]] for p in range(len(frame))]
        return frame.assign(place=range(len(frame)), layers=own, entry=entry)[["shard", "id", "v", "place", "layers", "entry"]]

    return placed.groupBy("shard").applyInPandas(build, GRAPH)


def hnsw(collection: DataFrame, metric: Metric, m: int = 16, ef_construction: int = 200, int8: bool = False) -> DataFrame:
    """(shard, id, v, place, layers, entry): a row for each live one; layers are its links, lowest first, as places in the shard."""
    rows = ready(collection, metric)
    return _graph(_shards(rows, max(1, -(-rows.count() // SHARD))), m, ef_construction, int8)


def hnsw_added(graph: DataFrame, rows: DataFrame, metric: Metric, shards: int, m: int = 16, ef_construction: int = 200, int8: bool = False) -> DataFrame:
    """graph, of so many shards, with the rows in place of those with their ids. Only shards that get a row are built anew."""
    new = _shards(ready(rows, metric), shards)
    touched = F.broadcast(new.select("shard").distinct())
    old = graph.join(touched, "shard", "left_semi").select("id", "v", "shard").join(new.select("id"), "id", "left_anti")
    return graph.join(touched, "shard", "left_anti").select(*[c.split()[0] for c in GRAPH.split(", ")]).unionByName(_graph(old.unionByName(new.select("id", "v", "shard")), m, ef_construction, int8))


def hnsw_search(queries: DataFrame, graph: DataFrame, k: int, metric: Metric, ef: int = 64, where: str | None = None, deleted: DataFrame | None = None, int8: bool = False, rerank: bool = True) -> DataFrame:
    """(query_id, rank, id, score). What `where` or `deleted` (id) leaves out is walked over but not returned; the beam widens
    until k rows pass or the shard is met whole."""
    marked = graph.withColumn("passes", F.coalesce(F.expr(where or "true"), F.lit(False)))
    if deleted is not None:
        gone = deleted.select("id").distinct().withColumn("gone", F.lit(True))
        marked = marked.join(gone, "id", "left").withColumn("passes", F.col("passes") & F.col("gone").isNull()).drop("gone")
    asked = queries.select("query_id", prepared(F.col("vector"), metric).alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    parts = []
    for i in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        q = matrix(got.column("q").combine_chunks())
        held = queries.sparkSession.sparkContext.broadcast((got.column("query_id").to_numpy(), q, _as_coded(q) if int8 else q))
        parts.append(marked.groupBy("shard").applyInPandas(_walker(held, k, metric, ef, int8, rerank), "query_id long, id long, key double"))
    return _hits(top_k(reduce(DataFrame.unionByName, parts), k), metric)


def _walker(held, k: int, metric: Metric, ef: int, int8: bool, rerank: bool):
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        exact = np.stack(frame["v"].to_numpy())
        x = _as_coded(exact) if int8 else exact
        own, passes, entry = frame["id"].to_numpy(), frame["passes"].to_numpy(), int(frame["entry"].iloc[0])
        layers = [[list(n) for n in row] for row in frame["layers"]]
        lowest = [row[0] for row in layers]
        upper = [[row[i] if len(row) > i else [] for row in layers] for i in range(1, max(map(len, layers)))]
        found = []
        for query, vector, coded in zip(*held.value, strict=True):
            at, wide = entry, max(ef, k)
            for links in reversed(upper) if wide < len(x) else ():
                at = _nearest(x, links, at, coded)
            while wide < len(x):
                met = [(key, n) for key, n in _walk(x, lowest, at, coded, wide, metric) if passes[n]]
                if len(met) >= k:
                    break
                wide *= 2
            else:
                found += [(query, n, key) for key, n in (_scanned(exact, own, passes, vector, k, metric) if rerank or not int8 else _scanned(x, own, passes, coded, k, metric))]
                continue
            if int8 and rerank and met:
                places = [n for _, n in met]
                keys = ((exact[places] - vector) ** 2).sum(1) if metric is Metric.L2 else -(exact[places] @ vector)
                met = list(zip(keys.tolist(), places, strict=True))
            found += [(query, own[n], key) for key, n in heapq.nsmallest(k, met, key=lambda r: (r[0], own[r[1]]))]
        return pd.DataFrame(found, columns=["query_id", "id", "key"]).astype({"query_id": "int64", "id": "int64", "key": "float64"})

    return walk
