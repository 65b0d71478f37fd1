"""Proximity graphs walked by compressed vectors (DiskANN): product codes guide the beam, exact vectors rank what it met.

The graph is that of `proximity`, flat and in shards. A walk reads codes alone; the exact vectors of the rows it met are
read for the rerank, in the true metric. New rows are coded with the codebooks there are and their shards linked anew;
deleted rows are walked over until their shards are consolidated. Codebooks are fitted on a bounded sample, rows are
read and written by tasks, so a build needs no more memory than a shard whatever the size of the collection.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric, prepared
from vanefold.operators.kernels import SAMPLE, Codebooks, matrix, ready, sampled
from vanefold.operators.proximity import SHARD, _linked, _scanned, _walk
from vanefold.operators.search import BLOCK, _hits, top_k

GRAPH = "shard int, id long, v array<double>, place int, links array<int>, start int, codes binary"


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).select("shard", "id", "v")


def _graph(placed: DataFrame, books: Codebooks, degree: int, ef: int, alpha: float) -> DataFrame:
    held = placed.sparkSession.sparkContext.broadcast(books)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        x = np.stack(frame["v"].to_numpy())
        links, start = _linked(x, degree, max(ef, degree), alpha)
        return frame.assign(place=range(len(frame)), links=links, start=start, codes=[c.tobytes() for c in held.value.encode(x)])[[c.split()[0] for c in GRAPH.split(", ")]]

    return placed.groupBy("shard").applyInPandas(build, GRAPH)


def built(collection: DataFrame, metric: Metric, degree: int = 32, ef: int = 96, alpha: float = 1.2, m: int = 16, ksub: int = 256, sample: int = SAMPLE) -> tuple[DataFrame, Codebooks, int]:
    """(graph, codebooks, number of shards)."""
    rows = ready(collection, metric)
    books = Codebooks.fitted(sampled(rows, sample), m, ksub, 15)
    shards = max(1, -(-rows.count() // SHARD))
    return _graph(_dealt(rows, shards), books, degree, ef, alpha), books, shards


def inserted(graph: DataFrame, books: Codebooks, shards: int, rows: DataFrame, metric: Metric, degree: int = 32, ef: int = 96, alpha: float = 1.2) -> DataFrame:
    """graph with the rows in place of those with their ids; shards that get none stay as they are."""
    new = _dealt(ready(rows, metric), shards)
    touched = F.broadcast(new.select("shard").distinct())
    old = graph.join(touched, "shard", "left_semi").select("shard", "id", "v").join(new.select("id"), "id", "left_anti").select("shard", "id", "v")
    return graph.join(touched, "shard", "left_anti").select([c.split()[0] for c in GRAPH.split(", ")]).unionByName(_graph(old.unionByName(new), books, degree, ef, alpha))


def consolidated(graph: DataFrame, books: Codebooks, deleted: DataFrame, degree: int = 32, ef: int = 96, alpha: float = 1.2) -> DataFrame:
    """graph without the deleted ids; only their shards are linked anew."""
    gone = deleted.select("id").distinct()
    touched = F.broadcast(graph.join(gone, "id", "left_semi").select("shard").distinct())
    old = graph.join(touched, "shard", "left_semi").join(gone, "id", "left_anti").select("shard", "id", "v")
    return graph.join(touched, "shard", "left_anti").select([c.split()[0] for c in GRAPH.split(", ")]).unionByName(_graph(old, books, degree, ef, alpha))


def search(queries: DataFrame, graph: DataFrame, books: Codebooks, k: int, metric: Metric, ef: int = 64, where: str | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): the whole beam, of at least ef rows, is scored exactly."""
    marked = graph.withColumn("passes", F.coalesce(F.expr(where or "true"), F.lit(False)))
    if deleted is not None:
        marked = marked.join(deleted.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left").withColumn("passes", F.col("passes") & F.col("gone").isNull()).drop("gone")
    asked = queries.select("query_id", prepared(F.col("vector"), metric).alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    sc, parts = queries.sparkSession.sparkContext, []
    for i in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        held = sc.broadcast((got.column("query_id").to_numpy(), matrix(got.column("q").combine_chunks()), books))
        parts.append(marked.groupBy("shard").applyInPandas(_walker(held, k, metric, ef), "query_id long, id long, key double"))
    return _hits(top_k(reduce(DataFrame.unionByName, parts), k), metric)


def _walker(held, k: int, metric: Metric, ef: int):
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        ids, queries, books = held.value
        frame = frame.sort_values("place")
        x = books.decode(np.frombuffer(b"".join(frame["codes"]), dtype=np.uint8).reshape(len(frame), -1))
        exact, own, passes = np.stack(frame["v"].to_numpy()), frame["id"].to_numpy(), frame["passes"].to_numpy()
        links, start, found = [list(n) for n in frame["links"]], int(frame["start"].iloc[0]), []
        for query, q in zip(ids, queries, strict=True):
            wide = max(ef, k)
            while wide < len(x):
                met = np.array([n for _, n in _walk(x, links, start, q, wide, Metric.L2) if passes[n]], dtype=np.int64)
                if len(met) >= k:
                    break
                wide *= 2
            else:
                found += [(query, n, key) for key, n in _scanned(exact, own, passes, q, k, metric)]
                continue
            keys = ((exact[met] - q) ** 2).sum(1) if metric is Metric.L2 else -(exact[met] @ q)
            best = np.lexsort((own[met], keys))[:k]
            found += zip([query] * len(best), own[met][best].tolist(), keys[best].tolist(), strict=True)
        return pd.DataFrame(found, columns=["query_id", "id", "key"]).astype({"query_id": "int64", "id": "int64", "key": "float64"})

    return walk
