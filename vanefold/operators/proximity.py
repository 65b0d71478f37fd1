"""Proximity graphs in shards: a small-world graph per shard, searched best first, with the shards' results merged.

The shard of a row is a hash of its id, so one with at most SHARD rows is built in one task whatever the size of the
collection, and a lost executor costs its shards alone. A graph is flat: each row is linked with the nearest rows found
so far, thinned by the rule that a link is kept where no kept one is nearer to its end by the factor alpha, and links
go both ways within `degree`. A beam of `ef` rows walks it from the row nearest to the mean. With ef of at least the
shard's size the shard is scanned, which is what such a walk would meet, and results equal exact search. Deleted rows are left out at build time. Links are
chosen by squared L2, scores are exact in the metric.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric, prepared
from vanefold.operators.kernels import matrix, ready
from vanefold.operators.pairs import _summed
from vanefold.operators.search import BLOCK, _hits, top_k

#: Rows of one shard on average.
SHARD = 20_000


def _thinned(x: np.ndarray, p: int, pool: np.ndarray, degree: int, alpha: float) -> list[int]:
    pool = np.unique(pool[pool != p])
    d = ((x[pool] - x[p]) ** 2).sum(1)
    kept: list[int] = []
    for i in np.lexsort((pool, d)):
        c = int(pool[i])
        if not kept or (alpha * ((x[kept] - x[c]) ** 2).sum(1) > d[i]).all():
            kept.append(c)
            if len(kept) == degree:
                break
    return kept


def _walk(x: np.ndarray, links: list[list[int]], start: int, q: np.ndarray, ef: int, metric: Metric) -> list[tuple[float, int]]:
    """The ef best rows that a walk from start reaches, best first; a smaller key is better."""

    def keys(at: list[int]) -> np.ndarray:
        return ((x[at] - q) ** 2).sum(1) if metric is Metric.L2 else -(x[at] @ q)

    first = (float(keys([start])[0]), start)
    todo, best, seen = [first], [(-first[0], -start)], {start}
    while todo:
        k, at = heapq.heappop(todo)
        if len(best) >= ef and k > -best[0][0]:
            break
        new = [n for n in links[at] if n not in seen]
        seen.update(new)
        for key, n in zip(keys(new).tolist() if new else [], new, strict=True):
            if len(best) < ef or key < -best[0][0]:
                heapq.heappush(todo, (key, n))
                heapq.heappush(best, (-key, -n))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-k, -n) for k, n in best)


def _scanned(x: np.ndarray, own: np.ndarray, passes: np.ndarray, q: np.ndarray, k: int, metric: Metric) -> list[tuple[float, int]]:
    """(key, id) of the k best of all rows that pass, best first: what a walk with a beam as wide as the shard would meet."""
    rough = (x * x).sum(1) - 2 * (x @ q) + q @ q if metric is Metric.L2 else -(x @ q)
    at = np.flatnonzero(passes)
    if len(at) > k:
        near = rough[at]
        at = at[near <= np.partition(near, k - 1)[k - 1] + 1e-11 * (np.sqrt(q @ q) + np.sqrt((x * x).sum(1).max())) ** 2]
    keys = _summed(q[None, :], x, np.zeros(len(at), dtype=np.int64), at, metric)
    return [(float(keys[i]), int(own[at[i]])) for i in np.lexsort((own[at], keys))[:k]]


def _linked(x: np.ndarray, degree: int, ef: int, alpha: float) -> tuple[list[list[int]], int]:
    links: list[list[int]] = [[] for _ in range(len(x))]
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(len(x)).permutation(len(x))
    for p in [start, *(int(i) for i in order if i != start)]:
        if p == start:
            continue
        met = np.array([n for _, n in _walk(x, links, start, x[p], ef, Metric.L2)])
        links[p] = _thinned(x, p, met, degree, alpha)
        for n in links[p]:
            links[n].append(p)
            if len(links[n]) > 2 * degree:
                links[n] = _thinned(x, n, np.array(links[n]), degree, alpha)
    reached, todo = {start}, [start]
    while todo:
        for n in links[todo.pop()]:
            if n not in reached:
                reached.add(n)
                todo.append(n)
    # thinning may cut rows off; each of them hangs on the entry, so that all stay within reach
    links[start] += [i for i in range(len(x)) if i not in reached]
    return links, start


def graph_built(collection: DataFrame, metric: Metric, degree: int = 16, ef: int = 100, alpha: float = 1.2) -> DataFrame:
    """(shard, id, v, place, links, start): a row for each live one, links as places within the shard."""
    rows = ready(collection, metric)
    shards = max(1, -(-rows.count() // SHARD))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        links, start = _linked(np.stack(frame["v"].to_numpy()), degree, max(ef, degree), alpha)
        return frame.assign(place=range(len(frame)), links=links, start=start)[["shard", "id", "v", "place", "links", "start"]]

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInPandas(build, "shard int, id long, v array<double>, place int, links array<int>, start int")


def _block(graph: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, metric: Metric, ef: int) -> DataFrame:
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        x, own, passes = np.stack(frame["v"].to_numpy()), frame["id"].to_numpy(), frame["passes"].to_numpy()
        links, start, found = [list(n) for n in frame["links"]], int(frame["start"].iloc[0]), []
        for query, vector in zip(ids, q, strict=True):
            wide = max(ef, k)
            while wide < len(x):
                met = [(key, own[n]) for key, n in _walk(x, links, start, vector, wide, metric) if passes[n]]
                if len(met) >= k:
                    break
                wide *= 2
            else:
                met = _scanned(x, own, passes, vector, k, metric)
            found += [(query, n, key) for key, n in met[:k]]
        return pd.DataFrame(found, columns=["query_id", "id", "key"])

    return graph.groupBy("shard").applyInPandas(walk, "query_id long, id long, key double")


def graph_search(queries: DataFrame, graph: DataFrame, k: int, metric: Metric, ef: int = 64, where: str | None = None) -> DataFrame:
    """(query_id, rank, id, score). A filter decides what is returned, not where the walk goes; the walk widens until it
    has k rows that pass or has met the whole shard."""
    asked = queries.select("query_id", prepared(F.col("vector"), metric).alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    marked = graph.withColumn("passes", F.coalesce(F.expr(where or "true"), F.lit(False)))
    parts = []
    for i in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        parts.append(_block(marked, got.column("query_id").to_numpy(), matrix(got.column("q").combine_chunks()), k, metric, ef))
    return _hits(top_k(reduce(DataFrame.unionByName, parts), k), metric)
