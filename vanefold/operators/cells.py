"""k-means, inverted-file cells and product quantization.

Training is Lloyd's rounds over DataFrames: centroids (at most a few thousand rows) are broadcast, every row takes its
nearest one in the JVM, and component means are aggregated by (cell, place). Seeds are the rows with the
least ids, so runs repeat exactly. As in the contract, the assignment returned precedes the last update.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric, key, normalized, prepared, squared_l2
from vanefold.operators import pairs
from vanefold.operators.search import _hits, crossed, live, scanned, top_k


def seeds(rows: DataFrame, n: int) -> DataFrame:
    """(cell, c): the rows with the n least ids, so that runs repeat exactly."""
    first = rows.select("id", "v").orderBy("id").limit(n)
    return first.withColumn("cell", (F.row_number().over(Window.orderBy("id")) - 1).cast("int")).select("cell", F.col("v").alias("c"))


def assigned(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """rows with the cell of the nearest centroid by squared L2; ties go to the lower cell."""
    held = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("cell", "c"))).alias("cs")))
    nearest = F.array_min(F.transform("cs", lambda x: F.struct(squared_l2(F.col("v"), x["c"]).alias("d"), x["cell"].alias("cell"))))["cell"]
    return rows.crossJoin(held).withColumn("cell", nearest).drop("cs")


def means(rows: DataFrame, renormalize: bool) -> DataFrame:
    """(cell, c) of assigned rows."""
    each = rows.select("cell", F.posexplode("v").alias("i", "x")).groupBy("cell", "i").agg(F.avg("x").alias("x"))
    c = each.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return c.withColumn("c", normalized(F.col("c"))) if renormalize else c


def kmeans(rows: DataFrame, n: int, rounds: int, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """(centroids (cell, c), rows with cell). rows: (id, v, ...). An empty cell keeps its centroid."""
    c, out = seeds(rows, n), rows
    for _ in range(max(rounds, 1)):
        out = assigned(rows, c)
        new = means(out, metric is Metric.COSINE)
        c = c.join(new.withColumnRenamed("c", "new"), "cell", "left").select("cell", F.coalesce("new", "c").alias("c"))
        c = c.sparkSession.createDataFrame(c.collect(), c.schema)  # a bounded model: cuts the lineage of the rounds
    return c, out


def ivf_built(collection: DataFrame, metric: Metric, n_cells: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    return kmeans(live(collection).select("id", prepared(F.col("vector"), metric).alias("v")), n_cells, rounds, metric)


def probed(queries: DataFrame, centroids: DataFrame, metric: Metric, n_probe: int) -> DataFrame:
    """(query_id, q, cell) of the n_probe best cells: by squared L2, or by inner product for the other metrics."""
    q = queries.select("query_id", prepared(F.col("vector"), metric).alias("q"))
    scored = crossed(q, centroids.withColumnRenamed("cell", "id")).select("query_id", "id", "q", key(F.col("q"), F.col("c"), metric).alias("key"))
    return top_k(scored, max(1, n_probe)).select("query_id", "q", F.col("id").alias("cell"))


def ivf_search(queries: DataFrame, centroids: DataFrame, rows: DataFrame, k: int, metric: Metric, n_probe: int, where: Column | str | None = None) -> DataFrame:
    """Exact scores within the probed cells."""
    probes = probed(queries, centroids, metric, n_probe).groupBy("query_id").agg(F.first("q").alias("q"), F.collect_list("cell").alias("probes"))
    rows = (rows if where is None else rows.filter(where)).select("id", "v", "cell")
    return _hits(top_k(pairs.nearest(probes, rows, k, metric), k), metric)


def pq_trained(rows: DataFrame, m: int, ksub: int, rounds: int, dim: int) -> list[DataFrame]:
    """A codebook (cell, c) for each of m subspaces."""
    width = dim // m
    return [kmeans(rows.select("id", F.slice("v", j * width + 1, width).alias("v")), ksub, rounds, Metric.L2)[0] for j in range(m)]


def _books(books: list[DataFrame]) -> list[Column]:
    return [F.array(*[F.array(*[F.lit(float(x)) for x in r["c"]]) for r in sorted(b.collect(), key=lambda r: r["cell"])]) for b in books]


def pq_encoded(rows: DataFrame, books: list[DataFrame], dim: int) -> DataFrame:
    """rows with codes: the nearest code of each subspace, the first of equals."""
    width = dim // len(books)

    def code(j: int, book: Column) -> Column:
        part = F.slice("v", j * width + 1, width)
        return F.array_min(F.transform(book, lambda c, i: F.struct(squared_l2(part, c).alias("d"), i.alias("i"))))["i"]

    return rows.withColumn("codes", F.array(*[code(j, b) for j, b in enumerate(_books(books))]))


def adc_tables(queries: DataFrame, books: list[DataFrame], metric: Metric, dim: int) -> DataFrame:
    """queries with lut: for each subspace, the key part of each code."""
    width = dim // len(books)

    def part_keys(j: int, book: Column) -> Column:
        part = F.slice("q", j * width + 1, width)
        return F.transform(book, lambda c: key(part, c, metric))

    return queries.withColumn("lut", F.array(*[part_keys(j, b) for j, b in enumerate(_books(books))]))


def _adc(q: pairs.Arrays, x: pairs.Arrays, cell: int) -> np.ndarray:
    codes = x["codes"]
    lut = q["lut"].reshape(len(q["lut"]), codes.shape[1], -1)
    out = np.zeros((len(lut), len(codes)))
    for j in range(codes.shape[1]):
        out += np.take(lut[:, j], codes[:, j], axis=1)
    return out


def pq_search(queries: DataFrame, encoded: DataFrame, books: list[DataFrame], k: int, metric: Metric, dim: int, oversample: int = 1, where: Column | str | None = None) -> DataFrame:
    q = adc_tables(queries.select("query_id", prepared(F.col("vector"), metric).alias("q")), books, metric, dim)
    rows = encoded if where is None else encoded.filter(where)
    return scanned(q, rows.select("id", "v", "codes"), k, oversample, metric, _adc)


def medoid(collection: DataFrame) -> DataFrame:
    """(id): the row nearest to the mean, the lower id of equals."""
    rows = live(collection).select("id", F.col("vector").cast("array<double>").alias("v"))
    c = means(rows.withColumn("cell", F.lit(0)), False).select(F.col("c"))
    return rows.crossJoin(F.broadcast(c)).agg(F.min_by("id", F.struct(squared_l2(F.col("v"), F.col("c")), "id")).alias("id"))

