"""Connected components of links between ids, by alternating large and small stars; no node's links meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.llm.common import scratch, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least id that each linked id reaches; roots themselves are left out.

    Each round is written to the shared folder, so plans stay short and lost executors cost at most a round.
    """
    spark = links.sparkSession
    with scratch(spark) as out:
        edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
        edges = written(edges, spark)
        state = _state(edges)
        while state[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            root = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            edges = written(small.filter("u != v").distinct(), spark)
            now = _state(edges)
            if now == state:
                break
            state = now
        return out(edges.select(F.col("u").alias("node"), F.col("v").alias("root")))
