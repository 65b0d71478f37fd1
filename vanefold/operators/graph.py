"""Semantic graphs: weighted k-nearest-neighbour edges merged with explicit links, and what is asked of them.

edges: (src, dst, weight, kind), kind one of semantic, link, both; nodes: (id, title, tags). With squared L2 a weight is
a distance, yet edges still sort by weight descending, as the contract has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric, score
from vanefold.operators import pairs
from vanefold.operators.kernels import centroids, distances, exact_blocks, matrix, ready, sampled
from vanefold.operators.search import top_k
from vanefold.sources.shared import scratch, written


def knn_edges(collection: DataFrame, k: int, metric: Metric, min_weight: float | None = None) -> DataFrame:
    """(src, dst, weight) of each row's k nearest others."""
    queries = collection.select(F.col("id").alias("query_id"), "vector")
    hits = exact_blocks(queries, collection, k + 1, metric).filter("query_id != id")
    edges = hits.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"))
    return edges if min_weight is None else edges.filter(F.col("weight") >= min_weight)


def mutual(edges: DataFrame) -> DataFrame:
    """The edges whose reverse is there too; both meet in a group of their ends, so edges are made once."""
    ends = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    met = edges.groupBy(*ends).agg(F.collect_list(F.struct(*edges.columns)).alias("e"), F.count_distinct("src").alias("n"))
    return met.filter((F.col("n") == 2) | (F.col("a") == F.col("b"))).select(F.inline("e"))


def merged(edges: DataFrame, links: DataFrame, ids: DataFrame, link_weight: float = 1.0) -> DataFrame:
    """Semantic edges and valid links in one set; where both are, the larger weight and the kind both."""
    known = ids.select("id")
    valid = links.filter("src != dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct().withColumn("link", F.lit(float(link_weight)))
    both = edges.join(valid, ["src", "dst"], "full_outer")
    kind = F.when(F.col("link").isNull(), "semantic").when(F.col("weight").isNull(), "link").otherwise("both")
    return both.select("src", "dst", F.greatest(F.coalesce("weight", "link"), F.coalesce("link", "weight")).alias("weight"), kind.alias("kind"))


def related(edges: DataFrame, k: int, members: DataFrame | None = None) -> DataFrame:
    """(src, rank, dst, weight, kind): each node's k heaviest edges, to members only if they are given."""
    if members is not None:
        edges = edges.join(members.select(F.col("id").alias("dst")), "dst", "left_semi")
    order = Window.partitionBy("src").orderBy(F.desc("weight"), F.asc("dst"))
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", (F.col("rank") - 1).cast("long").alias("rank"), "dst", "weight", "kind")


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.filter(F.array_contains("tags", tag)).select("id", "title")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def suggested_tags(hits: DataFrame, nodes: DataFrame, min_score: float = 0.0, min_votes: int = 1, max_tags: int = 10) -> DataFrame:
    """(query_id, tag, score, votes): tags by the share of neighbours' weight that bears them; untagged ones count in the whole."""
    w = hits.select("query_id", "id", F.greatest(F.col("score"), F.lit(0.0)).alias("w"))
    total = w.groupBy("query_id").agg(F.sum("w").alias("total")).filter("total > 0")
    votes = w.join(nodes.select("id", F.explode(F.array_distinct("tags")).alias("tag")), "id").groupBy("query_id", "tag").agg(F.sum("w").alias("sum"), F.count("*").alias("votes"))
    scored = votes.join(total, "query_id").withColumn("score", F.round(F.col("sum") / F.col("total"), 6)).filter((F.col("score") >= min_score) & (F.col("votes") >= min_votes))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("tag"))
    return scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_tags).select("query_id", "tag", "score", "votes")


#: Rounds of an iteration that one plan holds; then its state is written to the shared folder.
CUT = 3


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank) after so many rounds; weights below 0 count as 0, and nodes without weight spread theirs evenly."""
    spark, n = nodes.sparkSession, nodes.count()
    with scratch(spark) as out:
        w = edges.select("src", "dst", F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
        share = written(w.join(w.groupBy("src").agg(F.sum("w").alias("t")).filter("t > 0"), "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), spark)
        heavy = share.select(F.col("src").alias("id")).distinct().withColumn("heavy", F.lit(True))
        r = written(nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("rank")).join(heavy, "id", "left"), spark)
        for i in range(rounds):
            lost = r.filter("heavy is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            got = share.join(r.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("g"))
            r = r.select("id", "heavy").join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), "heavy")
            r = written(r, spark) if i % CUT == CUT - 1 else r
        return out(r.select("id", "rank"))


def neighborhood(edges: DataFrame, start: DataFrame, depth: int, keep: Column | str | None = None) -> DataFrame:
    """(id, depth) of the nodes within `depth` hops of start (id), by way of nodes that `keep` (a condition on id) lets pass."""
    spark = edges.sparkSession
    passes = F.lit(True) if keep is None else F.expr(keep) if isinstance(keep, str) else keep
    with scratch(spark) as out:
        seen = written(start.select("id", F.lit(0).cast("long").alias("depth")).filter(passes), spark)
        front = seen
        for d in range(1, depth + 1):
            met = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().filter(passes)
            front = written(met.join(seen, "id", "left_anti").select("id", F.lit(d).cast("long").alias("depth")), spark)
            seen = seen.unionByName(front)
        return out(seen)


def neighborhood_edges(edges: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """The edges from nodes found within fewer than `depth` hops to any node found."""
    inner = found.filter(F.col("depth") < depth).select(F.col("id").alias("src"))
    return edges.join(inner, "src", "left_semi").join(found.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def communities(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(id, community) by synchronous label propagation: the label with most weight among neighbours, the least of equals."""
    spark = nodes.sparkSession
    with scratch(spark) as out:
        edges = written(edges.select("src", "dst", "weight"), spark)
        labels = nodes.select("id", F.col("id").alias("label"))
        for i in range(rounds):
            votes = edges.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
            best = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new"))
            labels = labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"))
            labels = written(labels, spark) if i % CUT == CUT - 1 else labels
        return out(labels.select("id", F.col("label").alias("community")))


def with_metadata(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """nodes (id, ...) with title and tags of meta (id, title, tags) in place of all they had; titles that are empty are null, tags sorted and distinct."""
    new = meta.select("id", F.when(F.trim("title") != "", F.col("title")).alias("title"), F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags"))
    return nodes.drop("title", "tags").join(new, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_names(nodes: DataFrame) -> DataFrame:
    """(place, tag): the distinct tags in order, numbered from 0; few beside the nodes, so they are ordered in one task."""
    names = nodes.select(F.explode("tags").alias("tag")).distinct()
    return names.select((F.row_number().over(Window.orderBy("tag")) - 1).cast("long").alias("place"), "tag")


def capped(edges: DataFrame, max_degree: int) -> DataFrame:
    """Each node's heaviest edges, at most max_degree."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), F.asc("dst"))
    return edges.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_degree).drop("_rank")


def described(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, edges, tags, avg_degree) in one row."""
    n = nodes.agg(F.count("*").alias("nodes"))
    tags = nodes.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags"))
    e = edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).crossJoin(tags).select("nodes", "edges", "tags", F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 1).alias("avg_degree"))


def built(collection: DataFrame, k: int = 10, metric: Metric = Metric.COSINE, min_weight: float | None = None, mutual_only: bool = False, links: DataFrame | None = None, link_weight: float = 1.0, max_degree: int | None = None) -> DataFrame:
    """edges of the whole graph: nearest neighbours, of which only mutual ones may stay, then links, then at most max_degree a node."""
    edges = knn_edges(collection, k, metric, min_weight)
    edges = mutual(edges) if mutual_only else edges
    edges = merged(edges, links, collection, link_weight) if links is not None else edges.withColumn("kind", F.lit("semantic"))
    return edges if max_degree is None else capped(edges, max_degree)


def knn_edges_in_cells(collection: DataFrame, k: int, metric: Metric, n_cells: int = 0, n_probe: int = 16, min_weight: float | None = None) -> DataFrame:
    """`knn_edges` through cells, for many rows: each row is compared with the rows of its n_probe best cells alone.

    Centroids are fitted from a bounded sample and broadcast, rows meet by blocks of a cell (`pairs`), and nothing else
    passes the driver. With n_probe of all cells the result is exact.
    """
    rows = ready(collection, metric)
    x = sampled(rows)
    if not len(x):
        return knn_edges(collection, k, metric, min_weight)
    centres = collection.sparkSession.sparkContext.broadcast(centroids(x, n_cells, 12, metric))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                own = distances(v, centres.value)
                near = own if metric is Metric.L2 else -v @ centres.value.T
                probes = np.argsort(near, axis=1, kind="stable")[:, :n_probe].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own.argmin(1), pa.int32()), pa.array(list(probes), pa.list_(pa.int32()))], names=["id", "v", "cell", "probes"])

    placed = rows.mapInArrow(run, "id long, v array<double>, cell int, probes array<int>")
    asks = placed.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "probes")
    hits = top_k(pairs.nearest(asks, placed.select("id", "v", "cell"), k + 1, metric).filter("query_id != id"), k)
    edges = hits.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), score(F.col("key"), metric).alias("weight"))
    return edges if min_weight is None else edges.filter(F.col("weight") >= min_weight)


def _quoted(c: Column) -> Column:
    """A JSON string: to_json escapes quotes, backslashes and control characters."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)


def exported_nodes(nodes: DataFrame, edges: DataFrame, community: DataFrame | None = None) -> DataFrame:
    """(id, json): one JSON object a node, with its degree and, where it has them, label, tags and community."""
    rows = nodes.select("id", "title", "tags").join(degrees(edges, nodes), "id")
    rows = rows.join(community, "id", "left") if community is not None else rows.withColumn("community", F.lit(None).cast("long"))
    label = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(',"label":'), _quoted(F.col("title"))))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(',"tags":'), F.to_json("tags")))
    group = F.when(F.col("community").isNotNull(), F.concat(F.lit(',"community":'), F.col("community").cast("string")))
    text = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"degree":'), F.col("degree").cast("string"), *[F.coalesce(x, F.lit("")) for x in (label, tags, group)], F.lit("}"))
    return rows.select("id", text.alias("json"))


def exported(nodes: DataFrame, edges: DataFrame, community: DataFrame | None = None) -> DataFrame:
    """(part, id, line): the lines of one JSON document in order, nodes by id and each node's edges by weight.

    The order is by range, so no task has all lines; their text one after another is the document.
    """
    n = exported_nodes(nodes, edges, community).select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("b"), "json")
    e = exported_edges(edges).join(edges.select("src", "dst", F.col("weight").cast("double").alias("w")), ["src", "dst"]).select(F.lit(3).alias("part"), F.col("src").alias("a"), -F.col("w"), F.col("dst").alias("b"), "json").toDF("part", "a", "w", "b", "json")
    last = n.groupBy().agg(F.max("a").alias("a")).crossJoin(F.broadcast(e.groupBy().agg(F.max(F.struct("a", "w", "b")).alias("e"))))
    rows = n.unionByName(e).crossJoin(F.broadcast(last.select(F.col("a").alias("n_last"), "e")))
    ends = ((F.col("part") == 1) & (F.col("a") == F.col("n_last"))) | ((F.col("part") == 3) & (F.struct("a", "w", "b") == F.col("e")))
    rows = rows.select("part", "a", "w", "b", F.when(ends, F.col("json")).otherwise(F.concat("json", F.lit(","))).alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, 0, 0.0, 0, '{"nodes":['), (2, 0, 0.0, 0, '],"edges":['), (4, 0, 0.0, 0, "]}")], "part int, a long, w double, b long, line string")
    return rows.unionByName(frame).orderBy("part", "a", "w", "b").select("part", F.col("a").alias("id"), "line")


def exported_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, json): one JSON object an edge."""
    text = F.format_string('{"source":%d,"target":%d,"weight":%.4f,"kind":"%s"}', "src", "dst", F.round(F.col("weight").cast("double"), 4), "kind")
    return edges.select("src", "dst", text.alias("json"))
