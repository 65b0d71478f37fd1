"""Registered queries over the table of embeddings, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanefold import cli
from vanefold.functions import register
from vanefold.functions.vectors import Metric, doubles, int8_values, normalized, sign_words, squared_l2
from vanefold.operators import cells, graph, guided, kernels, layered, proximity, search, sequential
from vanefold.operators.classify import TagClassifier
from vanefold.sources import store
from vanefold.sources.shared import scratch, shared_folder, written

DIM, K = 64, 10
#: What the plain approximate searches probe (of 8 cells) and rerank (times K), so that recall stays above 0.9 on 2,000 rows.
PROBES, HAMMING_OVER, PQ_OVER = 7, 48, 128
COS, DOT, L2 = Metric.COSINE, Metric.DOT, Metric.L2


def vectors(spark: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.withColumn("vector", F.transform(doubles(F.col("vector")), lambda x: x * (1 + F.col("id") % 5))) if scaled else rows


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def meta(rows: DataFrame) -> DataFrame:
    tags = F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("L"), "label"), F.lit("shared"))).otherwise(F.array(F.concat(F.lit("L"), "label")))
    return rows.select("id", F.concat(F.lit("note "), "id").alias("title"), tags.alias("tags"))


def links(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("src"), (F.col("id") * 7 % 500).alias("dst")).unionByName(rows.filter("id = 0").select(F.col("id").alias("src"), F.lit(999_999_999).cast("long").alias("dst")))


def _searcher(f: Callable, scaled: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d, scaled)
        return f(queries_of(v), v)

    return run


def _graph(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """f(edges, vectors): with the kNN graph (k = 5) merged with the links, built once however often f reads it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        with scratch(spark) as out:
            return out(f(written(graph.merged(graph.knn_edges(v, 5, COS), links(v), v), spark), v))

    return run


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    e = search.int8_encoded(vectors(spark, d, True), L2)
    return e.select("id", F.round("scale", 9).alias("scale"), F.round("sqnorm", 6).alias("sqnorm"), F.array_join("codes", ",").alias("codes"))


def _decode_error(spark: SparkSession, d: str) -> DataFrame:
    e = search.int8_encoded(vectors(spark, d, True), L2)
    return e.select("id", F.round(squared_l2(F.col("v"), int8_values(F.col("codes"), F.col("scale"))), 6).alias("error"))


def _ivf(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        return f(*cells.ivf_built(v, COS, 8, 3), queries_of(v))

    return run


def _pq(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        rows = v.select("id", doubles(F.col("vector")).alias("v"))
        books = cells.pq_trained(rows, 4, 8, 2, DIM)
        return f(cells.pq_encoded(rows, books, DIM), books, queries_of(v))

    return run


def _cells(build: Callable, n_probe: int = 1, over: int = 16) -> Callable[[SparkSession, str], DataFrame]:
    """n_probe and over are where widening starts."""

    def search_of(q: DataFrame, v: DataFrame) -> DataFrame:
        rows, held = build(v)
        return kernels.cell_search(q, rows, held, K, *kernels.widened(rows, held, K, n_probe, over))

    return _searcher(search_of)


def _guided(q: DataFrame, v: DataFrame, ef: int) -> DataFrame:
    g, books, _ = guided.built(v, COS, ksub=64)
    return guided.search(q, g, books, K, COS, ef)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """An index that is written, read back and searched."""
    v, at = vectors(spark, d), shared_folder(spark)
    store.save(cli.build("build", v, COS), at)
    return cli.searched(store.load(spark, at), queries_of(v), K, 10_000)


def _recalls(q: DataFrame, v: DataFrame) -> DataFrame:
    """(index, reached): whether recall at 10, by default settings, is 0.9 or more."""
    want = search.exact(q, v, K, COS)
    asked = {
        "diskann": lambda: _guided(q, v, 128),
        "hnsw": lambda: layered.hnsw_search(q, layered.hnsw(v, COS), K, COS),
        "hnsw-q": lambda: layered.hnsw_search(q, layered.hnsw(v, COS, int8=True), K, COS, int8=True),
        "ivf": lambda: kernels.cell_search(q, *kernels.ivf(v, COS), K, 30, 4),
    }
    each = [search.recall(f(), want).select(F.lit(name).alias("index"), (F.col("recall") >= 0.9).alias("reached")) for name, f in asked.items()]
    return reduce(DataFrame.unionByName, each)


def _sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register.register(spark)
    v = vectors(spark, d).select("id", doubles(F.col("vector")).alias("v"))
    first = v.filter("id = 0").select(F.col("v").alias("w"))
    return v.crossJoin(F.broadcast(first)).selectExpr("id", "round(vector_dot(v, w), 6) AS d", "round(vector_l2sq(v, w), 6) AS l", "round(vector_cosine(v, w), 6) AS c")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "exact_cosine": _searcher(lambda q, v: search.exact(q, v, K, COS)),
    "exact_dot": _searcher(lambda q, v: search.exact(q, v, K, DOT), True),
    "exact_l2": _searcher(lambda q, v: search.exact(q, v, K, L2), True),
    "exact_filtered": _searcher(lambda q, v: search.exact(q, v, K, COS, "id % 3 = 0")),
    "exact_live_only": _searcher(lambda q, v: search.exact(q, search.removed(v, v.filter("id % 5 = 0")), K, COS)),
    "exact_k_gt_n": _searcher(lambda q, v: search.exact(q, v, K, COS, "id < 5")),
    "exact_payload": _searcher(lambda q, v: search.with_payload(search.exact(q, v, K, COS), v.withColumn("payload", F.when(F.col("id") % 2 == 0, F.concat(F.lit("doc-"), "id"))))),
    "normalize": lambda s, d: vectors(s, d, True).select("id", F.array_join(F.transform(normalized(F.col("vector")), lambda x: F.format_string("%.5f", F.round(x, 5) + F.lit(0.0))), ",").alias("v")),
    "int8_encode": _encoded,
    "int8_decode_error": _decode_error,
    "int8_scan": _searcher(lambda q, v: search.int8_scan(q, v, K, L2), True),
    "int8_rerank": _searcher(lambda q, v: search.int8_scan(q, v, K, L2, 8), True),
    "sign_bits": lambda s, d: vectors(s, d).select("id", sign_words(doubles(F.col("vector")), DIM)[0].alias("word")),
    "hamming_scan": _searcher(lambda q, v: search.binary_scan(q, v, K, COS, DIM)),
    "hamming_rerank": _searcher(lambda q, v: search.binary_scan(q, v, K, COS, DIM, HAMMING_OVER)),
    "upsert": lambda s, d: search.upserted(vectors(s, d), vectors(s, d).filter("id % 10 = 0").withColumn("label", F.lit(-1))).select("id", F.col("label").cast("long").alias("label")),
    "compact": lambda s, d: search.compacted(search.removed(vectors(s, d), vectors(s, d).filter("id % 5 = 0"))).select("id", F.col("label").cast("long").alias("label")),
    "medoid": lambda s, d: cells.medoid(vectors(s, d)),
    "recall_at_k": _searcher(lambda q, v: search.recall(search.binary_scan(q, v, K, COS, DIM, 4), search.exact(q, v, K, COS))),
    "kmeans_centroids": _ivf(lambda c, r, q: c.select(F.col("cell").cast("long").alias("cell"), F.posexplode("c").alias("i", "x")).select("cell", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))),
    "ivf_assign": _ivf(lambda c, r, q: r.select("id", F.col("cell").cast("long").alias("cell"))),
    "ivf_cell_sizes": _ivf(lambda c, r, q: r.groupBy(F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"))),
    "ivf_probe": _ivf(lambda c, r, q: cells.probed(q, c, COS, PROBES).select("query_id", F.col("cell").cast("long").alias("cell"))),
    "ivf_search": _ivf(lambda c, r, q: cells.ivf_search(q, c, r, K, COS, PROBES)),
    "ivf_filtered": _ivf(lambda c, r, q: cells.ivf_search(q, c, r, K, COS, PROBES, "id % 3 = 0")),
    "pq_codes": _pq(lambda e, b, q: e.select("id", F.array_join("codes", ",").alias("codes"))),
    "pq_adc": _pq(lambda e, b, q: cells.pq_search(q, e, b, K, L2, DIM)),
    "pq_rerank": _pq(lambda e, b, q: cells.pq_search(q, e, b, K, L2, DIM, PQ_OVER)),
    "knn_graph": lambda s, d: graph.knn_edges(vectors(s, d), 5, COS),
    "mutual_knn": lambda s, d: graph.mutual(graph.knn_edges(vectors(s, d), 5, COS)),
    "graph_merge_links": _graph(lambda e, v: e),
    "related": _graph(lambda e, v: graph.related(e, 3)),
    "related_tag": _graph(lambda e, v: graph.related(e, 3, graph.by_tag(meta(v), "shared"))),
    "tag_counts": lambda s, d: graph.tag_counts(meta(vectors(s, d))),
    "by_tag": lambda s, d: graph.by_tag(meta(vectors(s, d)), "shared"),
    "degrees": _graph(lambda e, v: graph.degrees(e, v)),
    "suggest_tags": _searcher(lambda q, v: graph.suggested_tags(search.exact(q, v, K, COS), meta(v), 0.1)),
    "pagerank": _graph(lambda e, v: graph.pagerank(e, v, 3).select("id", F.round("rank", 9).alias("rank"))),
    "neighborhood_bfs": _graph(lambda e, v: graph.neighborhood(e, v.filter("id = 0"), 2)),
    "communities_sync": _graph(lambda e, v: graph.communities(e, v, 3)),
    "graph_export": _graph(lambda e, v: graph.exported_edges(e)),
    "rabitq_search": _cells(lambda v: kernels.rabitq(v, COS)),
    "ivf_rabitq_search": _cells(lambda v: kernels.rabitq(v, COS, 16), 8),
    "ivfpq_search": _cells(lambda v: kernels.ivf_pq(v, COS, 16, 16, 64, 8), 8),
    "opq_search": _cells(lambda v: kernels.opq(v, COS, 16, 64, 8, 3)),
    "graph_ann_search": _searcher(lambda q, v: proximity.graph_search(q, proximity.graph_built(v, COS), K, COS)),
    "graph_ann_exhaustive": _searcher(lambda q, v: proximity.graph_search(q, proximity.graph_built(v, COS), K, COS, proximity.SHARD * 2)),
    "communities_seq": _graph(lambda e, v: sequential.communities_in_order(e, v, 20)),
    "neighborhood_lifo": _graph(lambda e, v: sequential.neighborhood_in_order(e, v, 0, 2, 50)),
    "hnsw_search": _searcher(lambda q, v: layered.hnsw_search(q, layered.hnsw(v, COS), K, COS)),
    "hnsw_exhaustive": _searcher(lambda q, v: layered.hnsw_search(q, layered.hnsw(v, COS), K, COS, layered.SHARD * 2)),
    "hnsw_filtered": _searcher(lambda q, v: layered.hnsw_search(q, layered.hnsw(v, COS), K, COS, layered.SHARD * 2, "id % 3 = 0")),
    "hnsw_int8_search": _searcher(lambda q, v: layered.hnsw_search(q, layered.hnsw(v, COS, int8=True), K, COS, int8=True)),
    "hnsw_int8_exhaustive": _searcher(lambda q, v: layered.hnsw_search(q, layered.hnsw(v, COS, int8=True), K, COS, layered.SHARD * 2, int8=True)),
    "diskann_search": _searcher(lambda q, v: _guided(q, v, 128)),
    "diskann_exhaustive": _searcher(lambda q, v: _guided(q, v, layered.SHARD * 2)),
    "ivf_int8_search": _searcher(lambda q, v: kernels.cell_search(q, *kernels.ivf(v, COS), K, 30, 4)),
    "ivf_int8_exhaustive": _searcher(lambda q, v: kernels.cell_search(q, *kernels.ivf(v, COS), K, 10_000, 10_000)),
    "stored_flat": _stored,
    "ann_recall": _searcher(_recalls),
    "knn_graph_cells": lambda s, d: graph.knn_edges_in_cells(vectors(s, d), 5, COS, 8, 8),
    "graph_capped": _graph(lambda e, v: graph.capped(e, 3)),
    "graph_described": _graph(lambda e, v: graph.described(e, meta(v))),
    "graph_nodes_export": _graph(lambda e, v: graph.exported_nodes(meta(v), e)),
    "neighborhood_keep": _graph(lambda e, v: graph.neighborhood(e, v.filter("id = 0"), 2, "id % 3 <> 1")),
    "neighborhood_edges": _graph(lambda e, v: graph.neighborhood_edges(e, graph.neighborhood(e, v.filter("id = 0"), 1), 1)),
    "tag_names": lambda s, d: graph.tag_names(meta(vectors(s, d))),
    "set_metadata": lambda s, d: graph.with_metadata(vectors(s, d).select("id"), meta(vectors(s, d)).filter("id % 2 = 0")).select("id", "title", F.array_join("tags", ",").alias("tags")),
    "classifier_suggest": _searcher(lambda q, v: TagClassifier(meta(v).join(v, "id").select("id", "vector", "tags")).suggest(q, K, 0.1, max_tags=10)),
    "sql_functions": _sql_functions,
}

# DuckDB: the same queries over the view `embeddings`.
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_S = "v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) AS v, label FROM embeddings)"
_COS = "list_inner_product(q.v, v.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(v.v, v.v))"
_DOTX = "list_inner_product(q.v, v.v)"
_L2X = "list_sum(list_transform(list_zip(q.v, v.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _scan(expr: str, sign: int, base: str = _V, where: str = "true", k: int = K, extra: str = "") -> str:
    """Top k by sign * expr ascending."""
    return f"""WITH {base}, s AS (SELECT q.id AS query_id, v.id AS id, {expr} AS x FROM v q, v WHERE q.id % 100 = 0 AND {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {sign} * x, id) - 1 AS rank FROM s){extra}
SELECT query_id, rank, id, round(x, 6) AS score FROM t WHERE rank < {k}"""


_INT8 = """e AS (SELECT id, v, CASE WHEN m > 0 THEN m / 127 ELSE 1.0::DOUBLE END AS scale, list_inner_product(v, v) AS sqnorm FROM (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM v)),
c AS (SELECT id, v, scale, sqnorm, list_transform(v, lambda x: greatest(-127, least(127, round(x / scale)::INT))) AS codes FROM e)"""
_INT8_KEY = "v.sqnorm + q.sqnorm - 2 * (list_inner_product(q.codes::DOUBLE[], v.codes::DOUBLE[]) * q.scale * v.scale)"
_HAM = "list_sum(list_transform(list_zip(q.v, v.v), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END))::DOUBLE"


def _coarse(approx: str, base: str, src: str, exact: str, sign: int, over: int) -> str:
    return f"""WITH {base}, s AS (SELECT q.id AS query_id, v.id AS id, {approx} AS a, {exact} AS x FROM {src} q, {src} v WHERE q.id % 100 = 0),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, id) AS ra FROM s) WHERE ra <= {K * over}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {sign} * x, id) - 1 AS rank FROM u)
SELECT query_id, rank, id, round(x, 6) AS score FROM t WHERE rank < {K}"""


def _lloyd(src: str, n: int, rounds: int, renorm: bool, tag: str = "") -> str:
    """CTEs c{tag}0.. and a{tag}1.. of Lloyd's rounds over `src` (id, v)."""
    d = "list_sum(list_transform(list_zip(r.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [f"c{tag}0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cell, v AS c FROM (SELECT id, v FROM {src} ORDER BY id LIMIT {n}))"]
    for i in range(1, rounds + 1):
        out.append(f"a{tag}{i} AS (SELECT id, v, cell FROM (SELECT r.id, r.v, c.cell, row_number() OVER (PARTITION BY r.id ORDER BY {d}, c.cell) AS k FROM {src} r, c{tag}{i - 1} c) WHERE k = 1)")
        out.append(f"x{tag}{i} AS (SELECT cell, i, avg(x) AS x FROM (SELECT cell, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{tag}{i}) GROUP BY cell, i)")
        m = f"(SELECT cell, list(x ORDER BY i) AS c FROM x{tag}{i} GROUP BY cell)"
        if renorm:
            m = f"(SELECT cell, list_transform(c, lambda y: y / sqrt(list_inner_product(c, c))) AS c FROM {m})"
        out.append(f"c{tag}{i} AS (SELECT o.cell, coalesce(m.c, o.c) AS c FROM c{tag}{i - 1} o LEFT JOIN {m} m USING (cell))")
    return ",\n".join(out)


_N = "n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM v)"
_IVF = f"WITH {_V}, {_N}, {_lloyd('n', 8, 3, True)}"
_PROBE = f"p AS (SELECT query_id, cell, q FROM (SELECT q.id AS query_id, q.v AS q, c.cell, row_number() OVER (PARTITION BY q.id ORDER BY -list_inner_product(q.v, c.c), c.cell) AS k FROM n q, c3 c WHERE q.id % 100 = 0) WHERE k <= {PROBES})"


def _ivf_sql(where: str) -> str:
    return f"""{_IVF}, {_PROBE}, s AS (SELECT p.query_id, a.id, list_inner_product(p.q, a.v) AS x FROM p JOIN a3 a USING (cell) WHERE {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -x, id) - 1 AS rank FROM s)
SELECT query_id, rank, id, round(x, 6) AS score FROM t WHERE rank < {K}"""


_SUBS = ", ".join(f"s{j} AS (SELECT id, list_slice(v, {16 * j + 1}, {16 * j + 16}) AS v FROM v), {_lloyd(f's{j}', 8, 2, False, f'_{j}_')}" for j in range(4))
_NEAR = "list_sum(list_transform(list_zip(r.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_CODE = ", ".join(f"k{j} AS (SELECT id, cell, c FROM (SELECT r.id, c.cell, c.c, row_number() OVER (PARTITION BY r.id ORDER BY {_NEAR}, c.cell) AS k FROM s{j} r, c_{j}_2 c) WHERE k = 1)" for j in range(4))
_PQ = f"WITH {_V}, {_SUBS}, {_CODE}, codes AS (SELECT v.id, v.v, {', '.join(f'k{j}.cell AS e{j}, k{j}.c AS b{j}' for j in range(4))} FROM v {' '.join(f'JOIN k{j} ON k{j}.id = v.id' for j in range(4))})"
_ADC = " + ".join(f"list_sum(list_transform(list_zip(list_slice(q.v, {16 * j + 1}, {16 * j + 16}), v.b{j}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" for j in range(4))


def _pq_sql(over: int) -> str:
    pick = f"u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, id) AS ra FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {'x' if over > 1 else 'a'}, id) - 1 AS rank FROM u WHERE ra <= {K * over})"
    return f"""{_PQ}, s AS (SELECT q.id AS query_id, v.id AS id, {_ADC} AS a, {_L2X} AS x FROM codes q, codes v WHERE q.id % 100 = 0), {pick}
SELECT query_id, rank, id, round({'x' if over > 1 else 'a'}, 6) AS score FROM t WHERE rank < {K}"""


_EDGES = f"""g AS (SELECT src, dst, weight FROM (SELECT q.id AS src, v.id AS dst, round({_COS}, 6) AS weight, row_number() OVER (PARTITION BY q.id ORDER BY -({_COS}), v.id) AS r FROM v q, v) WHERE r <= 6 AND src <> dst)"""
_LINKS = "l AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, id * 7 % 500 AS dst FROM v) WHERE src <> dst AND dst IN (SELECT id FROM v))"
_MERGED = f"WITH {_V}, {_EDGES}, {_LINKS}, e AS (SELECT coalesce(g.src, l.src) AS src, coalesce(g.dst, l.dst) AS dst, CASE WHEN l.src IS NULL THEN g.weight WHEN g.src IS NULL THEN 1.0::DOUBLE ELSE greatest(g.weight, 1.0::DOUBLE) END AS weight, CASE WHEN l.src IS NULL THEN 'semantic' WHEN g.src IS NULL THEN 'link' ELSE 'both' END AS kind FROM g FULL JOIN l ON g.src = l.src AND g.dst = l.dst)"


def _related_sql(where: str) -> str:
    return f"{_MERGED} SELECT src, r - 1 AS rank, dst, weight, kind FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e WHERE {where}) WHERE r <= 3"


def _pagerank_sql(rounds: int) -> str:
    out = "w AS (SELECT src, dst, greatest(weight, 0) AS w FROM e), t AS (SELECT src, sum(w) AS t FROM w GROUP BY src HAVING sum(w) > 0), p AS (SELECT src, dst, w / t AS p FROM w JOIN t USING (src)), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v)"
    for i in range(1, rounds + 1):
        out += f", r{i} AS (SELECT v.id, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM v) + 0.85::DOUBLE * (coalesce(g.g, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM t)) / (SELECT count(*) FROM v)) AS r FROM v LEFT JOIN (SELECT dst, sum(p * r) AS g FROM p JOIN r{i - 1} x ON x.id = p.src GROUP BY dst) g ON g.dst = v.id)"
    return f"{_MERGED}, {out} SELECT id, round(r, 9) AS rank FROM r{rounds}"


def _communities_sql(rounds: int) -> str:
    out = "l0 AS (SELECT id, id AS label FROM v)"
    for i in range(1, rounds + 1):
        out += f", l{i} AS (SELECT o.id, coalesce(b.label, o.label) AS label FROM l{i - 1} o LEFT JOIN (SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY w DESC, label) AS k FROM (SELECT e.src, x.label, round(sum(e.weight), 6) AS w FROM e JOIN l{i - 1} x ON x.id = e.dst GROUP BY e.src, x.label)) WHERE k = 1) b ON b.src = o.id)"
    return f"{_MERGED}, {out} SELECT id, label AS community FROM l{rounds}"


_META = "m AS (SELECT id, concat('note ', id) AS title, CASE WHEN id % 4 = 0 THEN ['L' || label, 'shared'] ELSE ['L' || label] END AS tags FROM v)"

ORACLE: dict[str, str] = {
    "exact_cosine": _scan(_COS, -1),
    "graph_ann_exhaustive": _scan(_COS, -1),
    "exact_dot": _scan(_DOTX, -1, _S),
    "exact_l2": _scan(_L2X, 1, _S),
    "exact_filtered": _scan(_COS, -1, where="v.id % 3 = 0"),
    "exact_live_only": _scan(_COS, -1, where="v.id % 5 <> 0"),
    "exact_k_gt_n": _scan(_COS, -1, where="v.id < 5"),
    "exact_payload": _scan(_COS, -1).replace("SELECT query_id, rank, id, round(x, 6) AS score", "SELECT query_id, rank, id, round(x, 6) AS score, CASE WHEN id % 2 = 0 THEN 'doc-' || id END AS payload"),
    "normalize": f"WITH {_S} SELECT id, array_to_string(list_transform(v, lambda x: printf('%.5f', round(x / sqrt(list_inner_product(v, v)), 5) + 0.0)), ',') AS v FROM v",
    "int8_encode": f"WITH {_S}, {_INT8} SELECT id, round(scale, 9) AS scale, round(sqnorm, 6) AS sqnorm, array_to_string(codes, ',') AS codes FROM c",
    "int8_decode_error": f"WITH {_S}, {_INT8} SELECT id, round(list_sum(list_transform(list_zip(v, codes), lambda z: (z[1] - z[2] * scale) * (z[1] - z[2] * scale))), 6) AS error FROM c",
    "int8_scan": f"WITH {_S}, {_INT8}, s AS (SELECT q.id AS query_id, v.id AS id, {_INT8_KEY} AS x FROM c q, c v WHERE q.id % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, id) - 1 AS rank FROM s) SELECT query_id, rank, id, round(x, 6) AS score FROM t WHERE rank < {K}",
    "int8_rerank": _coarse(_INT8_KEY, f"{_S}, {_INT8}", "c", _L2X, 1, 8),
    "sign_bits": f"WITH {_V} SELECT id, (sum(CASE WHEN x >= 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END) ELSE 0::HUGEINT END))::BIGINT AS word FROM (SELECT id, unnest(v) AS x, unnest(range(0, 64))::INT AS i FROM v) GROUP BY id",
    "hamming_scan": _scan(_HAM, 1),
    "hamming_rerank": _coarse(_HAM, _V, "v", _COS, -1, HAMMING_OVER),
    "upsert": "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END::BIGINT AS label FROM embeddings",
    "compact": "SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE vec_id % 5 <> 0",
    "medoid": f"WITH {_V}, m AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM v) GROUP BY i)) SELECT id FROM v, m ORDER BY list_sum(list_transform(list_zip(v.v, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), id LIMIT 1",
    "recall_at_k": f"WITH got AS ({_coarse(_HAM, _V, 'v', _COS, -1, 4)}), want AS ({_scan(_COS, -1)}) SELECT round(count(g.id) / count(*)::DOUBLE, 6) AS recall FROM want w LEFT JOIN got g ON g.query_id = w.query_id AND g.id = w.id",
    "kmeans_centroids": f"{_IVF} SELECT cell, i - 1 AS i, round(x, 6) AS x FROM (SELECT cell, unnest(c) AS x, unnest(range(1, 65)) AS i FROM c3)",
    "ivf_assign": f"{_IVF} SELECT id, cell FROM a3",
    "ivf_cell_sizes": f"{_IVF} SELECT cell, count(*) AS n FROM a3 GROUP BY cell",
    "ivf_probe": f"{_IVF}, {_PROBE} SELECT query_id, cell FROM p",
    "ivf_search": _ivf_sql("true"),
    "ivf_filtered": _ivf_sql("a.id % 3 = 0"),
    "pq_codes": f"{_PQ} SELECT id, concat_ws(',', e0, e1, e2, e3) AS codes FROM codes",
    "pq_adc": _pq_sql(1),
    "pq_rerank": _pq_sql(PQ_OVER),
    "knn_graph": f"WITH {_V}, {_EDGES} SELECT src, dst, weight FROM g",
    "mutual_knn": f"WITH {_V}, {_EDGES.replace('g AS (', 'g AS MATERIALIZED (', 1)} SELECT a.src, a.dst, a.weight FROM g a SEMI JOIN g b ON a.src = b.dst AND a.dst = b.src",
    "graph_merge_links": f"{_MERGED} SELECT src, dst, weight, kind FROM e",
    "related": _related_sql("true"),
    "related_tag": _related_sql("dst % 4 = 0"),
    "tag_counts": f"WITH {_V}, {_META} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM m) GROUP BY tag",
    "by_tag": f"WITH {_V}, {_META} SELECT id, title FROM m WHERE list_contains(tags, 'shared')",
    "degrees": f"{_MERGED} SELECT id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY id",
    "suggest_tags": f"WITH h AS ({_scan(_COS, -1)}), {_V}, {_META}, w AS (SELECT query_id, id, greatest(score, 0) AS w FROM h), x AS (SELECT query_id, tag, sum(w) AS s, count(*) AS votes FROM w JOIN (SELECT id, unnest(tags) AS tag FROM m) USING (id) GROUP BY query_id, tag) SELECT query_id, tag, round(s / t, 6) AS score, votes FROM x JOIN (SELECT query_id, sum(w) AS t FROM w GROUP BY query_id HAVING sum(w) > 0) USING (query_id) WHERE round(s / t, 6) >= 0.1",
    "pagerank": _pagerank_sql(3),
    "neighborhood_bfs": f"{_MERGED}, b1 AS (SELECT DISTINCT dst AS id FROM e WHERE src = 0 AND dst <> 0), b2 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM b1) AND dst <> 0 AND dst NOT IN (SELECT id FROM b1)) SELECT 0::BIGINT AS id, 0::BIGINT AS depth UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM b2",
    "communities_sync": _communities_sql(3),
    "graph_export": f"{_MERGED} SELECT src, dst, printf('{{\"source\":%d,\"target\":%d,\"weight\":%.4f,\"kind\":\"%s\"}}', src, dst, round(weight, 4), kind) AS json FROM e",
    "hnsw_exhaustive": _scan(_COS, -1),
    "hnsw_filtered": _scan(_COS, -1, where="v.id % 3 = 0"),
    "hnsw_int8_exhaustive": _scan(_COS, -1),
    "diskann_exhaustive": _scan(_COS, -1),
    "ivf_int8_exhaustive": _scan(_COS, -1),
    "stored_flat": _scan(_COS, -1),
    "ann_recall": "SELECT * FROM (VALUES ('diskann', true), ('hnsw', true), ('hnsw-q', true), ('ivf', true)) AS t(index, reached)",
    "knn_graph_cells": f"WITH {_V}, {_EDGES} SELECT src, dst, weight FROM g",
    "graph_capped": f"{_MERGED} SELECT src, dst, weight, kind FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) WHERE r <= 3",
    "graph_described": f"{_MERGED}, {_META} SELECT (SELECT count(*) FROM m) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM m)) AS tags, round((SELECT count(*) FROM e)::DOUBLE / (SELECT count(*) FROM m), 1) AS avg_degree",
    "graph_nodes_export": f"{_MERGED}, {_META} SELECT m.id, concat('{{\"id\":', m.id, ',\"degree\":', (SELECT count(*) FROM e WHERE e.src = m.id), ',\"label\":\"', title, '\",\"tags\":[\"', array_to_string(tags, '\",\"'), '\"]}}') AS json FROM m",
    "neighborhood_keep": f"{_MERGED}, b1 AS (SELECT DISTINCT dst AS id FROM e WHERE src = 0 AND dst <> 0 AND dst % 3 <> 1), b2 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM b1) AND dst <> 0 AND dst % 3 <> 1 AND dst NOT IN (SELECT id FROM b1)) SELECT 0::BIGINT AS id, 0::BIGINT AS depth UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM b2",
    "neighborhood_edges": f"{_MERGED} SELECT src, dst, weight, kind FROM e WHERE src = 0",
    "tag_names": f"WITH {_V}, {_META} SELECT row_number() OVER (ORDER BY tag) - 1 AS place, tag FROM (SELECT DISTINCT unnest(tags) AS tag FROM m)",
    "set_metadata": f"WITH {_V}, {_META} SELECT id, CASE WHEN id % 2 = 0 THEN title END AS title, CASE WHEN id % 2 = 0 THEN array_to_string(list_sort(tags), ',') ELSE '' END AS tags FROM m",
    "sql_functions": f"WITH {_V} SELECT v.id, round({_DOTX}, 6) AS d, round({_L2X}, 6) AS l, round({_COS}, 6) AS c FROM v, v q WHERE q.id = 0",
}
ORACLE["classifier_suggest"] = ORACLE["suggest_tags"]
