"""Vector functions for SQL: temporary functions that Catalyst inlines, so they run in the JVM and nowhere else."""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "vector_dot": (f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_l2sq": (f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vector_norm": (f"a {_V}", "DOUBLE", "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))"),
    "vector_cosine": (
        f"a {_V}, b {_V}",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x)), 0D)",
    ),
    "int8_quantize": (f"a {_V}", "ARRAY<INT>", "transform(a, x -> CAST(greatest(-127D, least(127D, round(x / if(array_max(transform(a, y -> abs(y))) > 0, array_max(transform(a, y -> abs(y))) / 127, 1D)))) AS INT))"),
}


def register(spark: SparkSession, collection: str | None = None) -> None:
    """The functions above; with the name of a table (id, vector), also knn_search(q, k), a table function over it."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    if collection is not None:
        key = "aggregate(zip_with(q, CAST(vector AS ARRAY<DOUBLE>), (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION knn_search(q {_V}, k INT) RETURNS TABLE (place INT, id BIGINT, distance DOUBLE) "
            f"RETURN SELECT place, id, distance FROM (SELECT row_number() OVER (ORDER BY distance, id) AS place, id, distance FROM (SELECT id, {key} AS distance FROM {collection})) WHERE place <= k"
        )
