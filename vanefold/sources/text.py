"""Text and binary sources and the sink of hits.

Vector rows are `id,v0,v1,...`; blank lines and lines that begin with # are skipped. A bad line raises an error that
shows it, or, with strict=False, is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_vectors(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(id, vector)."""
    part = F.split("line", ",")
    rows = _lines(spark, path).select("line", F.trim(part[0]).try_cast("long").alias("id"), F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda x: F.trim(x).try_cast("float")).alias("vector"))
    good = F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
    if not strict:
        return rows.filter(good).select("id", "vector")
    wrong = F.raise_error(F.concat(F.lit("not a vector row: "), "line"))
    return rows.select(F.when(good, F.col("id")).otherwise(wrong.cast("long")).alias("id"), "vector")


def uniform_dimension(vectors: DataFrame) -> int:
    """The dimension; an error where there are no rows or several dimensions."""
    low, high = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low is None or low != high:
        raise ValueError("no rows" if low is None else f"dimensions from {low} to {high}")
    return low


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines `src,dst`."""
    part = F.split("line", ",")
    return _lines(spark, path).select(F.trim(part[0]).cast("long").alias("src"), F.trim(F.get(part, F.lit(1))).cast("long").alias("dst"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, tags) of lines with an id and, after tabs, a title and tags parted by commas; both can be left out."""
    part = F.split("line", "\t")
    tags = F.filter(F.transform(F.split(F.coalesce(F.get(part, F.lit(2)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    title = F.coalesce(F.get(part, F.lit(1)), F.lit(""))
    return _lines(spark, path).select(F.trim(part[0]).cast("long").alias("id"), F.when(title != "", title).alias("title"), tags.alias("tags"))


def read_vecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """(id, vector) of an fvecs (kind f) or ivecs (kind i) file: a 32-bit dimension before each row; ids count from 0.

    One task reads a file, so large data come as many files; ids are then counted within each file.
    """
    as_type = {"f": ("<f4", "float"), "i": ("<i4", "int")}[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                if not content:
                    continue
                dim = int(np.frombuffer(content, "<i4", 1)[0])
                if dim <= 0 or len(content) % (4 * (dim + 1)):
                    raise ValueError("not a file of rows of one dimension")
                rows = np.frombuffer(content, as_type[0]).reshape(-1, dim + 1)[:, 1:]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"id long, vector array<{as_type[1]}>")


def hit_lines(hits: DataFrame) -> DataFrame:
    """(value): query, rank, id and score with six decimals, parted by tabs, in order; ready for write.text."""
    return hits.orderBy("query_id", "rank").select(F.format_string("%d\t%d\t%d\t%.6f", "query_id", "rank", "id", F.col("score").cast("double")).alias("value"))
