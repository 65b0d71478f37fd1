"""Indexes on any file system that Spark writes: Parquet tables beside a manifest of one line of JSON.

An index is its kind, metric and parameters, its tables (rows, links, centroids) and its models (arrays such as
codebooks and rotations, kept as rows of doubles). A table that is written is read lazily and pruned by the scan, so
opening an index reads the manifest alone. A save goes to a new version folder first; the manifest, written last, names
the version, so readers never see half an index.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric
from vanefold.operators.kernels import BitCells, Cells, Codebooks, Int8Cells, ProductCells

KINDS = ("flat", "ivf", "hnsw", "hnsw-q", "pq", "opq", "ivfpq", "diskann", "binary", "rabitq", "ivf-rabitq", "graph")


@dataclass(frozen=True)
class Index:
    kind: str
    metric: Metric
    tables: dict[str, DataFrame]
    models: dict[str, np.ndarray] = field(default_factory=dict)
    params: dict[str, int | float | str | bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")

    @property
    def rows(self) -> DataFrame:
        return self.tables["rows"]


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save(index: Index, path: str) -> None:
    """Replaces what index there is at path once all of the new one is written."""
    spark = index.rows.sparkSession
    version = uuid.uuid4().hex
    for name, table in index.tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
    models = {name: list(np.shape(m)) for name, m in index.models.items()}
    for name, m in index.models.items():
        flat = np.asarray(m, dtype=np.float64).reshape(len(m), -1) if np.ndim(m) else np.asarray(m, dtype=np.float64).reshape(1, 1)
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(flat)], "place long, v array<double>").coalesce(1).write.parquet(f"{path}/{version}/model-{name}")
    told = {"kind": index.kind, "metric": index.metric.name, "version": version, "tables": sorted(index.tables), "models": models, "params": index.params}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    here, fs = _path(spark, path)
    for status in fs.listStatus(here):
        if status.isDirectory() and status.getPath().getName() not in (version, "manifest"):
            fs.delete(status.getPath(), True)


def manifest(spark: SparkSession, path: str) -> dict:
    at, fs = _path(spark, f"{path}/manifest")
    if not fs.exists(at):
        raise ValueError(f"no index at {path}")
    lines = [r["value"] for r in spark.read.text(f"{path}/manifest").take(2)]
    told = json.loads(lines[0]) if len(lines) == 1 else {}
    if told.get("kind") not in KINDS:
        raise ValueError(f"not the manifest of an index: {path}")
    return told


def kind_of(spark: SparkSession, path: str) -> str:
    return manifest(spark, path)["kind"]


def load(spark: SparkSession, path: str) -> Index:
    told = manifest(spark, path)
    at = f"{path}/{told['version']}"
    models = {}
    for name, shape in told["models"].items():
        got = spark.read.parquet(f"{at}/model-{name}").orderBy("place").collect()  # a bounded model
        models[name] = np.array([r["v"] for r in got], dtype=np.float64).reshape(shape)
    return Index(told["kind"], Metric[told["metric"]], {t: spark.read.parquet(f"{at}/{t}") for t in told["tables"]}, models, told["params"])


def info(index: Index) -> dict:
    """What an index tells of itself; counts read the footers of its tables alone."""
    out: dict = {"kind": index.kind, "metric": index.metric.name.lower(), "count": index.rows.count()}
    first = index.rows.select(F.size("v").alias("n")).first() if "v" in index.rows.columns else None
    if first is not None:
        out["dim"] = first["n"]
    if "deleted" in index.rows.columns:
        out["live"] = index.rows.filter(~F.coalesce("deleted", F.lit(False))).count()
    if "centroids" in index.models:
        out["nlist"] = len(index.models["centroids"])
    links = next((c for c in ("layers", "links") if c in index.rows.columns), None)
    if links and out["count"]:
        size = F.size(F.element_at("layers", 1)) if links == "layers" else F.size("links")
        out["avg_degree"] = round(index.rows.agg(F.avg(size)).first()[0], 1)
    if index.kind == "graph":
        edges = index.tables["edges"].count()
        out |= {"edges": edges, "avg_degree": round(edges / max(out["count"], 1), 1)}
    return out | index.params


def of_cells(kind: str, rows: DataFrame, cells: Cells, **params: int | float | str) -> Index:
    """An index of `kernels`' cells: codes, exact vectors and the models that made them."""
    models = {"centroids": cells.centroids}
    if isinstance(cells, BitCells):
        models["turn"] = cells.turn
    if isinstance(cells, ProductCells):
        models |= {"turn": cells.books.turn} | {f"book-{j}": b for j, b in enumerate(cells.books.books)}
    return Index(kind, cells.metric, {"rows": rows}, models, params)


def cells_of(index: Index) -> Cells:
    m = index.models
    if "book-0" in m:
        return ProductCells(m["centroids"], Codebooks([m[f"book-{j}"] for j in range(sum(n.startswith("book-") for n in m))], m["turn"]), index.metric)
    return BitCells(m["centroids"], m["turn"], index.metric) if "turn" in m else Int8Cells(m["centroids"], index.metric)
