"""Collections that grow from streams, and streams of queries.

A stream of changes (seq, id, vector, deleted) is appended as it comes; the state of the collection is the change with
the greatest seq of each id, so late batches and batches that run again change nothing. Query streams are answered
batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vanefold.functions.vectors import Metric
from vanefold.operators.search import exact


def ingest(changes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream of changes to a Parquet log; the file sink commits every batch exactly once."""
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(log: DataFrame) -> DataFrame:
    """(id, vector) of the live rows of a log."""
    last = log.groupBy("id").agg(F.max_by(F.struct("vector", F.coalesce("deleted", F.lit(False)).alias("deleted")), "seq").alias("s"))
    return last.filter("not s.deleted").select("id", F.col("s.vector").alias("vector"))


def answer(queries: DataFrame, collection: DataFrame, k: int, metric: Metric, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hits of a stream of queries, one folder a batch, so a batch that runs again replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        exact(rows, collection, k, metric).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
