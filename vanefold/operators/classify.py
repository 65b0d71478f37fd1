"""Tags for new vectors by the vote of their nearest labelled ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric
from vanefold.operators import graph, search


@dataclass(frozen=True)
class TagClassifier:
    """labelled: (id, vector, tags). Rows added replace those with their ids."""

    labelled: DataFrame
    metric: Metric = Metric.COSINE

    def add(self, rows: DataFrame) -> TagClassifier:
        rows = rows.select("id", "vector", "tags")
        return TagClassifier(self.labelled.select("id", "vector", "tags").join(rows.select("id"), "id", "left_anti").unionByName(rows), self.metric)

    def suggest(self, queries: DataFrame, k: int = 10, min_score: float = 0.0, min_votes: int = 1, max_tags: int = 5) -> DataFrame:
        """(query_id, tag, score, votes) of tags whose share of the neighbours' weight is at least min_score."""
        hits = search.exact(queries, self.labelled, k, self.metric)
        tagged = self.labelled.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
        return graph.suggested_tags(hits, tagged, min_score, min_votes, max_tags)
