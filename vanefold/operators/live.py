"""Graphs that change one event at a time: edges are a node's nearest others when it came, not those of the final set.

Events are rows (graph, seq, op, id, vector, title, tags, dst, k) and act in the order of seq within a graph, each graph in a
task of its own; thus many graphs scale out and one graph must fit a task. Operations:

- insert: the node replaces one with its id, whose edges go; it is linked both ways with its k nearest nodes. Without k,
  the graph's own k is taken. Tags null and op insert_tagged: the nearest nodes' vote gives them.
- remove: the node goes, with its edges, links and metadata. link: an edge by hand from id to dst.
- meta: title and tags in place of those there were.

`frozen` gives nodes and edges as `graph` has them. Events on unknown nodes change nothing. Null ids are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.functions.vectors import Metric

EVENTS = "graph long, seq long, op string, id long, vector array<double>, title string, tags array<string>, dst long, k int"
STATE = "graph long, node boolean, src long, dst long, weight double, kind string, title string, tags array<string>, vector array<double>"


class LiveGraph:
    """One graph: nodes by id, semantic edges by (src, dst), links."""

    def __init__(self, metric: Metric = Metric.COSINE, k: int = 10, min_score: float = 0.15, max_tags: int = 5) -> None:
        self.metric, self.k, self.min_score, self.max_tags = metric, k, min_score, max_tags
        self.vectors: dict[int, np.ndarray] = {}
        self.meta: dict[int, tuple[str | None, list[str]]] = {}
        self.edges: dict[int, dict[int, float]] = {}
        self.links: set[tuple[int, int]] = set()

    def __contains__(self, node: int) -> bool:
        return node in self.vectors

    def __len__(self) -> int:
        return len(self.vectors)

    def nearest(self, v: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(id, score) of the k nearest nodes, the lower id of equals."""
        if not self.vectors:
            return []
        ids = np.array(sorted(self.vectors))
        x = np.stack([self.vectors[i] for i in ids])
        keys = ((x - v) ** 2).sum(1) if self.metric is Metric.L2 else -(x @ v)
        best = np.lexsort((ids, keys))[:k]
        return [(int(ids[i]), float(keys[i] if self.metric is Metric.L2 else -keys[i])) for i in best]

    def prepared(self, v: list[float]) -> np.ndarray:
        x = np.asarray(v, dtype=np.float64)
        n = np.linalg.norm(x)
        return x / n if self.metric is Metric.COSINE and n > 0 else x

    def suggest_tags(self, v: list[float], k: int | None = None) -> list[str]:
        hits = [(i, max(s, 0.0)) for i, s in self.nearest(self.prepared(v), k or self.k)]
        total = sum(s for _, s in hits)
        votes: dict[str, float] = {}
        for i, s in hits:
            for t in set(self.meta.get(i, (None, []))[1]):
                votes[t] = votes.get(t, 0.0) + s
        shares = {t: s / total for t, s in votes.items()} if total > 0 else {}
        return sorted((t for t, s in shares.items() if s >= self.min_score), key=lambda t: (-shares[t], t))[: self.max_tags]

    def insert(self, node: int, v: list[float], title: str | None = None, tags: list[str] | None = None, k: int | None = None) -> None:
        if node in self.vectors:
            self._cut(node)
            del self.vectors[node]
        x = self.prepared(v)
        for other, weight in self.nearest(x, k or self.k):
            self.edges.setdefault(node, {})[other] = weight
            self.edges.setdefault(other, {})[node] = weight
        self.vectors[node] = x
        if title is not None or tags is not None or node not in self.meta:
            self.set_meta(node, title, tags)

    def insert_tagged(self, node: int, v: list[float], title: str | None = None, k: int | None = None) -> list[str]:
        tags = self.suggest_tags(v, k)
        self.insert(node, v, title, tags, k)
        return tags

    def _cut(self, node: int) -> None:
        for other in self.edges.pop(node, {}):
            self.edges.get(other, {}).pop(node, None)

    def remove(self, node: int) -> bool:
        if node not in self.vectors:
            return False
        self._cut(node)
        del self.vectors[node]
        self.meta.pop(node, None)
        self.links = {e for e in self.links if node not in e}
        return True

    def link(self, src: int, dst: int) -> None:
        if src != dst:
            self.links.add((src, dst))

    def set_meta(self, node: int, title: str | None, tags: list[str] | None) -> None:
        self.meta[node] = ((title or "").strip() and title or None, sorted({t for t in tags or [] if t}))

    def frozen(self, max_degree: int | None = None, link_weight: float = 1.0) -> list[tuple[int, int, float, str]]:
        """(src, dst, weight, kind), each node's heaviest edges, at most max_degree (four times k by default)."""
        most, out = max_degree if max_degree is not None else 4 * max(self.k, 1), []
        links: dict[int, set[int]] = {}
        for a, b in self.links:
            if a in self.vectors and b in self.vectors:
                links.setdefault(a, set()).add(b)
        for src in sorted(self.vectors):
            own = {dst: (w, "semantic") for dst, w in self.edges.get(src, {}).items()}
            for dst in links.get(src, ()):
                own[dst] = (max(own[dst][0], link_weight), "both") if dst in own else (link_weight, "link")
            out += [(src, dst, w, kind) for dst, (w, kind) in sorted(own.items(), key=lambda e: (-e[1][0], e[0]))[:most]]
        return out

    def apply(self, op: str, node: int, vector=None, title=None, tags=None, dst=None, k=None) -> None:
        if op == "insert" and vector is not None:
            self.insert(node, vector, title, tags, k)
        elif op == "insert_tagged" and vector is not None:
            self.insert_tagged(node, vector, title, k)
        elif op == "remove":
            self.remove(node)
        elif op == "link" and dst is not None:
            self.link(node, dst)
        elif op == "meta" and node in self:
            self.set_meta(node, title, tags)


def _known(x):
    return None if x is None or (not isinstance(x, (list, np.ndarray)) and pd.isna(x)) else x


def replayed(events: DataFrame, metric: Metric = Metric.COSINE, k: int = 10, max_degree: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (graph, id, title, tags, vector), edges (graph, src, dst, weight, kind)) after all events."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g = LiveGraph(metric, k)
        for e in frame.sort_values("seq").itertuples(index=False):
            own = _known(e.k)
            dst = _known(e.dst)
            tags = _known(e.tags)
            g.apply(e.op, int(e.id), _known(e.vector), _known(e.title), list(tags) if tags is not None else None, None if dst is None else int(dst), None if own is None else int(own))
        name = frame["graph"].iloc[0]
        rows = [(name, True, i, None, None, None, *g.meta.get(i, (None, [])), g.vectors[i].tolist()) for i in sorted(g.vectors)]
        rows += [(name, False, a, b, w, kind, None, None, None) for a, b, w, kind in g.frozen(max_degree)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])
        return out.astype({"src": "Int64", "dst": "Int64"})

    state = events.filter("id is not null and graph is not null").groupBy("graph").applyInPandas(run, STATE)
    return state.filter("node").select("graph", F.col("src").alias("id"), "title", "tags", "vector"), state.filter("not node").select("graph", "src", "dst", "weight", "kind")
