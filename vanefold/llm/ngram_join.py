"""Jaccard join of word-shingle sets by partitions of the universe, exact, with one class per near-duplicate group.

Two sets with sizes a <= b link when 9 * |difference| <= a + b, which is a Jaccard similarity of 0.8 or more. Sizes
fall into bands that double. A pair belongs to the band of its larger set, so a set is indexed in its own band, and in
the next one if it can be the smaller of a pair there.

Within a band, hashes cut the universe into m segments, so a set is m subsets. At most H of them differ in a linked
pair, hence both sets share one of their first H + 1 subsets in any common order (prefix principle). The order is by
how many sets have a subset, rare ones first: a set forgets its m - H - 1 most frequent subsets, so passages that very
many documents share make no candidates by themselves. A band may instead take half as many segments, with every
subset and all its one-deletion neighbours as keys, as one of (H + 1) / 2 segments differs by one element at most.
`allocation` takes whichever costs less under a model of rows and expected collisions.

Sets with equal digests are one class first, and one text of each class is a node. In each group of equal keys,
candidates are the group's hub with each other member, never all pairs. What is verified exactly (sizes, then a parity
sketch that bounds the difference from below, then the shingles themselves) gives components. All other pairs can only
matter between members of one group that lie in different components. Those members, usually few, are matched by a
second key: of n shingles, all but the 0.8 n - 1 most frequent among these members (prefix principle again), of which
two linked sets share one. So what very many of them have in common makes no pairs there either.

Null and empty texts have no shingles and link with nothing; one to four words are one shingle. Null ids are passed
through without links. Each (id, text) is a node of its own, nodes of one id are joined when components are formed, so
rows that repeat an id, with one text or several, share a component. Texts of any length are taken whole. No column but
the id and the text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from vanefold.llm.common import lean, limit_batches, scratch, small, steps, texts, written
from vanefold.llm.components import components
from vanefold.llm.shingles import mix, shingle_sets

#: Words of the parity sketch, 64 bits each.
SKETCH = 8
#: Cost model: the share of sets in which an element is expected at worst, and the work of a collision in rows.
FREQUENT, COLLISION = 0.3, 50.0


def band_of(n: int) -> int:
    return n.bit_length() - 1


def bounds(band: int) -> tuple[int, int]:
    return 1 << band, (1 << band + 1) - 1


def most_different(n: int, band: int) -> int:
    """The largest difference of a linked pair of the band in which a set of n is one."""
    return (n + max(n, min(n * 5 // 4, bounds(band)[1]))) // 9


@lru_cache(maxsize=64)
def allocation(band: int) -> tuple[int, bool]:
    """(segments, whether one-deletion neighbours are indexed) of a band."""
    lo, hi = bounds(band)
    n, h = (lo + hi) / 2, 2 * hi // 9
    exact = -(-6 * (h + 1) // 5) + 1
    cost = (h + 1) * (1 + COLLISION * FREQUENT ** max(1.0, n / exact))
    half = (h + 2) // 2
    cost_half = (half + n) * (1 + COLLISION * FREQUENT ** max(1.0, n / half - 1))
    return (half, True) if cost_half < cost else (exact, False)


def keys_in(band: int, s: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys of a sorted set of hashes in a band, and how many of them, the most frequent, it may forget."""
    m, deletions = allocation(band)
    seg = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 40))
    token = mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF))
    total = np.zeros(m, dtype=np.uint64)
    first = np.flatnonzero(np.diff(seg, prepend=-1))
    total[seg[first]] = np.add.reduceat(token, first)
    if deletions:
        return np.unique(np.concatenate([mix(total + salt), mix(total[seg] - token + salt[seg])])), 0
    return mix(total + salt), max(0, m - most_different(len(s), band) - 1)


def keys_of(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The keys under which a set is indexed, with what it may forget of them, for its own band and the next one."""
    n = len(s)
    if not n:
        return []
    band = band_of(n)
    return [keys_in(b, s) for b in (band, band + 1) if b == band or n * 5 // 4 >= bounds(b)[0]]


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 64 * SKETCH cells; two sketches differ in at most |difference| bits."""
    cell = (s & np.uint64(64 * SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of distinct hashes have a Jaccard similarity of 0.8 or more."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


SETS = "doc_id long, th long, n_shingles long, d1 long, d2 long, sketch array<bigint>"


def described(docs: DataFrame) -> DataFrame:
    """Size, digest and sketch of each document's set."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            sets = shingle_sets(b.column("text").to_pylist())
            digest = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            flat = np.concatenate([sketch_of(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("th"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCH), pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "th", "n_shingles", "d1", "d2", "sketch"],
            )

    return docs.mapInArrow(lean(run), SETS)


def _rows(docs: DataFrame, keys: Callable[[np.ndarray], list[tuple[np.ndarray, int]]]) -> DataFrame:
    """(key, node, tag) of the keys of each text's set; tag is twice the number of keys that may be forgotten, plus 1 in the second list."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            nodes = b.column("node").to_numpy(zero_copy_only=False)
            found = [(k, i, spare * 2 + up) for i, s in zip(nodes, shingle_sets(b.column("text").to_pylist()), strict=True) for up, (k, spare) in enumerate(keys(s))]
            if not found:
                continue
            flat = np.concatenate([k for k, _, _ in found]).view(np.int64)
            n = [len(k) for k, _, _ in found]
            owner, tag = np.repeat([i for _, i, _ in found], n), np.repeat([t for _, _, t in found], n)
            for at in range(0, len(flat), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(flat[part]), pa.array(owner[part], pa.int64()), pa.array(tag[part], pa.int32())], names=["key", "node", "tag"])

    return docs.select("node", "text").mapInArrow(lean(run), "key long, node long, tag int")


def indexed(docs: DataFrame) -> DataFrame:
    """The rows of the segment keys, in a set's own band (tag even) and the next one (odd)."""
    return _rows(docs, keys_of)


def by_shingle(docs: DataFrame) -> DataFrame:
    """The rows of single shingles; linked sets of n share one even if each forgets 0.8 n - 1."""
    return _rows(docs, lambda s: [(s, (4 * len(s) + 4) // 5 - 1)] if len(s) else [])


def sharing(rows: DataFrame) -> DataFrame:
    """(key, node, centre) of the keys that several nodes have, without those that a node may forget.

    centre is the sum of the frequencies of a node's keys: the greatest of a group of near copies is the copy that is
    nearest to all others.

    Keys of one node come first in the order by frequency, so what may be forgotten is among the shared ones. Both
    sides of the join read the same columns, so the rows are made and dealt out once.
    """
    rows = rows.repartition("key")
    groups = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"), F.max("tag").alias("top"))
    shared = rows.join(groups.filter("least != most and top >= 0").select("key", "n"), "key")
    each = Window.partitionBy("node", F.col("tag") % 2)
    placed_keys = shared.withColumn("place", F.row_number().over(each.orderBy(F.desc("n"), "key"))).withColumn("centre", F.sum("n").over(each))
    return placed_keys.filter(F.col("place") > F.floor(F.col("tag") / 2)).select("key", "node", "centre")


def may_link() -> Column:
    """Whether sizes n_a, n_b and sketches s_a, s_b do not rule a link out."""
    bits = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    size = (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")) & (F.least("n_a", "n_b") > 0)
    return size & (9 * bits <= F.col("n_a") + F.col("n_b"))


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    return pairs.filter(may_link()).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by their shingles. Only texts of some pair are moved."""
    pairs = written(pairs, docs.sparkSession)
    some = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    docs = docs.join(small(some), "node", "left_semi")
    with_b = pairs.join(docs.select(F.col("node").alias("b"), "text"), "b")
    both = with_b.join(docs.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, dtype=np.uint64))
        for b in steps(batches):
            others = b.column("text_a").to_pylist()
            found = []
            for s, other in zip(shingle_sets(b.column("text").to_pylist()), others, strict=True):
                if other != last[0]:
                    last = (other, shingle_sets([other])[0])
                found.append(linked(s, last[1]))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return both.select("a", "b", "text_a", "text").mapInArrow(lean(run), "a long, b long")


def placed(shared: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(key, node, root) and, of the keys whose members lie in several components, (key, hub, hub_root): the most central member, the least of equals."""
    root = F.col("node").alias("root") if roots is None else F.coalesce("root", "node").alias("root")
    rows = shared if roots is None else shared.join(roots, "node", "left")
    rows = rows.select("key", "node", "centre", root)
    keys = rows.groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("centre", -F.col("node"))).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    return rows.select("key", "node", "root"), keys.select("key", F.col("h.node").alias("hub"), F.col("h.root").alias("hub_root"))


def stars(shared: DataFrame, roots: DataFrame | None, tested: DataFrame | None, best: bool) -> DataFrame:
    """Pairs (a, b), not tested yet, of each key's hub and its members in other components.

    With best, each b has only the a with which it shares the most keys, so that a group of near copies, whose keys
    have many different hubs, makes as many pairs as it has members.
    """
    rows, keys = placed(shared, roots)
    pairs = rows.join(keys, "key").filter("root != hub_root").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("k"))
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    if best:
        pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
    return written(pairs.select("a", "b"), shared.sparkSession)


def crossing(shared: DataFrame, roots: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components, of nodes that some key has in common with another component, that share a
    rare shingle and that sizes and sketches do not rule out."""
    spark = shared.sparkSession
    rows, keys = placed(shared, roots)
    rest = written(rows.join(keys.select("key"), "key").select("node", "root").distinct(), spark)
    near = written(sharing(by_shingle(reps.join(small(rest.select("node")), "node", "left_semi"))), spark)
    each = near.select("key", "node").join(rest, "node").join(sets.select("node", "n_shingles", "sketch"), "node")
    left, right = (each.select("key", F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in ("a", "b"))
    met = left.withColumnRenamed("key", "key_a").join(right, (F.col("key_a") == F.col("key")) & F.expr("root_a != root_b and a < b") & may_link())
    return met.select("a", "b").distinct()


def named(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """rows with node: the id, or a hash of id and text where an id comes with several texts."""
    if several is None:
        return rows.withColumn("node", F.col("doc_id"))
    told = rows.join(small(several.withColumn("mixed", F.lit(True))), "doc_id", "left")
    return told.withColumn("node", F.when(F.col("mixed"), F.xxhash64("doc_id", "th")).otherwise(F.col("doc_id"))).drop("mixed")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row: component_id is the least id that links reach, class_id that of equal sets."""
    spark = docs.sparkSession
    with scratch(spark) as out:
        d = texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id").withColumn("th", F.xxhash64("text"))
        sets = written(described(d), spark)
        several = written(sets.filter("doc_id is not null").groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo != hi").select("doc_id"), spark)
        if not several.limit(1).count():
            several = None
        sets = named(sets, several)
        full = sets.filter("node is not null and n_shingles > 0")
        classes = written(full.groupBy("n_shingles", "d1", "d2").agg(F.min("node").alias("class_node"), F.min("doc_id").alias("class_id")), spark)
        copies = written(full.join(classes, ["n_shingles", "d1", "d2"]).filter("node != class_node or doc_id != class_id").select("node", "class_node", "class_id").distinct(), spark)
        other = small(copies.filter("node != class_node").select("node"))
        reps = named(d.filter("doc_id is not null"), several).select("node", "text").join(other, "node", "left_anti")
        rep_sets = full.join(other, "node", "left_anti").dropDuplicates(["node"])

        shared = written(sharing(indexed(reps)), spark)
        links, tested, roots = None, None, None
        for best in (True, False):
            pairs = stars(shared, roots, tested, best)
            found = written(verified(possible(pairs, rep_sets), reps), spark)
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = found if links is None else links.unionByName(found)
            roots = components(links)
        second = written(verified(crossing(shared, roots, rep_sets, reps).join(tested, ["a", "b"], "left_anti"), reps), spark)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)
        edges = edges.unionByName(copies.select(F.col("class_node").alias("a"), F.col("node").alias("b")))
        if several is not None:
            edges = edges.unionByName(sets.join(small(several), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
        told = sets.join(copies, "node", "left").join(components(edges), "node", "left")
        told = told.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
        if several is not None:  # the least node may be a hash
            least = told.groupBy("component_id").agg(F.min("doc_id").alias("least"))
            told = told.join(least, "component_id", "left").withColumn("component_id", F.col("least")).drop("least")
        return out(told.select("doc_id", "n_shingles", "component_id", "class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least id, with the columns it had; rows without an id stay.

    Of rows that repeat that id, one with the least hash of its text stays.
    """
    spark = docs.sparkSession
    with scratch(spark) as out:
        told = near_duplicates(docs)
        others = out(told.filter("doc_id != component_id").select("doc_id").distinct())
        again = out(told.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept = docs.join(small(others), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    if not again.limit(1).count():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.join(small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("row"))
    return kept.join(small(again), "doc_id", "left_anti").select(docs.columns).unionByName(first.select("row.*"))
