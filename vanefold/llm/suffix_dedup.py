"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that starts anywhere else are removed.

1. Every window of every text has an anchor; windows in a row with one anchor form a context (see anchors.py). Equal
   windows share their anchor's k-mer and their place about it, so only contexts whose k-mer recurs are looked at.
   This step is exact: it drops no window that occurs twice.
2. Where a whole context recurs, all its windows do. Counting those, and how many contexts a k-mer has, takes narrow
   rows of hashes.
3. The other contexts of a k-mer with several are fetched, one of each, and trimmed to the parts that could match.
   Blocks of them go through Burrows-Wheeler transforms of shards, merged by interleave refinement (see bwt.py), whose
   intervals of WINDOW common bytes give the repeated windows.
4. A k-mer with more than SPLIT contexts (a passage that very many texts share) is dealt out first, so that no task has
   all of it: its contexts are cut into parts of NARROW windows, by their place about the anchor, and a part is merged
   only with those that have the same place and the same bytes common to all its windows. Parts of wider cells that
   have no such partner are not cut at all, and equal parts are one. Parts of one group differ by NARROW - 1 bytes at
   either end, so a group stays small however many texts it stands for. Any split gives the same windows.

Whole contexts are compared by the 64-bit hash of their k-mer and another one of their bytes and anchor; in the merge
strings are compared symbol by symbol. Null and empty texts and texts shorter than WINDOW lose nothing. Matches never
cross texts, as each string has its own end. Rows that repeat an id and a text count as two texts; both lose what they
share. Null ids are taken as equal ids. Other columns, whatever their names, are passed through.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from vanefold.llm.anchors import KMER, anchors
from vanefold.llm.bwt import repeated_starts
from vanefold.llm.common import lean, limit_batches, scratch, steps, written

WINDOW = 200
#: Windows whose common bytes are tested together before the merge, and bytes of a block that is merged at once.
CELL, BLOCK = 17, 1 << 17
#: Contexts of one k-mer that are merged as one group, and windows of a part where a k-mer with more is dealt out.
SPLIT, NARROW = 2000, 3

ROWS = "id long, th long, kmer long, context long, first int, last int, anchor int"


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as _0, _1, ... with _id and _th (a hash of the text), which name a text, and _raw, its bytes."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(t).alias("_th"), t.cast("binary").alias("_raw"))


def anchored(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per context of each text."""
    limit_batches(keyed.sparkSession)
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_raw"):
            found = [anchors(r, window) for r in b.column("_raw").to_pylist()]
            n = [len(f["kmer"]) for f in found]
            cols = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in ("_id", "_th")]
            cols += [np.concatenate([f[c] for f in found]).view(np.int64) for c in ("kmer", "context")]
            cols += [np.concatenate([f[c] for f in found]).astype(np.int32) for c in ("first", "last", "anchor")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return keyed.select("_id", "_th", "_raw").filter(F.length("_raw") >= window).mapInArrow(lean(run), ROWS)


def _trimmed(group: list[tuple], window: int) -> list[tuple]:
    """(context, offset of the trimmed part, trimmed bytes, occurrences) of the contexts of one k-mer that could match."""
    seen: Counter = Counter()
    parts: list[list[tuple]] = []
    for _, raw, anchor, _ in group:
        low, high = anchor - (len(raw) - window), anchor  # places of the anchor in the context's windows
        own = []
        for c in range(low // CELL, high // CELL + 1):
            # the bytes that all windows of the cell share
            own.append((c, raw[anchor - c * CELL : anchor - min(c * CELL + CELL - 1, window - KMER) + window]))
        seen.update(own)
        parts.append(own)
    out = []
    for (context, raw, anchor, n), mine in zip(group, parts, strict=True):
        low, high = anchor - (len(raw) - window), anchor
        hit = [c for c, part in mine if seen[c, part] > 1]
        if hit:
            to, at = max(low, min(hit) * CELL), min(high, max(hit) * CELL + CELL - 1)
            out.append((context, anchor - at, raw[anchor - at : anchor - to + window], n))
    return out


def matched(contexts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(kmer, context, starts): the windows of each context that occur elsewhere, as runs (first, last) of starts.

    contexts: (kmer, context, raw, anchor, n), where n is how often the context occurs. Rows of one k-mer lie together.
    """
    sorted_ = contexts.repartition("kmer").sortWithinPartitions("kmer")
    limit_batches(contexts.sparkSession)

    def solve(block: list[tuple]) -> pa.RecordBatch:
        kmers, names, runs = [], [], []
        for (kmer, context, offset, _, _), s in zip(block, repeated_starts([x[3] for x in block], window, [1] * len(block)), strict=True):
            if len(s):
                cut = np.flatnonzero(np.diff(s) != 1)
                first, last = s[np.concatenate([[0], cut + 1])] + offset, s[np.concatenate([cut, [len(s) - 1]])] + offset
                kmers.append(kmer)
                names.append(context)
                runs.append([x for p in zip(first.tolist(), last.tolist(), strict=True) for x in p])
        return pa.RecordBatch.from_arrays([pa.array(kmers, pa.int64()), pa.array(names, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["kmer", "context", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, group, at = 0, [], None

        def add() -> None:
            nonlocal size
            for context, offset, raw, n in _trimmed(group, window):
                block.append((at, context, offset, raw, n))
                size += len(raw)

        for b in steps(batches, "raw"):
            for kmer, context, raw, anchor, n in zip(*(b.column(c).to_pylist() for c in ("kmer", "context", "raw", "anchor", "n")), strict=True):
                if kmer != at:
                    add()
                    group, at = [], kmer
                    if size >= BLOCK:
                        yield solve(block)
                        block, size = [], 0
                group.append((context, raw, anchor, n))
        add()
        if block:
            yield solve(block)

    return sorted_.select("kmer", "context", "raw", "anchor", "n").mapInArrow(lean(run), "kmer long, context long, runs array<int>")


def _cells(raw: bytes, anchor: int, width: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(cell, its first and last place, hash of the bytes that all its windows share) of the windows of a context, `width` places a cell."""
    low, high = anchor - (len(raw) - window), anchor  # places of the anchor in the context's windows
    for c in range(low // width, high // width + 1):
        first, last = c * width, min(c * width + width - 1, window - KMER)
        yield c, max(low, first), min(high, last), xxh3_64_intdigest(raw[anchor - first : anchor - last + window], c) - (1 << 63)


def dealt_out(contexts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same as `matched` for k-mers with very many contexts: by parts of NARROW windows."""
    spark = contexts.sparkSession
    limit_batches(spark)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "raw"):
            found = [(k, x, c, h) for k, x, raw, a in zip(*(b.column(c).to_pylist() for c in ("kmer", "context", "raw", "anchor")), strict=True) for c, _, _, h in _cells(raw, a, CELL, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["kmer", "context", "cell", "mark"])

    cells = written(contexts.mapInArrow(lean(wide), "kmer long, context long, cell int, mark long"), spark)
    again = written(cells.groupBy("kmer", "cell", "mark").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).filter("lo != hi").select("kmer", "cell", "mark"), spark)
    hit = cells.join(again, ["kmer", "cell", "mark"], "left_semi").groupBy("kmer", "context").agg(F.collect_set("cell").alias("cells"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "raw"):
            out = []
            for k, x, raw, a, wanted in zip(*(b.column(c).to_pylist() for c in ("kmer", "context", "raw", "anchor", "cells")), strict=True):
                wanted = set(wanted)
                for _, first, last, h in _cells(raw, a, NARROW, window):
                    if first // CELL in wanted or last // CELL in wanted:
                        part = raw[a - last : a - first + window]
                        out.append((k, x, h ^ k, xxh3_64_intdigest(part, first) - (1 << 63), part, last, a - last))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kmer", "context", "group", "part", "raw", "anchor", "offset"])

    made = contexts.join(hit, ["kmer", "context"]).select("kmer", "context", "raw", "anchor", "cells").mapInArrow(lean(narrow), "kmer long, context long, group long, part long, raw binary, anchor int, offset int")
    made = written(made, spark)
    kinds = written(made.groupBy("group", "part").agg(F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("anchor").alias("anchor")), spark)
    found = matched(kinds.withColumnsRenamed({"group": "kmer", "part": "context"}), window).withColumnsRenamed({"kmer": "group", "context": "part"})
    every = kinds.filter("n > 1").select("group", "part", F.array(F.lit(0), (F.length("raw") - window).cast("int")).alias("runs"))
    once = kinds.filter("n = 1").select("group", "part").join(found, ["group", "part"])
    runs = written(every.unionByName(once), spark)
    back = made.select("kmer", "context", "group", "part", "offset").join(runs, ["group", "part"])
    return back.select("kmer", "context", F.transform("runs", lambda x: x + F.col("offset")).alias("runs")).groupBy("kmer", "context").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_runs(keyed: DataFrame, window: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """(id, th, runs): the bytes of each text to remove, as flat (start, end) pairs in no order.

    Counts are aggregated in part before they move and written before rows join them, so that a k-mer or context which
    holds a large share of all rows is split by adaptive execution instead of lying in one task.
    """
    spark = keyed.sparkSession
    with scratch(spark) as out:
        rows = written(anchored(keyed, window), spark)
        kinds = rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).filter("n > 1")
        recurring = written(rows.join(written(kinds.select("kmer", (F.col("lo") != F.col("hi")).alias("mixed")), spark), "kmer"), spark)
        whole = recurring.filter("not mixed")

        mixed = recurring.filter("mixed")
        # any of the equal contexts will do; all columns come from one row
        one = written(mixed.groupBy("kmer", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "th", "first", "last", "anchor"))), spark)
        whole = whole.drop("mixed").unionByName(mixed.drop("mixed").join(one.filter("n > 1").select("kmer", "context"), ["kmer", "context"], "left_semi"))
        wanted = one.groupBy("id", "th").agg(F.collect_list(F.struct("kmer", "context", "first", "last", "anchor", "n")).alias("wanted"))
        texts = keyed.select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_raw").alias("raw"))
        met = wanted.join(texts, ["id", "th"]).select("raw", F.explode("wanted").alias("w"))
        part = F.expr(f"substring(raw, w.first + 1, w.last - w.first + {window})")
        contexts = met.select("w.kmer", "w.context", part.alias("raw"), (F.col("w.anchor") - F.col("w.first")).alias("anchor"), "w.n").dropDuplicates(["kmer", "context"])
        hot = written(one.groupBy("kmer").agg(F.count("*").alias("variants")).filter(F.col("variants") > split).select("kmer"), spark)
        if hot.limit(1).count():
            contexts = written(contexts, spark)
            found = written(matched(contexts.join(hot, "kmer", "left_anti"), window), spark).unionByName(written(dealt_out(contexts.join(hot, "kmer", "left_semi"), window), spark))
        else:
            found = written(matched(contexts, window), spark)
        partly = one.filter("n = 1").join(found, ["kmer", "context"]).select("id", "th", F.transform("runs", lambda x, i: F.col("first") + x + F.when(i % 2 == 1, window).otherwise(0)).alias("runs"))
        whole = whole.select("id", "th", F.array("first", F.col("last") + window).alias("runs"))
        return out(whole.unionByName(partly).groupBy("id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def merged_spans(runs: list[int] | None) -> list[tuple[int, int]]:
    """The maximal spans that flat (start, end) pairs cover."""
    if not runs:
        return []
    a = np.array(runs, dtype=np.int64).reshape(-1, 2)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    cut = np.flatnonzero(a[1:, 0] > reach[:-1])
    return list(zip(a[np.concatenate([[0], cut + 1]), 0].tolist(), reach[np.concatenate([cut, [len(a) - 1]])].tolist(), strict=True))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they hold in part."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_runs(docs: DataFrame, window: int, split: int = SPLIT) -> DataFrame:
    keyed = _keyed(docs)
    runs = repeated_runs(keyed, window, split).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("runs").alias("_runs"))
    return keyed.join(runs, ["_id", "_th"], "left")


def dedup_report(docs: DataFrame, window: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, split).select(F.col("_0").alias("doc_id"), "_raw", "_runs")
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_raw"):
            raw = b.column("_raw").to_pylist()
            spans = [merged_spans(r) for r in b.column("_runs").to_pylist()]
            kept = [without(r, s) for r, s in zip(raw, spans, strict=True)]
            n = [len(r) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array([x - len(k) for x, k in zip(n, kept, strict=True)], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return rows.mapInArrow(lean(run), schema)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated strings cut out of their texts, whole characters at a time; other columns as they were."""
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    names = [at[c] for c in docs.columns if c != "text"]
    rows = _with_runs(docs, window).select(*names, "_raw", "_runs")
    limit_batches(docs.sparkSession)
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField(at["text"], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_raw"):
            kept = [without(r, whole_characters(r, merged_spans(s))).decode() for r, s in zip(b.column("_raw").to_pylist(), b.column("_runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, pa.string())], names=schema.names)

    return rows.mapInArrow(lean(run), schema).select([F.col(at[c]).alias(c) for c in docs.columns])
