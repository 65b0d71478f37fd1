"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each distinct word shingle is hashed once; its high bits choose one of BINS bins, which keeps the least of the other
bits. An empty bin borrows from the first non-empty bin in an order of its own, the same for all texts; what
it borrows is mixed with its own number, so that a text of few shingles fills its bins with unlike bits. The low BITS
bits of each bin are packed into a hex string. Of two fingerprints, the share p of equal bins estimates the Jaccard
similarity as (p - c) / (1 - c) with c = 2^-BITS, the share that agrees by chance.

Null and empty texts, and texts without words, have the fingerprint ''. Equal fingerprints (the empty ones too) have
likeness 1, an empty one and another 0. Rows follow one another by descending doc_id, of equal ids by their text; null
ids come last. The row after the last is the first, so a single row is its own next one. Repeated rows give a row each;
an empty table gives an empty one. Texts of any length are taken whole, and no column but the id and the text is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanefold.llm.common import limit_batches, steps
from vanefold.llm.shingles import mix, shingle_hashes

BINS, BITS = 512, 4
_HIGH = np.uint64(64 - BINS.bit_length() + 1)
_NONE = np.uint64(2**64 - 1)
_ODD = mix(np.arange(1, BINS + 1, dtype=np.uint64)) | np.uint64(1)
_orders: list[np.ndarray] = []


def _donor_ranks() -> np.ndarray:
    """ranks[b, j]: how soon bin b asks bin j, by a fixed pseudo-random order of its own."""
    if not _orders:
        keys = mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BINS, BINS)
        ranks = np.empty((BINS, BINS), dtype=np.int16)
        np.put_along_axis(ranks, np.argsort(keys, axis=1), np.arange(BINS, dtype=np.int16)[None, :], axis=1)
        _orders.extend([ranks, np.argsort(keys, axis=1).astype(np.int16)])
    return _orders[0]


def bins_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of every bin by text, whether the text has a shingle)."""
    h, who = shingle_hashes(texts)
    least = np.full(len(texts) * BINS, _NONE, dtype=np.uint64)
    np.minimum.at(least, who * BINS + (h >> _HIGH).astype(np.int64), h & ((np.uint64(1) << _HIGH) - np.uint64(1)))
    least = least.reshape(len(texts), BINS)
    there = least != _NONE
    some = there.any(axis=1)
    low = (least & np.uint64(2**BITS - 1)).astype(np.uint8)
    ranks = _donor_ranks()
    order = _orders[1]

    def borrowed(row: np.ndarray, donor: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (least[row, donor] * _ODD[b] >> np.uint64(64 - BITS)).astype(np.uint8)

    row, b = np.nonzero(~there & some[:, None])
    for t in range(6):  # most empty bins find a donor at once
        if not len(row):
            break
        j = order[b, t]
        ok = there[row, j]
        low[row[ok], b[ok]] = borrowed(row[ok], j[ok], b[ok])
        row, b = row[~ok], b[~ok]
    if len(row):
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        for x, y in zip(cuts, [*cuts[1:], len(row)], strict=True):
            full = np.flatnonzero(there[row[x]])
            low[row[x], b[x:y]] = borrowed(row[x:y], full[np.argmin(ranks[b[x:y]][:, full], axis=1)], b[x:y])
    return low, some


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    pairs = (low[:, 0::2] << 4) | low[:, 1::2]
    return [p.tobytes().hex() if s else "" for p, s in zip(pairs, some, strict=True)]


def likeness(low_a: np.ndarray, some_a: np.ndarray, low_b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """The corrected share of equal bins, row by row."""
    chance = 2.0**-BITS
    out = np.clip(((low_a == low_b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, out, (some_a == some_b).astype(np.float64))


def fingerprint_likeness(a: str, b: str) -> float:
    """The likeness of two packed fingerprints."""
    if not a or not b:
        return float(a == b)
    low = [np.array([[int(c, 16) for c in x]], dtype=np.uint8) for x in (a, b)]
    yes = np.ones(1, dtype=bool)
    return float(likeness(low[0], yes, low[1], yes)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints; one narrow pass."""
    limit_batches(docs.sparkSession)
    clean = docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(out)
    names = clean.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed(*bins_of(b.column(text).to_pylist())), pa.string())], names=[*names, out])

    return clean.mapInArrow(run, T.StructType([*clean.schema, T.StructField(out, T.StringType())]))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Bytes of text in a range of ids, about; the number of ranges grows with the texts.
RANGE_BYTES = 32 << 20


def id_ranges(keys: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) key of each of about k ranges of as many rows, ascending; equal keys share a range.

    Spark deals the keys alone to range partitions, and one row of each comes to the driver.
    """
    dealt = keys.repartitionByRange(k, "key").select("key", F.spark_partition_id().alias("part"))
    got = sorted((r["low"], r["top"]) for r in dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("top")).collect())
    low, top = (np.array([x[i] for x in got], dtype=np.int64) for i in (0, 1))
    return low, top


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (doc_id, text, bucket, more), sorted in partitions so that each row's next one by descending id follows it.

    Ids are dealt to ranges, the buckets. The first row of each range is also sent to the range before it, with
    more = 1. Texts are shuffled once. Rows that repeat an id share a range, as their order is by their texts.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    size = d.agg(F.sum(F.octet_length("text").cast("long")).alias("size")).first()["size"] or 0
    held = spark.sparkContext.broadcast(id_ranges(d.select(key.alias("key")), int(size // range_bytes) + 1))
    ranges = len(held.value[0])

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series) -> pd.Series:
        low, top = held.value
        keys = ids.to_numpy(dtype=np.int64)
        at = np.searchsorted(low, keys, side="right") - 1
        first = keys == top[at]  # by descending id; the range before it holds greater ids
        return pd.Series([[x, (x + 1) % ranges] if y else [x] for x, y in zip(at.tolist(), first.tolist(), strict=True)])

    rows = d.select("doc_id", "text", F.posexplode(buckets(key)).alias("more", "bucket"))
    return rows.repartitionById(max(ranges, 1), "bucket").sortWithinPartitions(F.asc("bucket"), F.asc("more"), F.desc_nulls_last("doc_id"), F.asc("text"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document."""
    limit_batches(docs.sparkSession)
    rows = with_next(docs, range_bytes=range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row that waits for its next one
        for b in steps(batches):
            cols = b.to_pydict()
            rows = list(zip(cols["doc_id"], cols["text"], cols["bucket"], cols["more"], strict=True))
            if held is not None:
                rows.insert(0, held)
            pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            held = rows[-1]
            if not pairs:
                continue
            own, own_some = bins_of([r[1] for r in rows])
            new = [edited(rows[i][1], rows[i + 1][1]) for i in pairs]
            low, some = bins_of(new)
            at, after = np.array(pairs), np.array(pairs) + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[i][0] for i in pairs], pa.int64()),
                    "n_chars": pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                    "fingerprint": pa.array(packed(own[at], own_some[at]), pa.string()),
                    "edited_fingerprint": pa.array(packed(low, some), pa.string()),
                    "near_edited": pa.array(likeness(own[at], own_some[at], low, some), pa.float64()),
                    "near_next": pa.array(likeness(own[at], own_some[at], own[after], own_some[after]), pa.float64()),
                }
            )

    return rows.mapInArrow(run, SCHEMA)
