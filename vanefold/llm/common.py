"""What the operators of this subpackage share: tables, batches bounded by bytes, and workers that give memory back."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanefold.sources.shared import scratch, shared_folder, written  # noqa: F401

#: Bytes of text that one step of an Arrow kernel takes at once; a single longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Rows of ids (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 2_000_000
#: What kernels remember in a worker from one task to the next.
_remembered: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows and bytes, so that a run of very long texts fits a Python worker.

    Batches are cut when a plan runs, which is after an operator has returned, so the limits stay in the session; they
    are only ever lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def texts(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns kept and the text, with null as the empty text."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def remembered(what: dict) -> dict:
    """what, to be emptied when a kernel that gives memory back ends in this worker."""
    _remembered.append(what)
    return what


def give_back() -> None:
    """Memory that this worker no longer uses goes to the system, with what kernels remember."""
    for what in _remembered:
        what.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same Arrow kernel; at a task's end its worker gives memory back.

    Spark keeps idle workers, as many as ever ran at once, so what each holds adds up beside the next stage's: where two
    kernels follow each other in one stage, an executor keeps two workers a core.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kernel


def within(df: DataFrame, rows: int) -> bool:
    """Whether there are at most so many rows; reads no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if within(df, rows) else df
