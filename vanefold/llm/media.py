"""Media columns: texts stored without loss in baseline JPEG files, read back, with dimensions and thumbnail hashes.

Null and empty texts are stored as one block of 64 zero bytes. Equal texts have equal files and features. Texts of any
length are stored whole (a file holds up to 8191 x 8191 blocks, 4 GB). Files that are null, broken, progressive or not
stored by this module have null payload columns and a null feature. Repeated rows give a row each; an empty table gives
an empty one. No column but those named is read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.llm import jpeg
from vanefold.llm.common import limit_batches, steps, texts

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % jpeg.BLOCK if raw else jpeg.BLOCK)


def media_files(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text's file."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array([len(r) for r in raw], pa.int64()), pa.array(jpeg.write_files([pad(r) for r in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What reading a file raises that is no baseline JPEG of this module.
BROKEN = (ValueError, IndexError, KeyError, StopIteration, struct.error)


def read_stored(files: list[bytes]) -> list[tuple[jpeg.Head, np.ndarray, bytes] | None]:
    """(head, coefficients, payload) of each file, None where it can't be read; one broken file doesn't stop the others."""
    try:
        return [(*r, jpeg.payload(*r)) for r in jpeg.read_files(files)]
    except BROKEN:
        return [read_stored([f])[0] for f in files] if len(files) > 1 else [None]


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, n_bytes, media) give when they are read back."""
    limit_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "media"):
            files = b.column("media").to_pylist()
            read = read_stored([f or b"" for f in files])
            stored = [r and r[2] for r in read]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("n_bytes"),
                    pa.array([None if p is None else len(p) for p in stored], pa.int64()),
                    pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in stored], pa.string()),
                    pa.array([None if p is None else zlib.crc32(p[-jpeg.BLOCK :]) for p in stored], pa.int64()),
                    pa.array([None if f is None else len(f) for f in files], pa.int64()),
                    pa.array([None if f is None else hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    pa.array([r and jpeg.feature(r[0], r[1]) for r in read], pa.string()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return media.mapInArrow(run, SCHEMA)
