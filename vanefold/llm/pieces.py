"""SentencePiece models on the tokenizers library: the model's protobuf is read, and its steps are rebuilt.

Read from the protobuf: pieces with scores and types, the kind of model, the precompiled normaliser, the dummy prefix,
the handling of spaces, and byte fallback. A unigram model becomes the library's Unigram, a BPE model its BPE, with
merges derived from the scores: a piece's rank is the order of its score, whichever two pieces it is joined from.

Where no piece holds the space mark after another character, texts part exactly before a mark that follows one, and
each distinct word is encoded once while it is remembered; words not seen yet go through the library in multithreaded
batches, many joined to one text, as no piece reaches over a mark: a piece that begins with one begins a word. With other models whole texts do. User-defined pieces are matched by score like others, not first, so models
that have some are refused. `report` compares the ids of every text with those of the original library.

Null and empty texts have no pieces. Texts of any length are encoded whole, and decode to their normalised form.
Repeated rows give a row each; an empty table gives an empty one. No column but the id and the text is read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.llm.common import limit_batches, steps, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED = 1_000_000
#: Words that are joined to one text of a batch.
JOINED = 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    @staticmethod
    def read(path: str) -> Model:
        out = Model()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n == 3:
                        out.dummy_prefix = bool(v)
                    elif n == 4:
                        out.trim = bool(v)
                    elif n == 5:
                        out.escape = bool(v)
        return out


def backend(model: Model, normalised: bool = False):  # noqa: ANN201
    """The library's tokenizer for a model, of texts as they are or of texts that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if any(k == USER for _, _, k in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    if model.kind == 1:
        made = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback))
    elif model.kind == 2:
        usable = {p for p, _, k in model.pieces if k in (NORMAL, USER)}
        order = sorted((-s, i, p) for i, (p, s, k) in enumerate(model.pieces) if k in (NORMAL, USER) and len(p) > 1)
        merges = [(p[:c], p[c:]) for _, _, p in order for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
        made = Tokenizer(models.BPE(vocab, merges, unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError("a unigram or BPE model is needed")
    steps_ = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps_ += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps_.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps_.append(normalizers.Replace(" ", MARK))
    if not normalised:
        made.normalizer = normalizers.Sequence(steps_)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return made


class Codec:
    """Encodes and decodes whole texts; ids are little-endian bytes, four an id."""

    def __init__(self, path: str) -> None:
        self.model = Model.read(path)
        self.library = backend(self.model)
        self.marked = backend(self.model, normalised=True)
        named = [p for p, _, k in self.model.pieces if k in (NORMAL, USER, UNUSED)]
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in named) and self.model.kind == 2 and not self.model.trim and self.model.escape and self.model.dummy_prefix and not self.model.charsmap
        newline = any("\n" in p for p in named)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if newline else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.begins = np.array([p.startswith(MARK) and k in (NORMAL, USER) for p, _, k in self.model.pieces])
        self.joins = self.by_word and any(p == MARK for p in named)
        self.known: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]

    def _learn(self, pieces: list[list[str]]) -> None:
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*pieces)
        plain = [w for w in new if self.joins and w[0] == MARK and w[1:2] not in ("", MARK)]  # of one mark and what follows it
        other = list(new.difference(plain))
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        made = self.marked.encode_batch_fast([*map("".join, groups), *other], add_special_tokens=False)
        for words, e in zip(groups, made):
            ids = np.array(e.ids, dtype="<u4")
            data, at = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids])).tolist()
            for w, a, z in zip(words, at, [*at[1:], len(data)], strict=True):
                self.known[w] = data[a:z]
        for w, e in zip(other, made[len(groups) :], strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self._learn(cut)
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): four little-endian bytes an id."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(codec(path).encode(b.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded rows."""
    limit_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec(path).decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


REPORT = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean, parity boolean"


def report(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of every text, a checksum of its ids, whether decoding them gives the text back, and parity: whether the
    original library gives the same ids."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, theirs = codec(path), original(path)
        for b in steps(batches):
            texts_ = b.column("text").to_pylist()
            ids = c.encode(texts_)
            back = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.compute.binary_length(b.column("text").cast(pa.binary())).cast(pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([a == b_ for a, b_ in zip(back, texts_, strict=True)], pa.bool_()),
                    pa.array([a == x.astype("<u4", copy=False).tobytes() for a, x in zip(ids, theirs.encode(texts_, num_threads=1, return_type="numpy"), strict=True)], pa.bool_()),
                ],
                names=[x.split()[0] for x in REPORT.split(", ")],
            )

    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, REPORT)


def original(path: str):  # noqa: ANN201
    """The original library's model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def parity(texts_: list[str], path: str) -> list[int]:
    """Indices of the texts that the original library encodes or decodes otherwise."""
    theirs = original(path)
    ours = codec(path).encode(texts_)
    want = theirs.encode(texts_, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(ours, want, strict=True)) if np.frombuffer(a, dtype="<u4").tolist() != b or codec(path).decode(a) != theirs.decode(b)]
