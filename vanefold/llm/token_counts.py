"""Token counts of byte-level BPE vocabularies, with a shortcut for pre-tokens that are whole tokens.

A text is cut into pre-tokens by the vocabulary's own pattern. Before any text is read, every vocabulary string that is
valid UTF-8 is encoded alone by the library; those that come back as the one id they stand for are proven whole. Such
pre-tokens count as one. Only the others go through the library's merges, each distinct one once while it is remembered.

Null and empty texts have 0 tokens. Strings of special tokens inside a text follow the library's default: each is one
token and parts the text. Texts of any length are counted whole. Repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanefold.llm.common import limit_batches, steps

#: Distinct pre-tokens whose count a worker remembers; past that it starts anew.
REMEMBERED = 1_000_000
#: The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same cuts for texts of ASCII and Latin letters alone, where letters are what is a word character but no digit.
LATIN_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\t\n\x20-\x7e\xc0-\u024f]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class TokenCounter:
    """Counts of one vocabulary file; `whole` holds the pre-tokens proven to be one token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        pre = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        added = told.get("added_tokens", [])
        self.shortcut = bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.model, self.table = self.library.model, {b: c for c, b in byte_alphabet().items()}
        self.whole = self._proven() if self.shortcut else {}
        self.known = dict(self.whole)

    def _proven(self) -> dict[str, int]:
        alphabet = byte_alphabet()
        strings, ids = [], []
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            try:
                strings.append(bytes(alphabet[c] for c in token).decode())
                ids.append(i)
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character, never a pre-token by itself
        alone = self.library.encode_batch(strings, add_special_tokens=False)
        return {s: 1 for s, i, e in zip(strings, ids, alone, strict=True) if e.ids == [i]}

    def cut(self, text: str) -> list[str]:
        return (self.pattern if NOT_LATIN.search(text) else LATIN_PRE_TOKEN).findall(text)

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(self.whole)
            new = [p for p in pieces if p not in self.known]
        for p in new:
            self.known[p] = len(self.model.tokenize(p.encode().decode("latin-1").translate(self.table)))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.shortcut:
            return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut, out = [], []
        for t in texts:
            if self.special is not None and self.special.search(t):
                parts = self.special.split(t)
                cut.append([p for part in parts for p in self.cut(part)])
                out.append(len(parts) - 1)
            else:
                cut.append(self.cut(t))
                out.append(0)
        self._learn(set().union(*map(set, cut)))
        get = self.known.__getitem__
        return [n + sum(map(get, pieces)) for n, pieces in zip(out, cut, strict=True)]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter a worker process and file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of docs but the text, with n_bytes, `out` and over_limit; one narrow pass, nothing is shuffled."""
    limit_batches(docs.sparkSession)
    taken = {text, "n_bytes", out, "over_limit"}
    kept = [c for c in docs.columns if c not in taken]
    clean = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in steps(batches, text):
            n = count.counts(b.column(text).to_pylist())
            size = pa.compute.binary_length(b.column(text).cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), size, pa.array(n, pa.int64())], names=[*kept, "n_bytes", out])

    from pyspark.sql import types as T

    schema = T.StructType([*(clean.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField(out, T.LongType())])
    return clean.mapInArrow(run, schema).withColumn("over_limit", F.col(out) > limit)
