"""Token ids of a word-end BPE vocabulary by its library, with each distinct word merged once a worker.

The fast way holds for texts of ASCII and Latin letters and for vocabularies whose normaliser (NFC, white space to one
space, lower case) and splitter (contractions, runs of letters, single digits, runs of other signs) are the usual ones;
any other text or file goes through the library as a whole. Special strings in a text follow the library's default.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import islice

from vanefold.llm.common import remembered
from vanefold.llm.token_counts import NOT_LATIN, byte_alphabet

#: Bytes, about, of the words that a worker remembers; beyond, the older half is forgotten.
REMEMBERED = 96 << 20
#: The splitter that the fast way knows, and the same cuts for Latin texts.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_SPLITTER = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Remembered(dict):
    """Ids by word, made once; the words that came first are forgotten when there are too many."""

    def __init__(self, make: Callable[[str], bytes], limit: int = REMEMBERED) -> None:
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, word: str) -> bytes:
        if self.size > self.limit:
            for old in list(islice(self, (len(self) + 1) // 2)):
                del self[old]
            self.size //= 2
        made = self[word] = self.make(word)
        self.size += 2 * len(word) + len(made) + 150  # with what Python keeps for each entry
        return made


class WordIds:
    """Ids of texts as little-endian bytes, `width` bytes an id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        added = told.get("added_tokens", [])
        parts = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = (
            parts == ["NFC", "Replace", "Lowercase"]
            and len(cuts) == 2
            and cuts[0].get("pattern") == {"Regex": SPLITTER}
            and cuts[0].get("behavior") == "Removed"
            and cuts[1].get("type") == "ByteLevel"
            and not cuts[1].get("use_regex")
        )
        self.special = {t["content"] for t in added}
        self.model = self.library.model
        self.table = {b: c for c, b in byte_alphabet().items()}
        self.known = Remembered(self._merged)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _merged(self, word: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table))])

    def ids(self, texts: list[str]) -> list[bytes]:
        slow = [i for i, t in enumerate(texts) if not self.fast or NOT_LATIN.search(t) or any(s in t for s in self.special)]
        held = set(slow)
        get = self.known.__getitem__
        out = [b"" if i in held else b"".join(map(get, LATIN_SPLITTER.findall(t.lower()))) for i, t in enumerate(texts)]
        for i, e in zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = self._pack(e.ids)
        return out


_held: dict[str, WordIds] = remembered({})


def word_ids(path: str) -> WordIds:
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]
