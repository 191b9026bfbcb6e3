"""Tokenizer access inside tasks: pre-tokens, and memo tables of their ids over the tokenizers library.

The vocabulary drops white space, folds case and splits a text into pre-tokens: contractions, runs of letters, single
numerals and runs of anything else; each is merged on its own. Texts of characters below ODD_FROM, which no normal form
changes and whose case folds one to one, are split here by the same pattern. In other texts every chunk (a run without
ASCII white space) with an odd character goes through the library whole. Only the strings of added special tokens are
matched on the raw text before that; texts that hold one go through the library whole.

Vocabulary strings that encode alone as one token are proven once, on the driver, and shipped to the tasks; what else a
batch of texts needs is merged by the library in one call and remembered.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Entries after which a memo turns its generation, and bytes beyond which a key is not remembered: both bound a worker's memory.
MEMO_ENTRIES, MEMO_BYTES = 100_000, 64
ODD_FROM = 0x180
PIECE = 1 << 20  #: bytes of text that are tokenized together
SUFFIX = "</w>"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(ODD_FROM) if unicodedata.category(chr(c))[0] == kind)


_SPACE = r"\x09-\x0d\x20\x85\xa0"
_LETTER, _NUMERAL = _class("L"), _class("N")
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMERAL}]|[^{_SPACE}{_LETTER}{_NUMERAL}]+")
ODD = re.compile(f"[^\x00-{chr(ODD_FROM - 1)}]|İ")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def ending(path: str) -> np.ndarray:
    """Whether an id is the last one of a pre-token."""
    out = np.zeros(max(load(path).get_vocab().values()) + 1, bool)
    out[[i for w, i in load(path).get_vocab().items() if w.endswith(SUFFIX)]] = True
    return out


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that are proven to encode alone as their one id: the library is asked for each."""
    from tokenizers.decoders import ByteLevel

    tokenizer, spell = load(path), ByteLevel()
    words = [(spell.decode([w[: -len(SUFFIX)]]), i) for w, i in tokenizer.get_vocab().items() if w.endswith(SUFFIX)]
    words = [(w, i) for w, i in words if w == w.lower() and PRE_TOKEN.fullmatch(w) and not ODD.search(w)]
    found = tokenizer.encode_batch([w for w, _ in words], add_special_tokens=False)
    return {w: i for (w, i), e in zip(words, found) if e.ids == [i]}


_PROOFS: dict[tuple[str, str], Broadcast] = {}


def proof(spark: SparkSession, path: str) -> Broadcast:
    """The proven whole tokens, proven once per application; no larger than the vocabulary."""
    key = spark.sparkContext.applicationId, path
    if key not in _PROOFS:
        _PROOFS[key] = spark.sparkContext.broadcast(whole_tokens(path))
    return _PROOFS[key]


def pre_tokens(chunk: bytes) -> list[bytes]:
    """The pre-tokens of a chunk in which A-Z is folded already; one with odd characters stays whole."""
    if chunk.isalpha():  # ASCII letters alone
        return [chunk]
    if chunk[:-1].isalpha() and chunk.isascii() and not chunk.isalnum():
        return [chunk[:-1], chunk[-1:]]
    text = chunk.decode("utf-8", "replace")
    return [chunk] if ODD.search(text) else [x.encode() for x in PRE_TOKEN.findall(text.lower())]


class Generations(dict):
    """A memo of two generations: what is not asked for while one fills up is forgotten with the next."""

    old: dict = {}

    def recalled(self, key: bytes):
        """The value in the generation before, or null; it is remembered anew."""
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()


class Merges(Generations):
    """Pre-token or odd chunk -> its ids as little-endian 32-bit integers; whole tokens are always there."""

    def __init__(self, path: str, whole: dict[str, int] | None = None):
        self.path = path
        self.first = {w.encode(): i.to_bytes(4, "little") for w, i in (whole or whole_tokens(path)).items()}

    def alone(self, text: bytes) -> bytes:
        return np.asarray(load(self.path).encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key: bytes) -> bytes:
        value = self.first.get(key) or self.recalled(key)
        if value is None:
            value = self.alone(key)
            if len(key) <= MEMO_BYTES:
                self[key] = value
        return value

    def learn(self, keys: set[bytes], step: int = 10_000) -> None:
        """Merge the keys that are missing, many in one call: a pre-token ends where an id ends one."""
        new = (k for k in keys - self.keys() - self.first.keys() if self.recalled(k) is None)
        plain = sorted(k for k in new if len(k) <= MEMO_BYTES and (k.isascii() or not ODD.search(k.decode("utf-8", "replace"))))
        for at in range(0, len(plain), step):
            part = plain[at : at + step]
            raw = self.alone(b" ".join(part))
            ends = ((np.flatnonzero(ending(self.path)[np.frombuffer(raw, "<u4")]) + 1) * 4).tolist()
            if len(ends) == len(part):
                self.update((k, raw[x:y]) for k, x, y in zip(part, [0, *ends], ends))


class Memo(Generations):
    """Chunk (without ASCII white space) -> `of(its ids)`."""

    def __init__(self, path: str, of, whole: dict[str, int] | None = None):
        self.merges, self.of = Merges(path, whole), of
        self.special = [s.encode() for s in special_strings(path)]

    def of_texts(self, texts: list[bytes]) -> Iterator[list]:
        """Of each text the values of its chunks in order; folding A-Z first makes fewer kinds of chunks."""
        split = [None if any(s in t for s in self.special) else t.lower().split() for t in texts]
        found = [None if chunks is None else list(map(self.get, chunks)) for chunks in split]
        missing = {c for chunks, values in zip(split, found) if values and None in values for c, v in zip(chunks, values) if v is None}
        new = {c: v for c in missing if (v := self.recalled(c)) is not None}
        parts = {c: pre_tokens(c) for c in missing - new.keys()}
        self.merges.learn({k for keys in parts.values() for k in keys})
        ids = self.merges.__getitem__
        made = {c: self.of(ids(keys[0]) if len(keys) == 1 else b"".join(map(ids, keys))) for c, keys in parts.items()}
        self.update((c, v) for c, v in made.items() if len(c) <= MEMO_BYTES)
        new |= made
        for text, chunks, values in zip(texts, split, found):
            if chunks is None:
                yield [self.of(self.merges.alone(text))]
            elif None in values:
                yield [new[c] if v is None else v for c, v in zip(chunks, values)]
            else:
                yield values

    def trim(self) -> None:
        self.turn()
        self.merges.turn()


def of_column(column: pa.Array, memo: Memo) -> Iterator[tuple[int, list]]:
    """Bytes and values of each text of a column, about PIECE bytes at a time; null is empty."""
    texts: list[str] = []
    sizes: list[int] = []
    total = 0
    for k in range(len(column)):
        raw = column[k].as_py() or b""
        texts.append(raw)
        sizes.append(len(raw))
        total += len(raw)
        if total >= PIECE or k == len(column) - 1:
            yield from zip(sizes, memo.of_texts(texts))
            memo.trim()
            texts, sizes, total = [], [], 0


def count_of(ids: bytes) -> int:
    return len(ids) // 4


def same(ids: bytes) -> bytes:
    return ids


@lru_cache(maxsize=2)
def memo_of(path: str, of) -> Memo:
    """A memo that stays, for single texts; a task makes its own, which goes with it. `of`: count_of or same."""
    return Memo(path, of)
