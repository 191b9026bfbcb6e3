"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared after Unicode case folding, with one space for each run of ASCII white space. An item of m
characters may be changed by e = m * RATE // 100 edits; it is split into e + 1 pieces, one of which must stay whole. An
automaton of all pieces runs over each whole text; around every hit the Myers bit-parallel search finds the least edit distance of
the item to a passage there, and counts the item as found at e or less.

The items are the stated query set: they are shipped to the tasks in blocks of at most BLOCK_CHARS characters, each of
which is one pass over the texts. Items too short for an edit (under 17 characters at RATE) are found where they stand exactly
and begin and end no word halfway; `short=False` leaves out items under `least` characters. An item found at several
places of a text is one row with its least distance; very long texts and items are searched whole. Empty and null items are ignored. Null texts hold nothing;
repeated rows are reported each; null ids are kept; other columns do not matter; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

RATE = 6  #: edits per 100 characters
LEAST = 30
BLOCK_CHARS = 4_000_000


def normal(text: str | bytes | None) -> str:
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return b" ".join(raw.split()).decode("utf-8", "replace").casefold()


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.combining(c) > 0


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends no word halfway."""
    return not (start and in_word(text[start - 1]) and in_word(text[start]) or end < len(text) and in_word(text[end - 1]) and in_word(text[end]))


class Item:
    """An item's pieces and the bit masks of its characters."""

    def __init__(self, item_id: int, text: str, rate: int = RATE):
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.budget = self.size * rate // 100
        n = self.budget + 1
        cuts = [k * self.size // n for k in range(n + 1)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def distance(self, window: str) -> int:
        """The least edit distance of the item to a passage of the window."""
        every, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score, best = every, 0, self.size, self.size
        get = self.masks.get
        for c in window:
            eq = get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus) & every
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & every
            plus = (down << 1 | ~(vertical | up)) & every
            minus = up & vertical
        return best


class Matcher:
    """Items that are allowed no edit are matched at the bounds of words."""

    def __init__(self, items: list[tuple[int, str]], rate: int = RATE):
        self.items = [Item(i, t, rate) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for at, piece in item.pieces:
                places.setdefault(piece, []).append((k, at))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of the items in a normal text."""
        if not self.items or not text:
            return []
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.pieces.iter(text):
            for k, at in where:
                item, start = self.items[k], end + 1 - size - at
                if best.get(k) == 0 or (k, start) in tried:
                    continue
                if not item.budget:
                    if whole_words(text, start, end + 1):
                        best[k] = 0
                    continue
                tried.add((k, start))
                if text.startswith(item.text, max(start, 0)):
                    best[k] = 0
                    continue
                found = item.distance(text[max(0, start - item.budget) : start + item.size + item.budget])
                if found <= item.budget:
                    best[k] = min(found, best.get(k, found))
        return [(self.items[k].item_id, d) for k, d in best.items()]


def blocks_of(items: DataFrame, least: int, short: bool, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; every block is read on its own."""
    texts = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toLocalIterator()
        yield sorted({(r["id"], t) for r in rows if len(t := normal(r["text"])) >= (1 if short else least)})


_MATCHERS: dict[int, tuple[list, Matcher]] = {}


def matcher(shared, rate: int) -> Matcher:
    """The worker's matcher of a broadcast block."""
    if id(shared.value) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[id(shared.value)] = shared.value, Matcher(shared.value, rate)
    return _MATCHERS[id(shared.value)][1]


def contaminated(docs: DataFrame, items: DataFrame, *, rate: int = RATE, least: int = LEAST, short: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id and edit distance of every item found in a document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"id {kind}, item_id long, distance int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for block in blocks_of(items, least, short, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = matcher(shared, rate)
            for batch in batches:
                found = [(k, *hit) for k, t in enumerate(texts_of(batch.column(1))) for hit in own.find(normal(t))]
                at = pa.array([k for k, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([i for _, i, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int32())], names=["id", "item_id", "distance"])

        out = out.unionByName(rows.mapInArrow(search, out.schema))
    return out.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, items: DataFrame, *, rate: int = RATE, least: int = LEAST, short: bool = True, text_col: str = "text") -> DataFrame:
    """The documents without any item, with all their columns; texts are not shuffled."""
    out = docs
    for block in blocks_of(items, least, short, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = out.select(F.struct(*[out[c] for c in out.columns]).alias("row"))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = matcher(shared, rate)
            for batch in batches:
                good = [not own.find(normal(t)) for t in texts_of(batch.column(0).field(text_col))]
                yield batch.filter(pa.array(good, pa.bool_()))

        out = rows.mapInArrow(keep, rows.schema).select("row.*")
    return out
