"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Features are integers. A sketch counts them in buckets of relative width 1/16 (exact below 32); counts add up, so tasks,
sources and languages merge by summing. A group's own sketch is merged with its language's, which weighs as PRIOR
documents, and that one with the sketch of all documents, which weighs as PRIOR documents of the language: small groups
lean on what is known, large ones on themselves, without a size at which the rule changes. From the merged sketch comes
the fence of each feature: the third quartile plus REACH times the interquartile range and the width of the quartile's
bucket, below which a sketch does not see (word length also from below). No fence is a constant. Repeats and duplicate
lines are sketched over the documents that have any, for most have none and some are as usual. Documents that fail the
base rules are left out of the sketches.

Null text has no words and fails the base rules; null language or source forms a group of its own; repeated rows
count each; ids may be null or repeat; an empty table gives no rows. filter_documents() returns the rows it keeps
with all their columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts_of

#: feature -> (sketched over documents that have any, fence from below too). Shares are in thousandths, word length in hundredths.
FEATURES = {"symbols": (False, False), "repeats": (True, False), "dup_lines": (True, False), "word_length": (False, True), "capitals": (False, False)}
REACH = 8
PRIOR = 50  #: documents as which a group's language counts in its sketch
NUMBERS = 250_000  #: distinct words after which a worker's numbering starts anew, which bounds its memory

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def repeated_words(words: list[bytes], numbers: dict[bytes, int]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) >= 1 << 21:  # a very long text: three numbers no longer fit a word
        ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1].astype(np.int64)
        windows = pairs[:-1] << 32 | ids[2:]
    else:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    if not len(equal):
        return 0
    inside = np.zeros(n, bool)
    for at in (order[equal], order[equal + 1]):
        inside[at] = inside[at + 1] = inside[at + 2] = True
    return int(inside.sum())


def counts_of(text: bytes, numbers: dict[bytes, int]) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.split()
    if len(numbers) > NUMBERS:
        numbers.clear()
    raw = np.frombuffer(text, np.uint8)
    solid = raw[~_SPACE[raw]]
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(((solid & 0xC0) != 0x80).sum()), int(_SYMBOL[solid].sum()), len(lines) - len(set(lines)), repeated_words(words, numbers), len(lines), int(_CAPITAL[solid].sum()))


def with_counts(rows: DataFrame, text: str, inside: str | None = None) -> DataFrame:
    """`rows` plus the COUNTS of the column `text`, which is left out, or of the field `inside` of the struct `text`, which stays."""
    keep = [c for c in rows.columns if inside or c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column(text).field(inside) if inside else batch.column(text)
            found = np.array([counts_of(t or b"", numbers) for t in texts_of(texts)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(found[:, k]) for k in range(len(COUNTS))], names=keep + COUNTS)

    schema = rows.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return rows.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    share = lambda part, whole, unit: F.expr(f"{part} * {unit} div greatest({whole}, 1)")
    made = [share("n_symbols", "word_chars", 1000), share("n_repeat_words", "n_words", 1000), share("n_dup_lines", "n_lines", 1000), share("word_chars", "n_words", 100), share("n_capitals", "word_chars", 1000)]
    return [c.alias(name) for c, name in zip(made, FEATURES)]


def bucket(value: str) -> Column:
    """The least value of the bucket: the five leading bits stay."""
    return F.expr(f"CASE WHEN {value} < 32 THEN {value} ELSE shiftleft(shiftright({value}, length(bin({value})) - 5), length(bin({value})) - 5) END")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n of the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(name).alias("value"), F.lit(some).alias("some")) for k, (name, (some, _)) in enumerate(FEATURES.items())])).alias("f")
    values = rows.where(~base_failed()).select("lang", "source", *features()).select("lang", "source", each).where("f.value > 0 OR NOT f.some")
    return values.select("lang", "source", "f.feature", bucket("f.value").alias("bucket")).groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, feature, bucket and weight (whole numbers) of each group's sketch with those that it leans on."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    by_lang, all_ = (sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n")) for keys in (["lang"], []))
    in_lang, in_all = by_lang.groupBy("lang", "feature").agg(F.sum("n").alias("lang_n")), all_.groupBy("feature").agg(F.sum("n").alias("all_n"))
    groups = sketch.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, range(len(FEATURES))))).alias("feature"))
    own = sketch.join(in_lang, ["lang", "feature"]).join(in_all, "feature").select("lang", "source", "feature", "bucket", (big("n") * (big("lang_n") + prior) * big("all_n")).cast("decimal(38,0)").alias("w"))
    near = groups.join(by_lang, ["lang", "feature"]).join(in_all, "feature").select("lang", "source", "feature", "bucket", (big("n") * prior * big("all_n")).cast("decimal(38,0)").alias("w"))
    far = groups.join(all_, "feature").select("lang", "source", "feature", "bucket", (big("n") * (prior * prior)).cast("decimal(38,0)").alias("w"))
    return own.unionByName(near).unionByName(far).groupBy("lang", "source", "feature", "bucket").agg(F.sum("w").cast("decimal(38,0)").alias("weight"))


def width(value: str) -> Column:
    """The width of the bucket that begins at the value."""
    return F.expr(f"CASE WHEN {value} < 32 THEN 1 ELSE shiftleft(1L, length(bin({value})) - 5) END")


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and for each feature its upper and lower fence; null where no document has the feature."""
    group = Window.partitionBy("lang", "source", "feature")
    ranked = merged(sketch, prior).select("*", F.sum("weight").over(group.orderBy("bucket")).alias("upto"), F.sum("weight").over(group).alias("total"))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    bounds = ranked.groupBy("lang", "source", "feature").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = bounds.select("*", (REACH * (F.col("q3") - F.col("q1") + width("q3"))).alias("reach"))
    wide = []
    for k, (name, (_, below)) in enumerate(FEATURES.items()):
        own = F.col("feature") == k
        wide.append(F.max(F.when(own, F.col("q3") + F.col("reach"))).alias(f"{name}_max"))
        if below:
            wide.append(F.max(F.when(own, F.col("q1") - F.col("reach"))).alias(f"{name}_min"))
    return reach.groupBy("lang", "source").agg(*wide)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` (lang, source, COUNTS) with base_failed and kept."""
    holds = lambda c: F.coalesce(c, F.lit(True))
    inside = F.lit(True)
    for name, (_, below) in FEATURES.items():
        inside = inside & holds(F.col(name) <= F.col(f"{name}_max"))
        if below:
            inside = inside & holds(F.col(name) >= F.col(f"{name}_min"))
    joined = rows.select("*", *features()).join(limits, ["lang", "source"], "left")
    return joined.select("*", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def _keys(lang: str, source: str) -> list[Column]:
    """Group keys in which null is a value of its own."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return [key(lang).alias("lang"), key(source).alias("source")]


def quality_report(docs: DataFrame, *, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, features and verdict of every document."""
    rows = docs.select(F.col(id_col).alias("id"), *_keys(lang_col, source_col), F.col(text_col).alias("text"))
    counted = stored(with_counts(rows, "text"), "quality")
    out = judged(counted, fences(sketches(counted), prior))
    return out.select(F.col("id").alias(id_col), *COUNTS[:5], "base_failed", "kept", *FEATURES)


def filter_documents(docs: DataFrame, *, prior: int = PRIOR, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept: one pass over the texts for the sketches, one for the verdicts.

    Counting again costs less than storing or shuffling the texts, and holds where ids are null or repeat.
    """
    keys = _keys(lang_col, source_col)
    limits = stored(fences(sketches(with_counts(docs.select(*keys, F.col(text_col).alias("text")), "text")), prior), "fences")
    rows = with_counts(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keys), "row", text_col)
    return judged(rows, limits).where("kept").select("row.*")
