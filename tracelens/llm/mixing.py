"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power alpha, normalised. Bisection finds the largest alpha up to 1
whose weights have the wanted entropy (a fraction of that of equal weights); where a source would then be repeated more
than `repeats` times, a second bisection raises alpha just as far as the limit asks. Each job
is one aggregate over the per-source totals, for all exponents that the next steps may meet.

A source's quota is its weight times the budget: so many whole passes over its documents and part of one more. The part
is the start of a permutation of the source's blocks (documents hashed to BLOCKS), cut inside one block by the order of
the documents' hashes. So a source is described by its passes and one cut, which every document is held against; no task
ever orders a whole source, and texts are not shuffled.

Tokens are words. A null source is a source of its own; null texts have no tokens; a source without tokens keeps each
document once; rows with equal ids and token counts are taken together; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

BLOCKS, STEPS, AT_ONCE = 1024, 24, 6  #: blocks of a source; steps of bisection, and how many of them a job serves


def words_in(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def weigh(totals: DataFrame, alpha: float) -> DataFrame:
    """`totals` (source, tokens) with weight at this exponent."""
    raw = totals.where("tokens > 0").select("*", F.pow(F.col("tokens").cast("double"), F.lit(alpha)).alias("raw"))
    return raw.join(raw.agg(F.sum("raw").alias("all_raw")).withColumn("one", F.lit(1)), F.col("one") == 1).select("source", "tokens", (F.col("raw") / F.col("all_raw")).alias("weight"))


def spreads(totals: DataFrame, alphas: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights and the largest weight per token, in one job."""
    power = F.pow(F.col("tokens").cast("double"), F.col("alpha"))
    each = totals.where("tokens > 0").select("tokens", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    rows = each.groupBy("alpha").agg(F.sum(power).alias("a"), F.sum(power * F.log("tokens") * F.col("alpha")).alias("b"), F.max(power / F.col("tokens")).alias("c"))
    return {r["alpha"]: (math.log(r["a"]) - r["b"] / r["a"], r["c"] / r["a"]) for r in rows.collect()}


def bisect(totals: DataFrame, holds, low: float, high: float, sign: float = 1.0) -> float:
    """`high` holds, `low` does not; the least found that holds, of exponents times `sign`.

    A job evaluates all midpoints that AT_ONCE steps may meet; what it returns is as many rows.
    """
    for _ in range(STEPS // AT_ONCE):
        grid, ends = [], [(low, high)]
        for _ in range(AT_ONCE):
            middles = [(a + b) / 2 for a, b in ends]
            grid += middles
            ends = [x for (a, b), m in zip(ends, middles) for x in ((a, m), (m, b))]
        found = spreads(totals, [sign * x for x in dict.fromkeys(grid)])
        for _ in range(AT_ONCE):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(*found[sign * middle]) else (middle, high)
    return high


def exponent(totals: DataFrame, budget: int, *, entropy: float, repeats: float) -> float:
    """alpha for the wanted share of the greatest entropy, as far as the repetition limit lets it."""
    ends = spreads(totals, [0.0, 1.0])
    goal = entropy * ends[0.0][0]
    alpha = 1.0 if ends[1.0][0] >= goal else -bisect(totals, lambda e, _: e >= goal, -1.0, 0.0, -1.0)
    limit = max(repeats, budget * ends[1.0][1])
    fits = lambda _, most: budget * most <= limit * (1 + 1e-12)
    return alpha if fits(*spreads(totals, [alpha])[alpha]) else bisect(totals, fits, alpha, 1.0)


def _order(seed: int) -> tuple[Column, Column]:
    """A row's block and its hash in the permutation of the source; `key` and `h` are set."""
    block = F.pmod("h", F.lit(BLOCKS))
    return block, F.xxhash64(F.lit(seed), F.col("source"), block)


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    return [source.alias("source"), words_in(text_col).alias("tokens"), F.xxhash64(F.lit(seed), F.col(id_col), words_in(text_col)).alias("h")]


def plan(docs: DataFrame, *, entropy: float = 0.9, repeats: float = 2.0, budget: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, weight, quota, passes, and the cut (at_block, at_row) of the partial pass."""
    block, place = _order(seed)
    rows = stored(docs.select(*_rows(docs, seed, id_col, text_col, source_col)).select("source", "tokens", "h", block.alias("block"), place.alias("place")), "mix-rows")
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    empty = totals.where("tokens = 0").select("source", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("part"))
    if total == 0:
        quotas = empty
    else:
        budget = total if budget is None else budget
        weights = weigh(totals, exponent(totals, budget, entropy=entropy, repeats=repeats))
        quota = F.round(F.col("weight") * budget).cast("long")
        quotas = weights.select("source", "weight", quota.alias("quota"), F.floor(quota / F.col("tokens")).alias("passes"), F.pmod(quota, F.col("tokens")).alias("part")).unionByName(empty)
    quotas = stored(quotas, "mix-quotas")
    upto = Window.partitionBy("source").orderBy("place", "block")
    blocks = rows.groupBy("source", "block", "place").agg(F.sum("tokens").alias("tokens")).select("*", F.sum("tokens").over(upto).alias("upto"))
    edge = blocks.join(quotas.select("source", "part"), "source").where("part > 0 AND upto > part AND upto - tokens <= part").groupBy("source").agg(F.min(F.struct("place", "block", (F.col("part") - F.col("upto") + F.col("tokens")).alias("room"))).alias("edge"))
    edges = stored(edge.select("source", "edge.*"), "mix-edges")
    inside = rows.join(edges, ["source", "block", "place"]).groupBy("source", "h", "room").agg(F.sum("tokens").alias("tokens"))
    fill = inside.select("*", F.sum("tokens").over(Window.partitionBy("source").orderBy("h")).alias("upto")).where("upto <= room")
    cuts = edges.select("source", "place").join(fill.groupBy("source").agg(F.max("h").alias("at_row")), "source", "left")
    return quotas.join(cuts, "source", "left").select("source", "weight", "quota", "passes", F.col("place").alias("at_place"), "at_row")


def realised(docs: DataFrame, mix: DataFrame, *, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (all columns of `docs`), mix_source, tokens, weight and pass (from 0) for every copy of a document."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_rows(docs, seed, id_col, text_col, source_col))
    block, place = _order(seed)
    own = keyed.select("*", place.alias("place"))
    joined = own.join(mix, "source")
    more = (F.col("place") < F.col("at_place")) | ((F.col("place") == F.col("at_place")) & (F.col("h") <= F.col("at_row")))
    copies = (F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")).cast("int")
    return joined.select("*", copies.alias("copies")).where("copies > 0").select("row", F.col("source").alias("mix_source"), "tokens", "weight", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture with the columns of `docs`."""
    mix = stored(plan(docs, **parameters), "mix")
    names = {k: v for k, v in parameters.items() if k in ("seed", "id_col", "text_col", "source_col")}
    return realised(docs, mix, **names).select("row.*")


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """id, source, n_tokens, weight of the source and pass of every copy in the mixture."""
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mix = stored(plan(lean, id_col="id", **parameters), "mix")
    names = {k: v for k, v in parameters.items() if k == "seed"}
    made = realised(lean.select("id", "text", "source"), mix, id_col="id", **names)
    return made.select(F.col("row.id").alias(id_col), F.col("row.source").alias(source_col), F.col("tokens").alias("n_tokens"), "weight", "pass")
