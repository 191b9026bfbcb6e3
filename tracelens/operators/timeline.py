"""Timelines of (read, region) entries and rule-based phases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.constants import NOTE_RANGES, PHASE_RULES
from ..functions.expressions import by_trace, micros, ratio
from .regions import overlap
from .slices import cut, running

IMPORT_RANGE = next((least, greatest) for least, greatest, note in NOTE_RANGES if note == "import region probe")
#: phase, required regions, optional regions in order, least entries.
Rule = tuple[str, list[str], list[str], int]


def by_position() -> WindowSpec:
    return by_trace().orderBy("pos")


def timeline(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """trace_id, pos (from 1), region, us (microseconds), read_offset, length; `Unmapped` where no region is touched."""
    entries = overlap(reads, regions, "left").withColumns({"_rank": F.coalesce("region_rank", F.lit(0)), "us": micros()})
    placed = running(cut(entries, ["trace_id"], F.col("us")), ["trace_id"], ["ts", "event_order", "_rank"], pos=("count", F.lit(1)))
    return placed.select("trace_id", (F.col("pos") + 1).cast("int").alias("pos"), F.coalesce("region_name", F.lit("Unmapped")).alias("region"), "us", "read_offset", "length")


def timeline_summary(entries: DataFrame, first: int = 10, k: int = 3) -> DataFrame:
    seen = entries.groupBy("trace_id", "region").agg(F.min("pos").alias("pos"), F.count("*").alias("visits"))
    lists = seen.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", "region"))).alias("in_order"), F.array_sort(F.collect_list(F.struct((-F.col("visits")).alias("neg"), "pos", "region"))).alias("by_visits"))
    names = lambda array: F.array_join(F.transform(array, lambda x: x["region"]), " > ")
    bounds = entries.groupBy("trace_id").agg((F.max("us") - F.min("us")).alias("duration_us"), F.min_by("region", "pos").alias("first_region"), F.max_by("region", "pos").alias("last_region"), F.count("*").alias("entries"))
    return bounds.join(lists, "trace_id").select("trace_id", "entries", "duration_us", "first_region", "last_region", F.size("in_order").alias("regions"), names(F.col("in_order")).alias("regions_in_order"), names(F.slice("in_order", 1, first)).alias("first_ten"), names(F.slice("by_visits", 1, k)).alias("most_visited"))


def region_runs(entries: DataFrame) -> DataFrame:
    new = F.when(F.lag("region").over(by_position()) == F.col("region"), 0).otherwise(1)
    runs = entries.withColumn("new", new).withColumn("run", F.sum("new").over(by_position().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("trace_id", "run").agg(F.first("region").alias("region"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), (F.max("us") - F.min("us")).alias("duration_us"), F.count("*").alias("entries"))


RULE = "rule_ord INT, phase STRING, required ARRAY<STRING>, optional ARRAY<STRING>, minimum_reads INT"
Rules = list[Rule] | DataFrame


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table (rule_ord, phase, required, optional, minimum_reads), as it may also be read from a file."""
    return spark.createDataFrame([(k, *rule) for k, rule in enumerate(rules)], RULE)


def ordered_rules(entries: DataFrame, rules: Rules) -> DataFrame:
    """One row with all rules in order: rule (their 0-based number), phase, relevant, required, optional, least."""
    table = rules if isinstance(rules, DataFrame) else rule_table(entries.sparkSession, rules)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    row = F.struct("rule_ord", "phase", listed("required"), listed("optional"), F.coalesce("minimum_reads", F.lit(1)).alias("least"))
    all_ = table.agg(F.array_sort(F.collect_list(row)).alias("r"))
    made = lambda x, i: F.struct(i.alias("rule"), x["phase"].alias("phase"), F.array_distinct(F.concat(x["required"], x["optional"])).alias("relevant"), x["required"].alias("required"), x["optional"].alias("optional"), x["least"].alias("least"))
    return all_.select(F.transform("r", made).alias("rules"))


def moment_sets(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """trace_id and `sets`: for each set of regions that some rule names and that share a moment, the moments and what each region has there.

    All moments of one set are claimed together, so that rules need not know single moments: what a trace keeps grows with its
    distinct sets of regions, not with its reads.
    """
    named = rules.select(F.explode("rules").alias("r")).select(F.explode("r.relevant").alias("_named")).distinct()
    own = entries.join(F.broadcast(named), F.col("region") == F.col("_named"), "left_semi")
    at = own.groupBy("trace_id", "us", "region").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    moments = at.groupBy("trace_id", "us").agg(F.array_sort(F.collect_list(F.struct("region", "n", "pos"))).alias("own")).withColumn("names", F.col("own.region"))
    each = moments.select("trace_id", "us", "names", F.explode("own").alias("o")).groupBy("trace_id", "names", "o.region")
    facts = each.agg(F.count("*").alias("moments"), F.sum("o.n").alias("n"), F.min("o.pos").alias("pos"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    sets = facts.groupBy("trace_id", "names").agg(F.max("moments").alias("moments"), F.array_sort(F.collect_list(F.struct("region", "n", "pos", "start_us", "end_us"))).alias("own"))
    return sets.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("names", "moments", "own"))).alias("sets"))


def _after_rule(claimed: Column, rule: Column) -> Column:
    """The rule that has each set, after one more rule; -1 where none has."""
    free = F.transform("sets", lambda s, i: (F.get(claimed, i) == -1) & F.arrays_overlap(s["names"], rule["relevant"]))

    def judged(own: Column) -> Column:
        entries = F.flatten(F.transform(F.filter("sets", lambda s, i: F.get(own, i)), lambda s: F.filter(s["own"], lambda x: F.array_contains(rule["relevant"], x["region"]))))
        return once(entries, lambda e: F.when(fits(e), F.transform(claimed, lambda c, i: F.when(F.get(own, i), rule["rule"]).otherwise(c))).otherwise(claimed))

    def fits(entries: Column) -> Column:
        enough = F.aggregate(entries, F.lit(0).cast("long"), lambda t, x: t + x["n"]) >= F.greatest(rule["least"], F.lit(1))
        every = F.size(F.array_except(rule["required"], entries["region"])) == 0
        first = F.transform(rule["optional"], lambda r: F.array_min(F.transform(F.filter(entries, lambda x: x["region"] == r), lambda x: x["pos"])))
        return enough & every & once(F.filter(first, lambda p: p.isNotNull()), lambda seen: F.forall(F.transform(seen, lambda p, i: (i == 0) | (p > F.get(seen, i - 1))), lambda rises: rises))

    return once(free, judged)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, whatever body's lambdas do with it."""
    return F.transform(F.array(value), body)[0]


def claim(entries: DataFrame, rules: Rules = PHASE_RULES) -> DataFrame:
    """trace_id, names, moments, own and `rule` (its number, phase, relevant regions; null for none) of each set of regions.

    Rules go in order. A rule collects the entries of its regions whose moment no earlier phase claimed; it matches with
    enough entries, every required region, and the optional ones present first seen in the rule's order. One fold over the
    rules serves each trace, so that the plan does not grow with them.
    """
    table = ordered_rules(entries, rules)
    joined = moment_sets(entries, table).crossJoin(F.broadcast(table))  # one row of rules
    none = F.transform("sets", lambda s: F.lit(-1))
    folded = joined.withColumn("claimed", F.aggregate("rules", none, _after_rule))
    each = folded.select("trace_id", "rules", F.posexplode("sets").alias("k", "s"), "claimed")
    return each.select("trace_id", "s.names", "s.moments", "s.own", F.get("rules", F.get("claimed", F.col("k"))).alias("rule"))


def detect_phases(entries: DataFrame, rules: Rules = PHASE_RULES) -> DataFrame:
    """trace_id, phase_ord (by start), phase, start_us, end_us, duration_us, entry_count."""
    own = claim(entries, rules).where("rule IS NOT NULL").select("trace_id", "rule", F.explode("own").alias("o")).where(F.array_contains("rule.relevant", F.col("o.region")))
    phases = own.groupBy("trace_id", "rule.rule", "rule.phase").agg(F.min("o.start_us").alias("start_us"), F.max("o.end_us").alias("end_us"), F.sum("o.n").alias("entry_count"))
    return phases.select("trace_id", F.row_number().over(by_trace().orderBy("start_us", "rule")).alias("phase_ord"), "phase", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "entry_count")


def phase_confidence(entries: DataFrame, rules: Rules = PHASE_RULES) -> DataFrame:
    all_ = entries.select("trace_id", "us").distinct().groupBy(F.col("trace_id").alias("_trace")).agg(F.count("*").alias("moments"))
    found = claim(entries, rules).where("rule IS NOT NULL").groupBy("trace_id").agg(F.sum("moments").alias("claimed"), F.size(F.collect_set("rule.rule")).alias("phases"))
    rule_count = ordered_rules(entries, rules).select(F.size("rules").alias("_rules"))
    joined = all_.join(found, F.col("_trace").eqNullSafe(F.col("trace_id")), "left").crossJoin(F.broadcast(rule_count))
    totals = joined.select(F.col("_trace").alias("trace_id"), F.coalesce("phases", F.lit(0)).alias("phases"), F.coalesce("claimed", F.lit(0)).alias("claimed_moments"), "moments", "_rules")
    score = 0.4 * F.col("phases") / F.col("_rules") + 0.4 * ratio(F.col("claimed_moments"), F.col("moments")) + 0.2 / (1 + F.col("phases"))
    return totals.select("trace_id", "phases", "claimed_moments", "moments", F.when(F.col("phases") == 0, 0.0).otherwise(score).alias("confidence"))


def rule_matches(entries: DataFrame, rules: Rules = PHASE_RULES) -> DataFrame:
    """Every trace with every rule, matched or not."""
    table = ordered_rules(entries, rules).select(F.explode("rules").alias("r"))
    slots = entries.select("trace_id").distinct().crossJoin(F.broadcast(table)).select("trace_id", F.col("r.rule").alias("rule_ord"), "r.phase")
    found = detect_phases(entries, rules).select("trace_id", "phase", F.lit(True).alias("hit"))
    return slots.join(found, ["trace_id", "phase"], "left").select("trace_id", "rule_ord", "phase", F.coalesce("hit", F.lit(False)).alias("matched"))


def phase_summary(entries: DataFrame, rules: Rules = PHASE_RULES) -> DataFrame:
    names = detect_phases(entries, rules).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("phase_ord", "phase"))).alias("p"))
    joined = phase_confidence(entries, rules).join(names, "trace_id", "left")
    listed = F.array_join(F.transform("p", lambda x: x["phase"]), ", ")
    text = F.concat(F.lit("Detected "), F.col("phases").cast("string"), F.lit(" phase(s): "), listed, F.lit("; confidence "), F.round(100 * F.col("confidence")).cast("int").cast("string"), F.lit("%"))
    return joined.select("trace_id", F.when(F.col("phases") == 0, "No phases detected.").otherwise(text).alias("summary"))


def phase_counts(entries: DataFrame, rules: Rules = PHASE_RULES) -> DataFrame:
    return detect_phases(entries, rules).groupBy("phase").agg(F.count("*").alias("traces"))


def candidate_rules(reads: DataFrame, imports: tuple[int, int] = IMPORT_RANGE) -> DataFrame:
    """Hits and share of five per-read predicates; imports: least and greatest offset of the import range."""
    order = by_trace().orderBy("ts", "event_order")
    rows = reads.select("*", F.lag("length").over(order).alias("previous"))
    pair = F.col("length").isin(262144, 258048) & F.col("previous").isin(262144, 258048) & (F.col("length") != F.col("previous"))
    tests = {"offset zero": F.col("read_offset") == 0, "tail read": F.col("read_offset") + F.col("length") >= F.col("file_size"), "import range": F.col("read_offset").between(*imports), "bulk 512K": F.col("length") == 524288, "alternation": F.coalesce(pair, F.lit(False))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("predicate"), t.cast("int").alias("hit")) for k, t in tests.items()])).alias("t")
    return rows.select("trace_id", each).groupBy("trace_id", "t.predicate").agg(F.sum("t.hit").alias("hits"), F.count("*").alias("reads")).select("trace_id", "predicate", "hits", ratio(F.col("hits"), F.col("reads")).alias("share"))
