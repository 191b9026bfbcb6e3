"""Per-trace read statistics. Every function takes `reads` of one layer and keeps trace_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BLOCK, CHUNK_BANDS, DECLINED, READ_OPS
from ..functions.expressions import in_order, by_trace, band, count_where, micros, ratio, top
from .intervals import covered, islands
from .slices import cut, hot_bounds, running


def layer_split(reads: DataFrame) -> DataFrame:
    read = F.col("operation").isin(READ_OPS)
    declined = read & (F.col("result") == DECLINED)
    return reads.groupBy("trace_id").agg(
        count_where(read).alias("read_ops"), count_where(read & (F.col("result") == "SUCCESS")).alias("success_reads"), count_where(declined).alias("declined_reads"),
        F.coalesce(F.sum(F.when(declined, F.col("length"))), F.lit(0)).alias("declined_bytes"),
    )


def length_bands(reads: DataFrame, bands: list[tuple[int, int, str]] = CHUNK_BANDS) -> DataFrame:
    """Reads of each trace in every band, empty bands too."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("band")) for k, (_, _, name) in enumerate(bands)])).alias("b")
    counts = reads.groupBy("trace_id", band("length", bands).alias("band")).agg(F.count("*").alias("n"))
    slots = reads.select("trace_id").distinct().select("trace_id", every).select("trace_id", "b.band", F.col("b.ord").alias("band_ord"))
    return slots.join(counts, ["trace_id", "band"], "left").select("trace_id", "band_ord", "band", F.coalesce("n", F.lit(0)).alias("reads"))


def read_stats(reads: DataFrame) -> DataFrame:
    """Offsets are counted after a partial aggregation by (trace, offset), so that no group gathers rows."""
    by_offset = reads.groupBy("trace_id", "read_offset").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max("file_size").alias("file_size"))
    return by_offset.groupBy("trace_id").agg(
        F.sum("n").alias("total_reads"), F.count("*").alias("unique_offsets"), (F.sum("n") - F.count("*")).alias("repeated_reads"), F.sum("bytes").alias("bytes_read"),
        F.coalesce(ratio(F.sum("bytes"), F.max("file_size")), F.lit(0.0)).alias("read_amplification"),
    )


def read_size_stats(reads: DataFrame) -> DataFrame:
    """min, max, mean, median, population deviation, exclusive quartiles, mode (the least of ties) of the lengths.

    Lengths are counted first; a quartile is read off the cumulative counts, so that no list of lengths is built.
    """
    return length_counts(reads).groupBy("trace_id").agg(*size_measures()).select("*", *mode_columns()).drop("_mode")


def length_counts(reads: DataFrame) -> DataFrame:
    """The distinct lengths of a trace with n reads each, upto of them up to this length, and total."""
    counts = reads.groupBy("trace_id", "length").agg(F.count("*").alias("n"))
    return counts.select("*", F.sum("n").over(by_trace().orderBy("length")).alias("upto"), F.sum("n").over(by_trace()).alias("total"))


def size_measures(counted: str = "n") -> list[Column]:
    """Aggregates over the rows of length_counts(); rows in which these columns are null do not matter."""

    def at(position: Column) -> Column:
        """The length at this 1-based position."""
        return F.min(F.when(F.col("upto") >= position, F.col("length")))

    def quartile(k: int) -> Column:
        lower = F.greatest(F.lit(1), F.least(F.expr(f"{k} * (total + 1) div 4"), F.col("total") - 1))
        part = k * (F.col("total") + 1) - lower * 4
        low, high = at(lower), at(lower + 1)
        return F.when(F.max("total") == 1, F.min("length").cast("double")).otherwise((low * (4 - F.max(part)) + high * F.max(part)) / 4.0)

    middle = (at(F.expr("(total + 1) div 2")) + at(F.expr("(total + 2) div 2"))) / 2.0
    own = F.col(counted)
    n, total, squares = F.sum(own), F.sum(own * F.col("length")), F.sum((own * F.col("length")).cast("double") * F.col("length"))
    return [
        F.min("length").alias("min_read"), F.max("length").alias("max_read"), ratio(total, n).alias("mean_read"), middle.alias("median_read"),
        F.sqrt(F.greatest(squares / n - F.pow(total / n, 2), F.lit(0.0))).alias("std_read"), quartile(1).alias("q1_read"), quartile(3).alias("q3_read"),
        F.max(F.when(own.isNotNull(), F.struct(own.alias("n"), (-F.col("length")).alias("neg")))).alias("_mode"),
    ]


def mode_columns() -> list[Column]:
    return [(-F.col("_mode.neg")).alias("mode_read"), F.col("_mode.n").alias("mode_count")]


def counted_measures(reads: DataFrame) -> DataFrame:
    """read_stats, read_size_stats, alignment, and the coverages and entropy of a trace's offsets, one row a trace.

    Reads are counted by offset and by length in one exchange; what follows works on the counts. A trace's file_size is
    taken to be one value. Where a trace is hot, its counts are cut into slices.
    """
    sets = reads.groupingSets([["trace_id", "read_offset"], ["trace_id", "length"]], "trace_id", "read_offset", "length")
    counts = sets.agg(F.grouping("read_offset").alias("kind"), F.count("*").alias("n"), F.sum(F.col("length")).alias("bytes"), F.max(F.col("read_offset") + F.col("length")).alias("hi"), F.max("file_size").alias("file_size"))
    by_offset, by_length = F.col("kind") == 0, F.col("kind") == 1
    rows = counts.select("trace_id", "kind", F.when(by_length, F.col("length")).otherwise(F.col("read_offset")).alias("value"), "n", "bytes", "hi", "file_size")
    keys = ["trace_id", "kind"]
    sliced = hot_bounds(reads, ["trace_id"], micros()) is not None
    if sliced:
        rows = cut(rows, keys, F.col("value"))
    block = F.expr(f"value div {BLOCK}")
    ran = running(rows, keys, ["value"], _n=("sum", F.col("n")), _reach=("max", F.col("hi")), _block=("last", block))
    # only lengths need their total, so that a hot trace's offsets stay spread
    all_ = F.sum("n").over(Window.partitionBy(*keys, *([F.when(by_offset, F.col("value"))] if sliced else [])))
    in_cell = F.sum("n").over(Window.partitionBy(*keys, F.when(by_offset, F.least(block, blocks_in_file() - 1))))
    wide = ran.select(
        "trace_id", "file_size", F.when(by_length, F.col("value")).alias("length"), F.when(by_length, F.col("n")).alias("own"), F.when(by_length, F.col("_n") + F.col("n")).alias("upto"), F.when(by_length, all_).alias("total"),
        *[F.when(by_offset, c).alias(name) for name, c in {
            "n": F.col("n"), "bytes": F.col("bytes"), "aligned": F.when(F.col("value") % BLOCK == 0, F.col("n")).otherwise(0), "cell_log": F.col("n") * F.log2(in_cell),
            "new_block": F.when(F.col("_block") == block, 0).otherwise(1), "beyond": F.greatest(F.col("hi") - F.greatest(F.col("value"), F.coalesce("_reach", F.col("value"))), F.lit(0)),
        }.items()],
    )
    n, size, blocks = F.sum("n"), F.max("file_size"), F.max(blocks_in_file())
    aligned = ratio(F.sum("aligned"), n)
    entropy = F.greatest(F.log2(n) - F.sum("cell_log") / n, F.lit(0.0))
    found = wide.groupBy("trace_id").agg(
        n.alias("total_reads"), F.count("n").alias("unique_offsets"), (n - F.count("n")).alias("repeated_reads"), F.sum("bytes").alias("bytes_read"), F.coalesce(ratio(F.sum("bytes"), size), F.lit(0.0)).alias("read_amplification"),
        (100 * F.least(ratio(F.sum("beyond"), size), F.lit(1.0))).alias("coverage_pct"), (100 * ratio(F.sum("new_block"), blocks)).alias("block_coverage_pct"),
        F.coalesce(F.try_divide(entropy, F.nullif(F.log2(blocks), F.lit(0.0))), F.lit(0.0)).alias("offset_entropy"), (aligned * 100).alias("aligned_pct"), (1 - aligned).alias("unaligned_fraction"), *size_measures("own"),
    )
    return found.select("*", *mode_columns()).drop("_mode")


def alignment(reads: DataFrame) -> DataFrame:
    aligned = F.avg(F.when(F.col("read_offset") % BLOCK == 0, 1.0).otherwise(0.0))
    return reads.groupBy("trace_id").agg((aligned * 100).alias("aligned_pct"), (1 - aligned).alias("unaligned_fraction"))


def block_of() -> Column:
    return F.expr(f"read_offset div {BLOCK}")


def blocks_in_file() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("file_size") / BLOCK))


def offset_entropy(reads: DataFrame) -> DataFrame:
    """Entropy of the 4 KiB start blocks over log2 of the file's blocks."""
    counts = reads.groupBy("trace_id", blocks_in_file().alias("blocks"), F.least(block_of(), blocks_in_file() - 1).alias("block")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(by_trace())
    return counts.withColumn("p", share).groupBy("trace_id").agg(F.coalesce(F.try_divide(-F.sum(F.col("p") * F.log2("p")), F.nullif(F.log2(F.max("blocks")), F.lit(0.0))), F.lit(0.0)).alias("offset_entropy"))


def byte_coverage(reads: DataFrame) -> DataFrame:
    spans = reads.select("trace_id", "file_size", F.col("read_offset").alias("lo"), (F.col("read_offset") + F.col("length")).alias("hi"))
    return covered(spans, ["trace_id", "file_size"]).select("trace_id", "covered", F.least(ratio(F.col("covered"), F.col("file_size")), F.lit(1.0)).alias("coverage"))


def block_coverage(reads: DataFrame) -> DataFrame:
    blocks = reads.groupBy("trace_id", block_of().alias("block")).agg(F.max(blocks_in_file()).alias("total"))
    return blocks.groupBy("trace_id").agg(F.count("*").alias("blocks_touched"), F.max("total").alias("blocks_total")).select("*", (100 * ratio(F.col("blocks_touched"), F.col("blocks_total"))).alias("block_coverage_pct"))


def merge_ranges(reads: DataFrame, gap: int = BLOCK) -> DataFrame:
    """Ranges of reads at most `gap` apart; of a hot trace, reads of one offset are counted together first, as they are in one range."""
    spans = cut(reads.select("trace_id", F.col("read_offset").alias("lo"), (F.col("read_offset") + F.col("length")).alias("hi"), F.lit(1).cast("long").alias("n")), ["trace_id"], F.col("lo"))
    if "_slice" in spans.columns:
        spans = spans.groupBy("trace_id", "_slice", "lo").agg(F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return islands(spans, ["trace_id"], "lo", gap=gap).groupBy("trace_id", "island").agg(
        F.min("lo").alias("range_start"), F.max("hi").alias("range_end"), (F.max("hi") - F.min("lo")).alias("range_size"), F.sum("n").alias("read_count"), F.count_distinct("lo").alias("unique_offsets")
    )


def top_repeated(reads: DataFrame, k: int = 10, first: int = 8) -> DataFrame:
    """The k most read offsets with their first read numbers and how many more there are."""
    counts = reads.groupBy("trace_id", "read_offset").agg(F.count("*").alias("times")).where("times > 1")
    best = top(counts, k, ["trace_id"], F.desc("times"), F.col("read_offset"))
    numbered = reads.select("trace_id", "read_offset", F.row_number().over(in_order()).alias("n"))
    ranked = numbered.withColumn("k", F.row_number().over(Window.partitionBy("trace_id", "read_offset").orderBy("n"))).where(F.col("k") <= first)
    lists = ranked.join(best, ["trace_id", "read_offset"]).groupBy("trace_id", "read_offset", "times", "rn").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    more = F.when(F.col("times") > first, F.concat(F.lit(" +"), (F.col("times") - first).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return lists.select("trace_id", "rn", "read_offset", "times", F.concat(F.array_join(F.transform("ns", lambda x: x.cast("string")), ","), more).alias("read_numbers"))


def eof_probes(reads: DataFrame, last_region_end: int) -> DataFrame:
    end = F.col("read_offset") + F.col("length")
    beyond = count_where(end > F.col("file_size"))
    return reads.groupBy("trace_id").agg(
        beyond.alias("reads_beyond_eof"), ((beyond > 0) | (F.max("read_offset") + F.max("length") > F.max("file_size"))).alias("tail_probe_success"), (count_where(end > last_region_end) > 0).alias("tail_probe_library")
    )


def offset_frequency(reads: DataFrame) -> DataFrame:
    return reads.groupBy("read_offset").agg(F.count("*").alias("reads"), F.count_distinct("trace_id").alias("traces")).select("*", (F.col("read_offset") < 20000).alias("header_area"), (F.col("read_offset") == 0).alias("at_zero"))


def length_frequency(reads: DataFrame) -> DataFrame:
    counts = reads.groupBy("trace_id", "length").agg(F.count("*").alias("reads"), F.sum("length").alias("bytes"))
    return counts.select("*", (100 * ratio(F.col("bytes"), F.sum("bytes").over(by_trace()))).alias("bytes_pct"))


def offset_bin(bins: int = 64) -> Column:
    return F.least(F.expr(f"read_offset * {bins} div file_size"), F.lit(bins - 1))


def offset_histogram(reads: DataFrame, bins: int = 64) -> DataFrame:
    """Reads per normalised offset bin of each trace, empty bins too."""
    counts = reads.groupBy("trace_id", offset_bin(bins).alias("bin")).agg(F.count("*").alias("n"))
    slots = reads.select("trace_id").distinct().select("trace_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    filled = slots.join(counts, ["trace_id", "bin"], "left").select("trace_id", "bin", F.coalesce("n", F.lit(0)).alias("reads"))
    return filled.select("*", F.log1p("reads").alias("log_reads"))


def size_distribution(reads: DataFrame) -> DataFrame:
    """Interpolated percentiles of the lengths, read off their cumulative counts."""

    def percentile(share: float) -> Column:
        place = share * (F.col("total") - 1)
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("length")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high)

    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return length_counts(reads.where("length IS NOT NULL")).groupBy("trace_id").agg(*[percentile(share).alias(name) for name, share in shares.items()])


WORD = 60


def coverage_cells(spans: DataFrame, keys: list[str], width: int = 80) -> DataFrame:
    """keys, filled and a map of `width` cells from lo and last (inclusive), relative to `size`.

    A span's cells are bits, 60 in a word, so that a group is one row of words in every task, whatever its spans.
    """
    cell = lambda c: F.least(F.expr(f"{c} * {width} div size"), F.lit(width - 1))
    one, words = F.lit(1).cast("long"), range(-(-width // WORD))

    def bits(k: int) -> Column:
        first, last = F.greatest(F.col("_first") - WORD * k, F.lit(0)), F.least(F.col("_last") - WORD * k, F.lit(WORD - 1))
        shifted = lambda c: F.call_function("shiftleft", one, c.cast("int"))
        return F.when(first <= last, shifted(last + 1) - shifted(first)).otherwise(F.lit(0).cast("long"))

    spanned = spans.where("lo <= last").select(*keys, cell("lo").alias("_first"), cell("last").alias("_last")).where("_first <= _last")
    groups = spanned.groupBy(*keys).agg(*[F.bit_or(bits(k)).alias(f"_word{k}") for k in words])
    filled = sum((F.bit_count(f"_word{k}") for k in words), F.lit(0)).cast("long")
    drawn = F.concat(*[F.reverse(F.lpad(F.bin(f"_word{k}"), WORD, "0")) for k in words])
    return groups.select(*keys, filled.alias("filled"), ratio(filled, F.lit(width)).alias("filled_fraction"), F.translate(F.substring(drawn, 1, width), "01", ".#").alias("drawn"))


def file_cells(reads: DataFrame, width: int = 80) -> DataFrame:
    inside = reads.where("read_offset < file_size")
    return coverage_cells(inside.select("trace_id", F.col("read_offset").alias("lo"), (F.least(F.col("read_offset") + F.col("length"), F.col("file_size")) - 1).alias("last"), F.col("file_size").alias("size")), ["trace_id"], width)


def pattern_features(reads: DataFrame) -> DataFrame:
    """What the pattern classes and insights look at; fractions divide by the number of reads."""
    n = F.row_number().over(in_order())
    before = F.lag(F.col("read_offset") + F.col("length")).over(in_order())
    rows = reads.select("*", n.alias("n"), F.when(before.isNull(), 0).otherwise(F.col("read_offset") - before).alias("delta"), F.max("read_offset").over(by_trace()).alias("most"))
    first = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    end = F.col("read_offset") + F.col("length")
    return rows.groupBy("trace_id").agg(
        F.count("*").alias("reads"), F.count_distinct("read_offset").alias("offsets"),
        ratio(count_where((F.col("n") > 1) & (F.col("delta") == 0)), F.count("*")).alias("sequential_score"),
        (F.coalesce(first(2, "delta") != first(1, "length"), F.lit(False)) & (F.count("*") > 3)).alias("early_jump"),
        F.coalesce(F.max(F.when(end > F.col("most") * 0.95, F.col("length"))), F.lit(0)).alias("footer_size"),
        (count_where((F.col("n") <= 3) & (F.col("length") <= 4096)) > 0).alias("small_probe"),
        count_where(F.col("length") >= 262144).alias("bulk_reads"),
        count_where(F.col("read_offset") == 0).alias("zero_reads"),
        (100 * ratio(count_where(F.col("read_offset") % BLOCK == 0), F.count("*"))).alias("aligned_pct"),
        count_where((F.col("n") <= 5) & (F.col("length") <= 4096)).alias("small_header_reads"),
        first(1, "length").alias("first_length"),
    )


def pattern_class(reads: DataFrame) -> DataFrame:
    score, early, zero, footer = F.col("sequential_score"), F.col("early_jump"), F.col("zero_reads"), F.col("footer_size")
    scattered = (score <= 0.5) & early
    labels = F.concat_ws(
        " / ", F.when(score > 0.8, "LINEAR READ").when(score > 0.5, "CHUNKED LINEAR READ"),
        F.when(scattered & (zero > 3) & (footer > 0), "MIXED STRATEGY").when(scattered & (zero > 2), "HEADER-FOCUSED READ"),
        F.when(F.col("small_probe") & (F.col("bulk_reads") > 0), "HYBRID (Probe + Bulk Scan)"), F.when(F.col("aligned_pct") > 80, "PAGE-ALIGNED I/O"),
    )
    return pattern_features(reads).select("trace_id", "sequential_score", "aligned_pct", "early_jump", F.when(labels == "", "UNCLEAR").otherwise(labels).alias("classification"))


def insights(reads: DataFrame) -> DataFrame:
    """One row per observation that holds for a trace."""
    number = lambda c: F.col(c).cast("string")
    notes = [
        F.when(F.col("zero_reads") >= 3, "several reads at offset 0: header validation"),
        F.when(F.col("early_jump"), "early jump to a non-zero offset: a structure pointer is followed"),
        F.when(F.col("small_header_reads") >= 3, F.concat(F.lit("first "), number("small_header_reads"), F.lit(" reads are small ("), number("first_length"), F.lit(" bytes): header parsing"))),
        F.when(F.col("bulk_reads") > 0, F.concat(number("bulk_reads"), F.lit(" reads of 256 KiB or more: bulk content scan"))),
        F.when(F.col("reads") != F.col("offsets"), F.concat((F.col("reads") - F.col("offsets")).cast("string"), F.lit(" repeated reads: several passes"))),
        F.when(F.col("footer_size") > 0, "reads near the end: footer inspection"),
    ]
    return pattern_features(reads).select("trace_id", F.posexplode(F.array(*notes)).alias("note_ord", "note")).where("note IS NOT NULL")
