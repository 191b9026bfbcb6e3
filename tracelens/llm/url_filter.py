"""URL filters: fixed host and path rules, then association rules mined by FP-growth from labelled URLs.

A URL's items are its scheme, host parts, words of the path, query keys, query keys with values, and fragment. Rules `items -> bad`
stay when their support, confidence and lift reach the parameters, and when no rule on fewer of the same items
is as confident. A rule is indexed under its rarest item; a URL looks up its items there and is tested for the
rest. Of items that are in the same labelled URLs one stands for all while rules are mined, so that long shared paths do not
multiply frequent sets; a rule then asks for all of them (a closed set). All of it is DataFrame work and Spark's own FP-growth; what reaches the driver is bounded by min_support.

Null URLs and those without `://` have an empty host and path, no items and are allowed; repeated pages are judged
each; only the id and url columns are read; without labels no rule is mined; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its path.
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: str = "url") -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))


def host_path(url: str = "url") -> tuple[Column, Column]:
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules: list[tuple[str, str, str]] = HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits `host` and `path`, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def items(url: str = "url") -> Column:
    """The distinct items of a URL; numbers count as one item."""
    host, path = host_path(url)
    pairs = F.split(F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1), "&")
    tagged = lambda tag, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    made = F.concat(
        tagged("scheme=", F.array(F.regexp_extract(F.col(url), "^([^:/?#]*)://", 1))),
        tagged("part=", F.split(host, r"\.")),
        tagged("path=", F.split(path, "[^A-Za-z0-9_-]+")),
        tagged("query=", F.transform(pairs, lambda p: F.substring_index(p, "=", 1))),
        tagged("query=", pairs),
        tagged("frag=", F.array(F.regexp_extract(F.col(url), "(?s)#(.*)", 1))),
    )
    return F.when(F.instr(F.col(url), "://") > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def item_classes(each: DataFrame) -> DataFrame:
    """item and first: the least of the items that are in the same baskets; the label is a class of its own.

    Such items make as many frequent sets as they have subsets, all of one support and confidence. A class has no more items than a basket.
    """
    place = F.xxhash64("basket").cast("decimal(20,0)")
    classes = each.groupBy("item").agg(F.count("*").alias("n"), F.sum(place).alias("places"))
    same = ["n", "places", "label"]
    marked = classes.withColumn("label", F.col("item") == BAD)
    return marked.join(marked.groupBy(*same).agg(F.min("item").alias("first")), same).select("item", "first")


def mine_rules(labelled: DataFrame, *, min_support: float = 0.002, min_count: int = 25, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """key, items, confidence of the rules from `labelled` (url, bad boolean).

    Item sets count from min_support of the labelled URLs and min_count of them on.
    """
    labelled = labelled.where(F.col("bad").isNotNull())
    baskets = labelled.select(F.when(F.col("bad"), F.array_append(items(), F.lit(BAD))).otherwise(items()).alias("items")).where(F.size("items") > 0)
    baskets = stored(baskets.select(F.monotonically_increasing_id().alias("basket"), "items"), "baskets")
    support = min(1.0, max(min_support, min_count / max(1, baskets.count())))
    each = baskets.select("basket", F.explode("items").alias("item"))
    classes = stored(item_classes(each), "item-classes")
    firsts = classes.where("item = first").select("item")
    baskets = stored(each.join(firsts, "item").groupBy("basket").agg(F.collect_list("item").alias("items")), "closed-baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift))
    rules = stored(found.select(F.array_sort("antecedent").alias("items"), "confidence"), "url-rules")
    wider = rules.select(F.explode("items").alias("item"), F.col("items").alias("inner"), F.col("confidence").alias("other"))
    narrower = (
        rules.select(F.explode("items").alias("item"), "items", "confidence")
        .join(wider, "item")
        .where((F.size("inner") < F.size("items")) & (F.size(F.array_except("inner", "items")) == 0) & (F.col("other") >= F.col("confidence")))
        .select("items")
        .distinct()
    )
    kept = rules.join(narrower, "items", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    rarest = kept.select("items", "confidence", F.explode("items").alias("item")).join(single, "item").groupBy("items", "confidence").agg(F.min_by("item", F.struct("freq", "item")).alias("key"))
    member = classes.select(F.col("first").alias("item"), F.col("item").alias("member"))
    closed = rarest.select("key", "items", "confidence", F.explode("items").alias("item")).join(member, "item").groupBy("key", F.col("items").alias("_mined"), "confidence")
    return closed.agg(F.array_sort(F.collect_list("member")).alias("items")).select("key", "items", "confidence")


def matched_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a mined rule matches, with the confidence of the best."""
    urls = pages.select("url").distinct().select("url", items().alias("own"))
    looked = urls.select("url", "own", F.explode("own").alias("key")).join(rules, "key")
    return looked.where(F.size(F.array_except("items", "own")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", rules: list[tuple[str, str, str]] = HOST_RULES, **mining: float) -> DataFrame:
    """id, host, path, rule, verdict and the confidence of the mined rule that matched.

    labels: page id (doc_id), quality and toxic; low quality or toxic pages are bad.
    """
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    pages = pages.select(F.col(id_col).alias("id"), "url")
    labelled = pages.join(marked, pages["id"] == marked["doc_id"]).select("url", "bad")
    hits = matched_urls(pages, stored(mine_rules(labelled, **mining), "rules"))
    host, path = host_path()
    rule, verdict = fixed_rule(rules)
    judged = pages.select("id", "url", host.alias("host"), path.alias("path")).join(hits, "url", "left").select("*", rule.alias("rule"), verdict.alias("fixed"))
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", mined).alias("verdict"), "confidence")
