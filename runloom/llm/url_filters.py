"""URL filters: fixed host and path rules, and association rules mined from labelled urls.

A fixed rule names a host and a path prefix; it fits the host and its subdomains; the longest fitting rule decides.
For urls without one the mined rules speak. A url's items are its host's suffixes and words, the parts of
its path (numbers as "#"), its scheme and its query's keys. A rule "items -> label" has the least support and confidence or more, and
no more general rule has as much confidence.
Rules are matched through an inverted index from items to rules: a rule fits when all its items are met. The fitting rule of the highest confidence,
then support, then fewest and first items decides; without one the url is allowed.

Labels come from outside: the fixed rules never label a url, so no mined rule merely repeats one. Mining takes all items and goes by size of sets: a set
is grown only while a label has the least support in it, while it has urls of several labels, and while it occurs in fewer urls than each set with
an item less. Every set beyond has a more general one of as much confidence, so that no rule is missed; items that all urls share, or that
occur in the same urls, give no further sets. What is left grows with the number of frequent sets that the labelled urls hold, in tables.

Defined results: a null url, or one without "://", has empty host and path and no items, so it is allowed; repeated rows are judged
alike; null labels are left out; without labels, or with too few for the least support, no rule is mined and only the fixed rules block; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

# Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LEAST = 0.002, 0.8, 10
WIDTH = 12  # up to so many items a url the tests count every set; mining takes all
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later ones wrap the earlier, so the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def items_of(url: Column, host: Column, path: Column) -> Column:
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -n, n), ".")))
    suffix = F.when(F.size(labels) > 0, suffix).otherwise(F.array().cast("array<string>"))
    part = lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "#"))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), part)
    words = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.when(F.coalesce(url, F.lit("")).contains("://"), F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1))))
    return F.array_distinct(F.concat(F.coalesce(scheme, F.array().cast("array<string>")), suffix, words, parts, keys))


def _sets(items: DataFrame, ys: list[str], need: float) -> DataFrame:
    """(x, n, ys) of the sets x of rows (x, ys) that some label has in need rows or more."""
    out = items.groupBy("x").agg(*(F.sum(y).alias(y) for y in ys)).where(F.greatest(*ys, F.lit(0)) >= need)
    return out.select("x", sum((F.col(y) for y in ys), F.lit(0)).alias("n"), *ys)


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Rules (items, label, confidence, support) from rows (items, label); redundant ones are left out.

    support is a share of the labelled urls; a rule rests on ``least`` urls at the least. One round a size of sets; all that it holds is in tables.
    """
    schema = "items array<string>, label string, confidence double, support double"
    rows = labelled.where("label is not null and size(items) > 0").groupBy("items", "label").agg(F.count("*").alias("w"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    total = {r[0]: r[1] for r in rows.groupBy("label").agg(F.sum("w")).collect()}  # a row a label
    n, names = sum(total.values()), sorted(total)
    if n < least:
        return labelled.sparkSession.createDataFrame([], schema)
    need, ys, bs = max(support * n, least), [f"y{i}" for i in range(len(names))], [f"b{i}" for i in range(len(names))]
    share = [F.col(y) / F.col("n") for y in ys]
    each = rows.select("row", F.explode("items").alias("x"), *(F.when(F.col("label") == name, F.col("w")).otherwise(0).alias(y) for name, y in zip(names, ys)))
    # urls by their frequent items
    kinds = each.join(_sets(each, ys, need).select("x"), "x").groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("items"), *(F.first(y).alias(y) for y in ys))
    kinds = kinds.groupBy("items").agg(*(F.sum(y).alias(y) for y in ys)).withColumn("kind", F.monotonically_increasing_id())
    held = materialise(kinds.select("kind", F.explode("items").alias("item"), *ys), "kinds")
    # of items that occur in the same urls one stands for all
    alike = held.groupBy("item").agg(F.sum(F.xxhash64("kind").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("kind", F.lit(7))).alias("s2"), F.count("*").alias("s3"))
    alike = alike.groupBy("s1", "s2", "s3").agg(F.sort_array(F.collect_list("item")).alias("members"))
    alike = materialise(alike.select(F.col("members")[0].alias("item"), "members"), "alike")
    held = held.join(alike.select("item"), "item", "left_semi").select("kind", F.array("item").alias("x"), *ys)
    sets = materialise(_sets(held, ys, need).select("*", *(F.lit(-1.0).alias(b) for b in bs)), "sets")
    rules = None
    for size in count(2):
        good = [(F.col(y) >= need) & (c >= confidence) & (c > F.col(b)) for y, b, c in zip(ys, bs, share)]
        cells = F.array(*(F.when(g, F.struct(F.lit(name).alias("label"), c.alias("confidence"), (F.col(y) / n).alias("support"))) for g, name, y, c in zip(good, names, ys, share)))
        here = sets.select("x", F.explode(F.array_compact(cells)).alias("r"))
        rules = here if rules is None else rules.union(here)
        # larger sets with an item that all urls have repeat those without it; those of one label only have no better ones
        open_ = sets.where((F.col("n") < n) & (F.greatest(*ys, F.lit(0)) < F.col("n")))
        if open_.isEmpty():
            break
        held = materialise(held.join(open_.select("x"), "x", "left_semi").select("kind", "x", *ys), "held")
        last = F.sort_array(F.collect_list(F.element_at("x", -1))).alias("last")
        near = held.groupBy("kind", F.slice("x", 1, size - 2).alias("p")).agg(last, *(F.first(y).alias(y) for y in ys))
        near = near.select("kind", "p", "last", *ys, F.posexplode("last").alias("i", "a"))
        near = near.select("kind", F.concat("p", F.array("a")).alias("p"), F.explode(F.slice("last", F.col("i") + 2, F.size("last"))).alias("b"), *ys)
        held = near.select("kind", F.concat("p", F.array("b")).alias("x"), *ys)
        parts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("x", lambda _, j: j != i))
        known = open_.select(F.col("x").alias("part"), F.col("n").alias("m"), *(F.greatest(F.col(b), c).alias(b) for b, c in zip(bs, share)))
        more = _sets(held, ys, need).withColumn("part", F.explode(parts)).join(known, "part")
        more = more.groupBy("x", "n", *ys).agg(F.count("*").alias("parts"), F.min("m").alias("m"), *(F.max(b).alias(b) for b in bs))
        sets = materialise(more.where((F.col("parts") == size) & (F.col("m") > F.col("n"))).drop("parts", "m"), "sets")
    # every choice of items that occur in the same urls
    rules = materialise(rules.select("x", "r.*").withColumn("rule", F.monotonically_increasing_id()), "rules")
    wide = rules.select("rule", F.explode("x").alias("item")).join(alike, "item").groupBy("rule").agg(F.collect_list("members").alias("members"))
    grown = lambda acc, m: F.flatten(F.transform(acc, lambda a: F.transform(m, lambda v: F.concat(a, F.array(v)))))
    choices = F.aggregate("members", F.array(F.array().cast("array<string>")), grown)
    return rules.join(wide, "rule").select(F.explode(choices).alias("items"), "label", "confidence", "support").withColumn("items", F.sort_array("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> list[tuple]:
    """mined() as a list, best first."""
    got = [(tuple(r["items"]), r["label"], r["confidence"], r["support"]) for r in mined(labelled, support, confidence, least).collect()]
    return sorted(got, key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1]))


def judge(
    pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE,
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, mined (items of the mined rule that decided, else null).

    labels: (url, label "block" or "allow"); without any, only the fixed rules block.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), items_of(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    rows = materialise(rows, "urls")
    if labels is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    u = F.col("url").cast("string")
    found = mined(labels.select(items_of(u, host_of(u), path_of(u)).alias("items"), "label"), support, confidence)
    place = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("items").alias("need"), F.col("items").alias("of"), "label")
    table = materialise(found.select(place.alias("place"), F.monotonically_increasing_id().alias("id")), "index")
    kinds = rows.where("fixed is null").select("items").distinct()
    met = kinds.select("items", F.explode("items").alias("item")).join(table.select("id", "place.need", F.explode("place.of").alias("item")), "item")
    met = met.groupBy("items", "id").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n = need")
    first = met.join(table, "id").groupBy("items").agg(F.min("place").alias("place"))
    first = first.select(F.col("items").alias("i"), F.col("place.label").alias("found"), F.array_join("place.of", ",").alias("mined"))
    out = rows.join(first, F.col("fixed").isNull() & (F.col("items") == F.col("i")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "found", F.lit("allow")).alias("verdict"), "mined")
