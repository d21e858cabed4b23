"""URL filters by mined association rules, with DataFrame operations only.

Each URL becomes a set of tokens (scheme, host labels and their pieces, whole
host, path segments with numbers folded, file ending, query keys, fragment).
FP-growth over the labelled URLs (a page is ``bad`` where its label is toxic or
of low quality) finds frequent token sets; a rule "tokens => bad" is kept where
its bad URLs reach the support and the lower end of its confidence's interval
(``Z`` standard errors, after Wilson, so that few URLs don't make a rule) reaches
the least confidence; a rule implied by a shorter one of at least its confidence
is dropped. Tokens of exactly the same labelled URLs (the segments of a shared deep
path, say) are one item in mining, or k of them would make 2^k sets; any of them
stands for it when URLs are matched. Rules are filed under their rarest token (an inverted index): a URL
that has it is compared with the whole rule. Hand-written rules (host and path,
longest wins) come before mined ones.

Cases: null URLs and URLs without ``://`` have empty host and path and no
tokens, no rule fits and they are allowed; equal pages are judged each; a page
id with several labels is bad if any label is; no labels or no frequent set: no
rules; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.plans.lineage import written

#: verdict, host, path (fixed values)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MIN_SUPPORT, MIN_CONFIDENCE, Z = 0.002, 0.6, 1.645
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; empty where it has no ``://``."""
    host, path = host_of(url), path_of(url)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(f"{kind}:"), p))
    labels = F.split(host, r"\.")
    segments = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, "[0-9]+", "#"))
    keys = F.transform(F.split(F.regexp_extract(url, _PARTS, 3), "&"), lambda p: F.substring_index(p, "=", 1))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    scheme = F.substring_index(url, "://", 1)
    mark = F.when(F.regexp_extract(url, _PARTS, 4) != "", F.array(F.lit("mark:#"))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(
        named("scheme", F.array(scheme)), named("host", F.array(host)), named("label", labels),
        named("piece", F.flatten(F.transform(F.filter(labels, lambda p: F.contains(p, F.lit("-"))), lambda p: F.split(p, "-")))), named("segment", segments),
        named("ending", F.array(ending)), named("key", keys), mark))
    return F.when(F.contains(url, F.lit("://")), found).otherwise(F.array().cast("array<string>"))


def least_confidence(good: Column, n: Column) -> Column:
    """Lower end of the interval of a share of ``good`` among ``n``."""
    p, z2 = good / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def folded(rows: DataFrame, fewest: int) -> DataFrame:
    """rows(id, items) -> token, item: for each token of ``fewest`` rows or more the first of those that stand in the same rows."""
    tokens = rows.select("id", F.explode("items").alias("token"))
    sums = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]  # the same rows: equal number and equal sums of hashes
    extent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= fewest)
    first = extent.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return extent.join(first, ["n", "s1", "s2"]).select("token", "item")


def unimplied(sets: DataFrame) -> DataFrame:
    """sets(rule, confidence, ...), all subsets of a set among them: those that no proper subset equals or beats in confidence.

    Level by level: the best below a set is the best of its subsets of one token less and of what is below these.
    """
    top = sets.agg(F.max(F.size("rule"))).first()[0] or 0
    level = sets.where("size(rule) = 1").withColumn("below", F.lit(None).cast("double"))
    kept = level
    for k in range(2, top + 1):
        own = sets.where(F.size("rule") == k)
        less = own.select("rule", F.explode("rule").alias("out")).select(F.col("rule").alias("over"), F.array_remove("rule", F.col("out")).alias("rule"))
        best = less.join(level.select("rule", F.greatest("confidence", "below").alias("best")), "rule").groupBy(F.col("over").alias("rule")).agg(F.max("best").alias("below"))
        level = written(own.join(best, "rule", "left"), "url-sets")
        kept = kept.union(level)
    return kept.where("below is null or below < confidence").drop("below")


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled(url, bad boolean) -> (rule (sorted items), token (its rarest), confidence, support: rules for ``bad``; token, item: what stands for an item)."""
    from pyspark.ml.fpm import FPGrowth

    rows = written(labelled.select(tokens_of(F.col("url")).alias("items"), F.when(F.col("bad"), "=bad").otherwise("=good").alias("label")), "url-tokens")
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "url-items")
    n = rows.count()
    spark = labelled.sparkSession
    if n == 0:
        return (spark.createDataFrame([], "rule array<string>, token string, confidence double, support double"), spark.createDataFrame([], "token string, item string"))
    least_bad = math.ceil(min_confidence * Z * Z / max(1 - min_confidence, 1e-9))  # fewer bad URLs can't reach the confidence
    support = min(1.0, max(min_support, least_bad / n))
    names = written(folded(rows, max(1, math.ceil(support * n - 1e-9))), "url-names")
    items = rows.select("id", F.explode("items").alias("token")).join(names, "token").groupBy("id").agg(F.collect_set("item").alias("own"))
    items = written(rows.join(items, "id", "left").select(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array("label")).alias("items")), "url-folded")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(items).freqItemsets
    found = written(found.where(~F.array_contains("items", "=good")).select(F.array_sort(F.array_remove("items", "=bad")).alias("rule"), F.array_contains("items", "=bad").alias("is_bad"), "freq"), "url-frequent")
    bad = found.where("is_bad and size(rule) > 0").select("rule", F.col("freq").alias("bad"))
    sets = written(bad.join(found.where("not is_bad").select("rule", F.col("freq").alias("n")), "rule").select(
        "rule", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / n).alias("support"), (least_confidence(F.col("bad"), F.col("n")) >= min_confidence).alias("sure")), "url-sets")
    rules = unimplied(sets).where(F.col("sure") & (F.col("confidence") >= min_confidence)).drop("sure")
    counts = found.where("not is_bad and size(rule) = 1").select(F.col("rule")[0].alias("token"), F.col("freq").alias("n"))
    filed = rules.select("rule", "confidence", "support", F.explode("rule").alias("token")).join(counts, "token")
    return filed.groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.max("confidence").alias("confidence"), F.max("support").alias("support")), names


def matched(urls: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct urls(url) that some rule matches: key, n_rules."""
    tokens = urls.select(F.col("url").alias("key"), F.explode(tokens_of(F.col("url"))).alias("token")).join(names, "token")
    rules = written(rules.select("token", "rule"), "url-index")
    # only items that stand in some rule matter
    used = rules.select(F.explode("rule").alias("item")).distinct()
    has = tokens.join(used, "item", "left_semi").groupBy("key").agg(F.collect_set("item").alias("has"))
    hits = has.withColumn("token", F.explode("has")).join(rules, "token").where(F.size(F.array_except("rule", "has")) == 0)
    return hits.groupBy("key").agg(F.count("*").alias("n_rules"))


def hand_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule like ``net/de/``, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, longer, win
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_rules for every row of pages(page_id, url); labels(doc_id, quality, toxic)."""
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    rules_, names = mined_rules(pages.select("page_id", "url").join(bad, "page_id").where("url is not null"))
    # equal URLs are judged once: their tokens and matches are the same
    hits = matched(pages.select("url").where(F.contains("url", F.lit("://"))).distinct(), rules_, names)
    rule, verdict = hand_rule(F.col("host"), F.col("path"), rules)
    # pages without a URL match nothing; each gets a key of its own, so that they don't meet in one task
    key = F.coalesce("url", F.concat(F.lit("page "), F.xxhash64("page_id").cast("string")))
    out = pages.select("page_id", key.alias("own"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.join(hits, out.own == hits.key, "left").withColumns({"rule": rule, "by_hand": verdict})
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("by_hand", F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"),
                      F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
