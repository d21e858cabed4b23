"""Comparison of groups and graph statistics: overlap, imbalance, modularity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.operators.counting import weights
from chainweave.plans.lineage import cut, written
from chainweave.plans.numbering import numbered


def presence(df: DataFrame, groupby: str, target: str, fraction=False) -> DataFrame:
    """groupby, target, value: (weighted) number of cells."""
    rows = df.where(F.col(groupby).isNotNull() & F.col(target).isNotNull())
    return weights(rows, fraction, groupby).groupBy(groupby, target).agg(F.sum("weight").alias("value"))


def jaccard(df: DataFrame, groupby: str, target: str, threshold: float = 0.0, fraction=False) -> DataFrame:
    """a, b, distance for all pairs of groups, a < b: 1 - intersection / union of the targets above the threshold."""
    rows = presence(df, groupby, target, fraction).where(F.col("value") > threshold).select(F.col(groupby).alias("g"), target)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    both = rows.select(F.col("g").alias("a"), target).join(rows.select(F.col("g").alias("b"), target), target).where("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("both"))
    pairs = sizes.select(F.col("g").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("g").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (1 - F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("both", F.lit(0)))).alias("distance"))


def single_linkage(distances: list[tuple]) -> list[tuple]:
    """Merges (member of one, member of other, distance) of a few groups, nearest first."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for a, b, d in sorted(distances, key=lambda t: (t[2], t[0], t[1])):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y), d))
    return out


def repertoire_overlap(df: DataFrame, groupby: str, target: str, threshold: float = 0.0, fraction=False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(presence, distances, linkage): weighted cells per group and target, Jaccard distances of groups, merges of single linkage (step, a, b, distance)."""
    distances = cut(jaccard(df, groupby, target, threshold, fraction))
    kind = distances.schema["a"].dataType.simpleString()

    def merges(pdf: pd.DataFrame) -> pd.DataFrame:
        found = single_linkage(list(zip(pdf.a, pdf.b, pdf.distance)))
        return pd.DataFrame({"step": range(len(found)), "a": [x[0] for x in found], "b": [x[1] for x in found], "distance": [x[2] for x in found]})

    # groups are samples or patients: their distances fit one task
    linkage = distances.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merges, f"step int, a {kind}, b {kind}, distance double")
    return presence(df, groupby, target, fraction), distances, linkage


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables with its margins that are no likelier."""
    n1, n2, k = a + b, c + d, a + c
    lo, hi = max(0, k - n2), min(k, n1)
    ln = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    p = [ln(n1, x) + ln(n2, k - x) - ln(n1 + n2, k) for x in range(lo, hi + 1)]
    own = p[a - lo]
    return min(1.0, math.fsum(math.exp(x) for x in p if x <= own + 1e-7))


def fisher_tables(tables) -> list[float]:
    """``fisher_exact`` of many tables, once for each distinct one."""
    seen: dict = {}
    for t in tables:
        if t not in seen:
            seen[t] = fisher_exact(*t)
    return [seen[t] for t in tables]


def _sides(df: DataFrame, replicate: str, groupby: str, case: str, control: str | None, hue: str | None) -> DataFrame:
    """hue, side, replicate, n: cells of each replicate on each side."""
    side = F.when(F.col(groupby) == case, "case").when(F.lit(True) if control is None else F.col(groupby) == control, "control")
    rows = df.where(F.col(replicate).isNotNull() & F.col(groupby).isNotNull())
    named = F.col(hue).cast("string") if hue else F.lit("All")
    return rows.select(named.alias("hue"), groupby, side.alias("side"), F.col(replicate).alias("replicate")).where("side is not null and hue is not null").groupBy(
        "hue", groupby, "side", "replicate").agg(F.count(F.lit(1)).alias("n")).drop(groupby)


def imbalance_counts(df: DataFrame, replicate: str, groupby: str, target: str, case: str, control: str | None = None, hue: str | None = None, fraction=False) -> DataFrame:
    """hue, target and per side: _n (weighted cells with the target in the side's replicates), _mean (mean share of a replicate), _total (cells)."""
    sides = cut(_sides(df, replicate, groupby, case, control, hue))
    sizes = presence(df, replicate, target, fraction).withColumnRenamed(replicate, "replicate")
    on = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0.0))
    per = sides.join(sizes, "replicate").groupBy("hue", target).agg(
        *[on(s, F.col("value")).alias(f"{s}_n") for s in ("case", "control")],
        *[on(s, F.col("value") / F.col("n")).alias(f"{s}_sum") for s in ("case", "control")])
    total = sides.groupBy("hue").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"{s}_total") for s in ("case", "control")],
                                     *[F.count_if(F.col("side") == s).alias(f"{s}_rows") for s in ("case", "control")])
    rows = per.where("case_n > 0 or control_n > 0").join(total, "hue")
    return rows.select("hue", target, *[c for s in ("case", "control") for c in (
        F.col(f"{s}_n"), (F.col(f"{s}_sum") / F.greatest(F.col(f"{s}_rows"), F.lit(1))).alias(f"{s}_mean"), F.col(f"{s}_total"))])


def clonotype_imbalance(df: DataFrame, replicate: str, groupby: str, target: str, case: str, control: str | None = None, hue: str | None = None, fraction=False) -> DataFrame:
    """hue, target, p_value, log_p, log2_fc: Fisher's exact test of cells with and without the target, and fold change of mean shares, case against control.

    To both means a hundredth of the least abundance per replicate is added; it is 0
    where some replicate lacks some target, and the fold change may then be infinite.
    """
    counts = imbalance_counts(df, replicate, groupby, target, case, control, hue, fraction)

    @F.pandas_udf("double")
    def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(fisher_tables([tuple(map(int, t)) for t in zip(a, b, c, d)]), dtype="float64")

    sizes = presence(df, replicate, target, fraction)
    least = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).crossJoin(  # one row each
        sizes.agg(F.count_distinct(replicate).alias("rows"), F.count_distinct(target).alias("columns"))).select(
        F.coalesce(F.when(F.col("n") == F.col("rows") * F.col("columns"), 0.01 * F.col("least") / F.col("rows")), F.lit(0.0)).alias("more"))
    absent = lambda s: F.greatest(F.col(f"{s}_total") - F.col(f"{s}_n"), F.lit(0)).cast("long")
    # few bytes, but a test takes as many steps as the target has cells: dealt to all tasks, equal tables to one
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.repartition(width, "case_n", "case_total", "control_n", "control_total")
    out = counts.crossJoin(least).withColumn("p_value", fisher(F.col("case_n").cast("long"), absent("case"), F.col("control_n").cast("long"), absent("control")))
    a, b = F.col("case_mean") + F.col("more"), F.col("control_mean") + F.col("more")
    fold = F.when((a > 0) & (b > 0), F.log2(a / F.when(b > 0, b))).when(a > 0, float("inf")).when(b > 0, float("-inf")).otherwise(float("nan"))
    return out.select("hue", target, "p_value", (-F.log10("p_value")).alias("log_p"), fold.alias("log2_fc"))


def imbalance_abundance(df: DataFrame, replicate: str, groupby: str, target: str, case: str, control: str | None = None, hue: str | None = None, fraction=False) -> DataFrame:
    """target, hue, side, replicate, abundance (share of the replicate's cells) for every tested target and replicate, 0 where absent."""
    sides = cut(_sides(df, replicate, groupby, case, control, hue))
    sizes = written(presence(df, replicate, target, fraction).withColumnRenamed(replicate, "replicate"), "presence")
    tested = sides.join(sizes, "replicate").where("value > 0").select("hue", target).distinct()
    rows = tested.join(sides, "hue").join(sizes, ["replicate", target], "left")  # the table is targets x replicates
    return rows.select(target, "hue", "side", "replicate", (F.coalesce("value", F.lit(0.0)) / F.col("n")).alias("abundance"))


def observed_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """label, size, n_edges: members of each label and neighbour pairs inside it; labels(node, label), edges(src, dst) undirected."""
    named = labels.where("label is not null")
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inside = e.join(named.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(
        named.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("n_edges"))
    return sizes.join(inside, "label", "left").na.fill(0, ["n_edges"])


def fit_negative_binomial(x: np.ndarray) -> tuple[float, float]:
    """(r, p) of largest likelihood: p follows from r and the mean, r from a golden-section search on its logarithm."""
    x = np.asarray(x, dtype=float)
    mean = x.mean()
    if mean == 0:
        return 1.0, 1.0
    values, counts = np.unique(x, return_counts=True)

    def loss(log_r):
        r = math.exp(log_r)
        p = r / (r + mean)
        return -float(np.sum(counts * np.array([math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) for v in values])) + len(x) * r * math.log(p) + x.sum() * math.log(1 - p))

    lo, hi, g = math.log(1e-3), math.log(1e4), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    r = math.exp((lo + hi) / 2)
    return r, r / (r + mean)


def negative_binomial_cdf(k: int, r: float, p: float) -> float:
    if k < 0:
        return 0.0
    ln = lambda i: math.lgamma(i + r) - math.lgamma(r) - math.lgamma(i + 1) + r * math.log(p) + i * math.log(max(1 - p, 1e-300))
    return min(1.0, math.fsum(math.exp(ln(i)) for i in range(k + 1)))


def keyed_ranks(numbers: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Place of each number below n (rows) in the pseudorandom permutation of 0 .. n - 1 of each key (columns).

    Six Feistel rounds permute the least square of a power of two that holds n;
    a place beyond n is permuted again until it lies below (cycle walking).
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, one = np.uint64((1 << half) - 1), np.uint64(half)
    x, key = (v.ravel() for v in np.broadcast_arrays(numbers.astype(np.uint64)[:, None], keys.astype(np.uint64)[None]))
    out, todo = np.empty(len(x), dtype=np.int64), np.arange(len(x))
    x = x.copy()
    while len(todo):
        left, right = x >> one, x & mask
        for r in range(6):
            h = (right + key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(29)) & mask)
        x = (left << one) | right
        inside = x < np.uint64(n)
        out[todo[inside]] = x[inside].astype(np.int64)
        todo, x, key = todo[~inside], x[~inside], key[~inside]
    return out.reshape(len(numbers), len(keys))


def random_edges(edges: DataFrame, n: int, sizes: list[int], n_permutations: int, seed: int) -> DataFrame:
    """perm, at, k: edges(a, b: node numbers) that the random sets hold from the at-th size on, for each permutation.

    The random set of size s in a permutation holds the nodes at its first s
    places, so an edge counts from the later place of its ends on. Nothing is
    sorted and no node is paired with a permutation outside its edge's task.
    """
    steps, keys = np.array(sizes), np.arange(n_permutations) + seed
    width = len(steps) + 1  # the last place: ends that no set holds

    def run(batches):
        counts, offset = np.zeros(n_permutations * width, dtype=np.int64), (np.arange(n_permutations) * width)[None]
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            chunk = max(1, (1 << 21) // n_permutations)
            for lo in range(0, len(a), chunk):
                ends, which = np.unique(np.r_[a[lo:lo + chunk], b[lo:lo + chunk]], return_inverse=True)
                at, m = np.searchsorted(steps, keyed_ranks(ends, n, keys) + 1).astype(np.int32), len(which) // 2
                late = np.maximum(at[which[:m]], at[which[m:]])
                counts += np.bincount((late + offset).ravel(), minlength=len(counts))
        found = np.flatnonzero(counts)
        found = found[found % width < len(steps)]
        for lo in range(0, len(found), 1 << 16):
            some = found[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some // width), pa.array(some % width), pa.array(counts[some])], names=["perm", "at", "k"])

    # neighbours share their ends' places where they come together
    near = written(edges.select("a", "b"), "edges").repartitionByRange("a").sortWithinPartitions("a", "b")
    return near.mapInArrow(run, "perm long, at long, k long").groupBy("perm", "at").agg(F.sum("k").alias("k"))


def false_discovery(df: DataFrame, p: str, tie: str, block: int = 100_000) -> DataFrame:
    """Add ``fdr`` (Benjamini-Hochberg): the least p x rows / rank from a row's rank on. Ranks by a distributed sort, minima by block of ranks."""
    rows = numbered(df, [F.col(p), F.col(tie)], "_rank")
    m = rows.count()
    rows = rows.withColumns({"_q": F.col(p) * m / (F.col("_rank") + 1), "_block": F.floor(F.col("_rank") / block)})
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    tails = rows.groupBy("_block").agg(F.min("_q").alias("_least")).select("_block", F.min("_least").over(later).alias("_after"))
    own = Window.partitionBy("_block").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(tails, "_block").withColumn("fdr", F.least(F.lit(1.0), F.min("_q").over(own), "_after")).drop("_rank", "_q", "_block", "_after")


def clonotype_modularity(labels: DataFrame, edges: DataFrame, n_permutations: int = 1000, exact: bool = False, seed: int = 0) -> DataFrame:
    """label, size, n_edges, score, p_value, fdr: edges inside a label against random sets of its size.

    Random sets come from keyed permutations of the numbered nodes. Distinct
    sizes are few: they add up to at most the number of nodes n, so there are
    fewer than the square root of 2 n.
    """
    spark = labels.sparkSession
    seen = cut(observed_edges(labels, edges))
    sizes = sorted(r[0] for r in seen.select("size").distinct().collect())
    nodes = numbered(labels.select("node").distinct(), "node", "no")
    n = nodes.count()
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    e = e.join(nodes.select(F.col("node").alias("src"), F.col("no").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("no").alias("b")), "dst")
    drawn = random_edges(e, n, sizes, n_permutations, seed).groupBy("perm").agg(F.map_from_entries(F.collect_list(F.struct("at", "k"))).alias("own"))
    steps = spark.createDataFrame(list(enumerate(sizes)), "at int, size long")
    each = spark.range(n_permutations).withColumnRenamed("id", "perm").join(drawn, "perm", "left")
    each = each.select("perm", "own", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(sizes) - 1)))).alias("at"))
    upto = Window.partitionBy("perm").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = each.withColumn("n", F.sum(F.coalesce(F.try_element_at("own", F.col("at").cast("long")), F.lit(0))).over(upto))
    counts = counts.groupBy("at").agg(F.collect_list("n").alias("random")).join(F.broadcast(steps), "at").drop("at")

    @F.pandas_udf("double")
    def p_value(size: pd.Series, n: pd.Series, random: pd.Series) -> pd.Series:
        out = []
        fits: dict = {}
        for s, k, x in zip(size, n, random):
            x = np.asarray(x)
            if exact:
                out.append(max(float((x >= k).mean()), 1 / len(x)))
            elif s <= 2:
                out.append(1.0)
            else:
                if s not in fits:
                    fits[s] = fit_negative_binomial(x)
                out.append(max(1 - negative_binomial_cdf(int(k) - 1, *fits[s]), float(np.finfo(np.float32).tiny)))
        return pd.Series(out, dtype="float64")

    # one fit for each size and number of edges, not for each label
    kinds = seen.select("size", "n_edges").distinct().join(counts, "size")
    mean = F.aggregate("random", F.lit(0).cast("long"), lambda a, v: a + v) / F.size("random")
    kinds = kinds.select("size", "n_edges", F.log2((F.col("n_edges") + 1) / (mean + 1)).alias("score"), p_value("size", "n_edges", "random").alias("p_value"))
    return false_discovery(seen.join(kinds, ["size", "n_edges"]).select("label", "size", "n_edges", "score", "p_value"), "p_value", "label")
