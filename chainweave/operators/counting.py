"""Group statistics: expansion, abundance, spectratypes, gene usage, motifs, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions.values import nullify
from chainweave.plans.lineage import cut, written
from chainweave.plans.numbering import numbered

OTHER = "other"


def weights(df: DataFrame, normalize, default: str) -> DataFrame:
    """Add ``weight``: 1, or 1 / size of the row's group in ``default`` (True) or in a named column."""
    if normalize is False:
        return df.withColumn("weight", F.lit(1.0))
    if normalize is not True and not isinstance(normalize, str):
        raise ValueError("normalize is False, True or a column's name")
    by = default if normalize is True else normalize
    return df.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(by)))


def expansion_label(n: Column, breakpoints=(1, 2)) -> Column:
    if not breakpoints:
        raise ValueError("at least one breakpoint is needed")
    out = F.lit(f"> {breakpoints[-1]}")
    for b in reversed(breakpoints):
        out = F.when(n <= b, f"<= {b}").otherwise(out)
    return out


def clonal_expansion(df: DataFrame, target: str, expanded_in: str | None = None, breakpoints=(1, 2)) -> DataFrame:
    """Add ``clonal_expansion``: how often a cell's target occurs (in its group): ``nan`` without target, null without group."""
    keys = [expanded_in, target] if expanded_in else [target]
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    sizes = df.where(named).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # rows without a key don't join: they would all come to one task
    out = df.where(named).join(sizes, keys).unionByName(df.where(~named).withColumn("_n", F.lit(None).cast("long")))
    label = F.when(F.col(target).isNull(), "nan").when(F.col("_n").isNotNull(), expansion_label(F.col("_n"), breakpoints))
    return out.withColumn("clonal_expansion", label).drop("_n")


def summarize_clonal_expansion(df: DataFrame, groupby: str, target: str, summarize_by: str = "cell", normalize: bool = True, breakpoints=(1, 2)) -> DataFrame:
    """groupby, clonal_expansion, value: cells or clones per label, as shares of their group; every label of a group, 0 where empty."""
    rows = clonal_expansion(df, target, None, breakpoints).where(F.col(groupby).isNotNull() & F.col(target).isNotNull())
    rows = rows.select(groupby, target, "clonal_expansion")
    if summarize_by == "clone_id":
        rows = rows.distinct()
    elif summarize_by != "cell":
        raise ValueError("summarize_by is cell or clone_id")
    counts = rows.groupBy(groupby, "clonal_expansion").agg(F.count(F.lit(1)).alias("n"))
    labels = [f"<= {b}" for b in breakpoints] + [f"> {breakpoints[-1]}"]
    wide = counts.groupBy(groupby).pivot("clonal_expansion", labels).agg(F.sum("n")).na.fill(0)
    long = wide.unpivot([groupby], labels, "clonal_expansion", "n")
    total = F.sum("n").over(Window.partitionBy(groupby))
    return long.withColumn("value", (F.col("n") / total) if normalize else F.col("n").cast("double")).drop("n")


def group_abundance(df: DataFrame, groupby: str, target: str, fraction=False, sort="count") -> DataFrame:
    """groupby, target, value, group_rank, target_rank: weighted counts; targets rank by total count, ties by name.

    ``sort`` ranks the groups: by ``count``, ``alphabetical``, or in the order of a list, which also leaves out all others.
    """
    if not (isinstance(sort, (list, tuple)) or sort in ("count", "alphabetical")):
        raise ValueError("sort is count, alphabetical or a list of groups")
    if fraction is not False and fraction is not True and not isinstance(fraction, str):
        raise ValueError("fraction is False, True or a column's name")
    by = groupby if fraction is True else fraction or None
    keys = list(dict.fromkeys([groupby, target, *([by] if by else [])]))
    counts = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))  # the only pass over the cells
    # of counts, not of cells: a filter of cells would be asked of the expressions that make their columns, many times over
    counts = counts.where(nullify(F.col(groupby).cast("string")).isNotNull() & nullify(F.col(target).cast("string")).isNotNull())
    value = F.col("n") / F.sum("n").over(Window.partitionBy(by)) if by else F.col("n").cast("double")
    sums = counts.withColumn("value", value).groupBy(groupby, target).agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    total = lambda c: sums.groupBy(c).agg(F.sum("n").alias("_t"))
    if isinstance(sort, (list, tuple)):
        groups = df.sparkSession.createDataFrame([(i + 1, str(g)) for i, g in enumerate(sort)], "group_rank int, _g string")
        sums = sums.join(groups, F.col(groupby).cast("string") == F.col("_g")).drop("_g")
    else:
        order = [F.desc("_t"), F.col(groupby)] if sort == "count" else [F.col(groupby)]
        groups = numbered(total(groupby), order, "group_rank").select(groupby, (F.col("group_rank") + 1).cast("int").alias("group_rank"))
        sums = sums.join(groups, groupby)
    targets = numbered(total(target), [F.desc("_t"), F.col(target)], "target_rank").select(target, (F.col("target_rank") + 1).cast("int").alias("target_rank"))
    return sums.join(targets, target).select(groupby, target, "value", "group_rank", "target_rank")


def spectratype(df: DataFrame, target: str, chains=("VJ_1_junction_aa",), combine=None, fraction=False) -> DataFrame:
    """length, target, value: abundance by length of the sequences, lengths of several chains added; all lengths from 0."""
    rows = df
    for c in chains:
        rows = rows.where(F.col(c).isNotNull())
    lengths = [F.length(c) for c in chains]
    rows = rows.withColumn("length", combine(*lengths) if combine else sum(lengths[1:], lengths[0])).where(F.col(target).isNotNull())
    sums = weights(rows, fraction, target).groupBy("length", target).agg(F.sum("weight").alias("value"))
    spine = sums.agg(F.max("length").alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("length"))
    return spine.crossJoin(sums.select(target).distinct()).join(sums, ["length", target], "left").na.fill(0.0, ["value"])  # spine: lengths x targets


def vdj_segments(df: DataFrame, columns, max_segments: int | None = None, normalize=False) -> DataFrame:
    """col, segment, value: weighted use of each gene by column; beyond the first ``max_segments`` it goes to ``other``."""
    rows = weights(df, normalize, columns[0])
    long = rows.unpivot(["weight"], list(columns), "col", "segment").withColumn("segment", F.coalesce("segment", F.lit("none")))
    sums = long.groupBy("col", "segment").agg(F.sum("weight").alias("value"))
    if max_segments is not None:
        rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("value"), "segment"))
        sums = sums.withColumn("segment", F.when(rank <= max_segments, F.col("segment")).otherwise(OTHER)).groupBy("col", "segment").agg(F.sum("value").alias("value"))
    return sums


def vdj_ribbons(df: DataFrame, columns, max_ribbons: int = 20, normalize=False) -> DataFrame:
    """The most used combinations of genes: columns and value, by value, then by the columns."""
    rows = weights(df, normalize, columns[0])
    named = [F.coalesce(c, F.lit("none")).alias(c) for c in columns]
    return rows.groupBy(*named).agg(F.sum("weight").alias("value")).orderBy(F.desc("value"), *columns).limit(max_ribbons)


def motif(df: DataFrame, sequence: str, kind: str = "counts") -> DataFrame:
    """pos, letter, value of sequences of one length: counts, probability, or information in bits."""
    seen = written(df.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("seq")).agg(F.count(F.lit(1)).alias("n")), "motif")  # the only pass over the cells
    if len(seen.select(F.length("seq")).distinct().limit(2).collect()) > 1:
        raise ValueError("sequences have different lengths")
    rows = seen.select("n", F.posexplode(F.split("seq", "")).alias("pos", "letter")).where("letter <> ''")
    counts = rows.groupBy("pos", "letter").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))
    if kind == "counts":
        return counts.select("pos", "letter", F.col("n").cast("double").alias("value"))
    if kind == "probability":
        return counts.select("pos", "letter", p.alias("value"))
    if kind != "information":
        raise ValueError("kind is counts, probability or information")
    counts = counts.withColumn("p", p)
    bits = F.log2(F.lit(20.0)) + F.sum(F.col("p") * F.log2("p")).over(Window.partitionBy("pos"))
    return counts.select("pos", "letter", (F.col("p") * bits).alias("value"))


def convergence(df: DataFrame, coarse: str, fine: str) -> DataFrame:
    """Add ``is_convergent``: whether a coarse cluster holds several fine ones; null without coarse cluster."""
    found = df.where(F.col(coarse).isNotNull() & F.col(fine).isNotNull()).groupBy(coarse).agg(F.count_distinct(fine).alias("_n"))
    return df.join(found, coarse, "left").withColumn("is_convergent", F.when(F.col(coarse).isNotNull(), F.when(F.col("_n") > 1, "convergent").otherwise("not convergent"))).drop("_n")


def overlap_pairs(sizes: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n: number of clonotypes by their sizes in two groups (one column per group); (0, 0) left out."""
    return sizes.where((F.col(x) > 0) | (F.col(y) > 0)).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def kde(values: DataFrame, value: str, weight: str, bandwidth: float = 0.6, step: float = 0.1, margin: float = 3.0) -> DataFrame:
    """grid, density: a Gaussian kernel density of weighted values on a regular grid; ``values`` is a small distinct table."""
    ends = values.agg((F.min(value) - margin).alias("lo"), (F.max(value) + margin).alias("hi"))
    grid = ends.select(F.explode(F.expr(f"sequence(0, cast(ceil((hi - lo) / {step}) as int))")).alias("i"), "lo").select((F.col("lo") + F.col("i") * step).alias("grid"))
    total = values.agg(F.sum(weight).alias("total"))
    z = (F.col("grid") - F.col(value)) / bandwidth
    return grid.join(values.crossJoin(total), F.abs(F.col("grid") - F.col(value)) <= 8 * bandwidth, "left").groupBy("grid").agg(
        F.coalesce(F.sum(F.col(weight) / F.col("total") * F.exp(-z * z / 2) / (bandwidth * 2.5066282746310002)), F.lit(0.0)).alias("density"))
