"""Alpha diversity of groups, from their counts of clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, groupby: str, target: str) -> DataFrame:
    return df.where(F.col(groupby).isNotNull() & F.col(target).isNotNull()).groupBy(groupby, target).agg(F.count(F.lit(1)).alias("n"))


def alpha_diversity(df: DataFrame, groupby: str, target: str, metric="normalized_shannon_entropy", percentage: float | None = None) -> DataFrame:
    """groupby, value. ``metric``: a name below, or a function of a group's counts (a list, descending)."""
    c = counts(df, groupby, target)
    if callable(metric):
        def run(pdf):
            pdf = pdf.sort_values("n", ascending=False)
            return pdf.iloc[:1].assign(value=float(metric(pdf["n"].tolist())))[[groupby, "value"]]

        return c.select(groupby, "n").groupBy(groupby).applyInPandas(run, f"{groupby} {dict(c.dtypes)[groupby]}, value double")
    if metric in ("D50", "DXX"):
        share = 50.0 if metric == "D50" else percentage
        if share is None:
            raise ValueError("DXX needs a percentage")
        w = Window.partitionBy(groupby).orderBy(F.desc("n"), target)
        ranked = c.withColumns({"i": F.row_number().over(w), "upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                "total": F.sum("n").over(Window.partitionBy(groupby)), "k": F.count(F.lit(1)).over(Window.partitionBy(groupby))})
        return ranked.where(F.col("upto") >= F.col("total") * (share / 100)).groupBy(groupby).agg((F.min("i") / F.max("k") * 100).alias("value"))
    total = F.sum("n").over(Window.partitionBy(groupby))
    p = c.withColumn("p", F.col("n") / total)
    entropy = F.sum(-F.col("p") * F.ln("p"))
    ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    rank = F.row_number().over(Window.partitionBy(groupby).orderBy("n", target))
    k = F.count(F.lit(1))
    values = {
        "normalized_shannon_entropy": F.when(k == 1, 0.0).otherwise(entropy / F.ln(k)),
        "shannon": entropy / F.lit(0.6931471805599453),
        "observed_otus": k.cast("double"),
        "simpson": 1 - F.sum(F.col("p") * F.col("p")),
        "berger_parker_d": F.max("p"),
        "chao1": k + ones * (ones - 1) / (2 * (twos + 1)),
        "gini_index": 2 * F.sum(F.col("rank") * F.col("p")) / k - (k + 1) / k,
    }
    if metric not in values:
        raise ValueError(f"no metric {metric}; there are {', '.join(values)}, D50, DXX and functions")
    return p.withColumn("rank", rank).groupBy(groupby).agg(values[metric].alias("value"))
