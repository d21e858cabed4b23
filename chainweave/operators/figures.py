"""Tables behind the figures: network nodes and edges, node averages and shares, modularity, top imbalanced clonotypes, gene labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions.sequences import LOCUS_ORDER
from chainweave.plans.lineage import cut


def gene_label(gene: Column) -> Column:
    """A gene's name without its locus."""
    return F.regexp_replace(gene, "|".join(LOCUS_ORDER), "")


def node_means(members: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """ct, value: mean of a number over the cells of each node; members(ct, cell_id), values(cell_id, column)."""
    return members.join(values.select("cell_id", column), "cell_id").groupBy("ct").agg(F.avg(column).alias("value"))


def node_shares(members: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """ct, category, share: shares of the categories among the cells of each node; a missing one is ``nan``."""
    rows = members.join(values.select("cell_id", F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("category")), "cell_id")
    counts = rows.groupBy("ct", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("ct", "category", (F.col("n") / F.sum("n").over(Window.partitionBy("ct"))).alias("share"))


def network_tables(coordinates: DataFrame, members: DataFrame, labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: ct, label, x, y, size, the y axis turned over; edges: src, dst between them).

    coordinates(ct, x, y), members(ct, cell_id), labels(cell_id, label), links(src, dst).
    """
    cells = members.join(labels.select("cell_id", "label"), "cell_id").where("label is not null")
    sizes = cells.groupBy("ct", "label").agg(F.count(F.lit(1)).alias("size"))
    top = coordinates.agg(F.max("y").alias("top"))
    nodes = coordinates.join(sizes, "ct").crossJoin(top).select("ct", "label", "x", (F.col("top") - F.col("y")).alias("y"), "size")  # top is one row
    own = nodes.select("ct").distinct()
    edges = links.select("src", "dst").join(own.withColumnRenamed("ct", "src"), "src", "left_semi").join(own.withColumnRenamed("ct", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst")


def modularity_table(scores: DataFrame, p_value: str = "fdr", quantiles: tuple[float, float] = (0.9, 0.9)) -> DataFrame:
    """label, size, score, log_p, shown: whether a label stands at or above both quantiles of the distinct scores and distinct log_p."""
    rows = scores.select("label", "size", "score", (-F.log10(p_value)).alias("log_p"))
    q = lambda c, share: rows.select(c).distinct().agg(F.percentile(c, F.lit(share)).alias(f"q_{c}"))
    ends = q("score", quantiles[0]).crossJoin(q("log_p", quantiles[1]))  # one row
    return rows.crossJoin(ends).select("label", "size", "score", "log_p", ((F.col("score") >= F.col("q_score")) & (F.col("log_p") >= F.col("q_log_p"))).alias("shown"))


def top_imbalance(stats: DataFrame, abundance: DataFrame, target: str, top_n: int = 10) -> DataFrame:
    """hue, side, replicate, target, abundance of the ``top_n`` targets of least p (ties by target); 0 where a replicate lacks one."""
    best = stats.groupBy(target).agg(F.min("p_value").alias("p")).orderBy("p", target).limit(top_n).select(target)
    best = cut(best)  # top_n rows, used for the grid and to read no other target's abundance
    rows = abundance.join(F.broadcast(best), target, "left_semi").groupBy("hue", "side", "replicate", target).agg(F.avg("abundance").alias("abundance"))
    grid = abundance.select("hue", "side", "replicate").distinct().crossJoin(best)  # replicates x top_n
    return grid.join(rows, ["hue", "side", "replicate", target], "left").na.fill(0.0, ["abundance"])
