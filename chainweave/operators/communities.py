"""Communities of a weighted graph as rounds over its edge table.

``leiden``: nodes move to the neighbouring community of largest gain, the
communities found are refined from single nodes, the graph is contracted to the
refined parts and the same is done there. ``fastgreedy``: pairs of communities
merge, best gain first, until no merge gains.

Both maximise modularity. A round is a few shuffles of the edge table, and
no community, component or neighbourhood is ever held in one task. Weights are
integers, so that sums don't depend on the order of rows and reruns agree.

A graph is given by its edges or by cliques: sets of nodes that are all linked.
Weights to communities are sums over cliques then (nodes of the clique in it), so
that a node costs as much as it has cliques, however many neighbours it has.

Edges are (src, dst, weight), each pair once; loops and edges without both ends
or a positive weight are left out. Nodes without an edge don't appear in
results. No edges: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.plans.components import connected_components
from chainweave.plans.lineage import written

MOVES, REFINES, LEVELS = 16, 4, 12  # rounds of moves and of refinement in a level, levels in an iteration: bounds that stop the last small gains
MERGES = 10_000  # rounds of merges, against endless loops: each merges at least one pair


def cut(df: DataFrame) -> DataFrame:
    """Written and read again: the next round's plan starts from a table, and knows its size."""
    return written(df, "communities")


def _both_ways(edges: DataFrame) -> DataFrame:
    whole = edges.where((F.col("src") != F.col("dst")) & (F.col("weight") > 0)).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("long").alias("w"))
    once = whole.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return cut(once.union(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))


def _ends(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(src, dst, w) with a and b, the labels of both ends."""
    return rows.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")


class _Edges:
    """A graph by its edges, both ways: src, dst, w."""

    def __init__(self, both: DataFrame):
        self.both = both

    def strengths(self) -> DataFrame:
        return self.both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("strength"))

    def near(self, labels: DataFrame) -> DataFrame:
        """node, label, w: each node's weight to each label it is linked to."""
        return self.both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("w"))

    def leaving(self, labels: DataFrame) -> int:
        return _ends(self.both, labels).where("a <> b").agg(F.sum("w")).first()[0] or 0

    def inside(self, labels: DataFrame) -> _Edges:
        return _Edges(cut(_ends(self.both, labels).where("a = b").select("src", "dst", "w")))

    def contracted(self, into: DataFrame) -> _Edges:
        """Nodes are the labels of ``into``."""
        return _Edges(cut(_ends(self.both, into).where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))))

    def starts(self, labels: DataFrame) -> DataFrame:
        """labels(node, strength, label) to move from: single nodes."""
        return cut(labels.select("node", "strength", F.col("node").alias("label")))

    def pairs(self) -> DataFrame:
        """src, dst, w: each pair once."""
        return self.both.where("src < dst")

    def held_together(self) -> DataFrame:
        """src, dst that connect what is connected."""
        return cut(self.both.select("src", "dst"))


class _Cliques:
    """A graph by rows(clique, part, sign, node, n): nodes u and v are linked by the sum of sign x n_u x n_v over the cliques that hold both."""

    def __init__(self, rows: DataFrame, single: bool = True):
        several = rows.groupBy("clique", "part").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("clique", "part")
        self.rows, self.single = cut(rows.join(several, ["clique", "part"])), single  # a clique of one node links nothing

    def strengths(self) -> DataFrame:
        return self.near(self.rows.select("node").distinct().withColumn("label", F.lit(-1).cast("long"))).select("node", F.col("w").alias("strength"))

    def _labelled(self, labels: DataFrame) -> DataFrame:
        return self.rows.join(labels.select("node", "label"), "node")

    def near(self, labels: DataFrame) -> DataFrame:
        own = self._labelled(labels).withColumnRenamed("label", "own")
        held = own.groupBy("clique", "part", F.col("own").alias("label")).agg(F.sum("n").alias("held"))
        met = own.join(held, ["clique", "part"])
        w = F.col("sign") * F.col("n") * (F.col("held") - F.when(F.col("own") == F.col("label"), F.col("n")).otherwise(0))
        return met.groupBy("node", "label").agg(F.sum(w).alias("w")).where("w > 0")

    def leaving(self, labels: DataFrame) -> int:
        held = self._labelled(labels).groupBy("clique", "part", "label").agg(F.max("sign").alias("sign"), F.sum("n").alias("held"))
        square = lambda c: F.col(c).cast("decimal(19,0)") * F.col(c)
        per = held.groupBy("clique", "part").agg(F.max("sign").alias("sign"), F.sum("held").alias("whole"), F.sum(square("held")).alias("squares"))
        return int(per.agg(F.sum(F.col("sign") * (square("whole") - F.col("squares")))).first()[0] or 0)

    def inside(self, labels: DataFrame) -> _Cliques:
        return _Cliques(self._labelled(labels).select("clique", F.col("label").alias("part"), "sign", "node", "n"), self.single)

    def contracted(self, into: DataFrame) -> _Cliques:
        return _Cliques(self._labelled(into).groupBy("clique", "part", "sign", F.col("label").alias("node")).agg(F.sum("n").alias("n")), False)

    def starts(self, labels: DataFrame) -> DataFrame:
        """Single nodes go to their largest clique, by the smallest node that does; what was contracted starts alone."""
        if not self.single:
            return cut(labels.select("node", "strength", F.col("node").alias("label")))
        sizes = self.rows.where("sign > 0").groupBy("clique", "part").agg(F.count(F.lit(1)).alias("size"))
        best = self.rows.where("sign > 0").join(sizes, ["clique", "part"]).groupBy("node").agg(F.max(F.struct("size", F.xxhash64("clique").alias("tie"), "clique", "part")).alias("best"))
        best = cut(best.select("node", "best.clique", "best.part"))
        first = best.groupBy("clique", "part").agg(F.min("node").alias("first"))
        named = best.join(first, ["clique", "part"]).select("node", "first")
        return cut(labels.join(named, "node", "left").select("node", "strength", F.coalesce("first", "node").alias("label")))

    def pairs(self) -> DataFrame:
        a, b = (self.rows.select("clique", "part", "sign", F.col("node").alias(end), F.col("n").alias(f"n_{end}")) for end in ("src", "dst"))
        met = a.join(b.drop("sign"), ["clique", "part"]).where("src < dst")
        return met.groupBy("src", "dst").agg(F.sum(F.col("sign") * F.col("n_src") * F.col("n_dst")).alias("w")).where("w > 0")

    def held_together(self) -> DataFrame:
        first = self.rows.where("sign > 0").groupBy("clique", "part").agg(F.min("node").alias("dst"))
        return self.rows.where("sign > 0").join(first, ["clique", "part"]).where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()


def _clique_graph(rows: DataFrame) -> _Cliques:
    """Of rows(node, clique, sign)."""
    return _Cliques(rows.select("clique", F.lit(0).cast("long").alias("part"), F.col("sign").cast("long").alias("sign"), "node", F.lit(1).cast("long").alias("n")))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels(node, community) over edges(src, dst, weight)."""
    graph = _Edges(_both_ways(edges))
    return _quality(graph, graph.strengths().join(labels.select("node", F.col("community").alias("label")), "node"), resolution)


def _quality(graph: _Edges | _Cliques, labels: DataFrame, resolution: float) -> float:
    """labels(node, strength, label); strengths may hold what was contracted, inner weights are counted by ``strength`` less what leaves."""
    total = labels.agg(F.sum("strength")).first()[0] or 0
    if not total:
        return 0.0
    held = labels.groupBy("label").agg(F.sum("strength").alias("k"))
    squares = held.agg(F.sum((F.col("k") / total) ** 2)).first()[0]
    return (total - graph.leaving(labels)) / total - resolution * squares


def _move(graph: _Edges | _Cliques, nodes: DataFrame, total: int, resolution: float, rounds: int = MOVES) -> DataFrame:
    """nodes(node, strength, label) with the labels that ``rounds`` of moves give.

    Communities are ordered by a hash; in one round nodes only go up this order,
    in the next only down, so that no two communities swap. A node goes where its gain
    is largest and larger than staying; the gain is weight to the community
    less resolution x strength x the community's strength / total.
    """
    labels = nodes
    for r in range(rounds):
        held = labels.groupBy("label").agg(F.sum("strength").alias("held"))
        near = graph.near(labels)
        own = labels.join(held.withColumnRenamed("held", "own_held"), "label").select("node", "strength", F.col("label").alias("own"), "own_held")
        some = near.join(own, "node").join(held, "label")
        ahead = F.xxhash64("label", F.lit(r // 2)) > F.xxhash64("own", F.lit(r // 2))
        gain = F.col("w") * F.lit(float(total)) - F.lit(resolution) * F.col("strength") * (F.col("held") - F.when(F.col("label") == F.col("own"), F.col("strength")).otherwise(0))
        some = some.withColumn("gain", gain)
        stay = F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))),
                          F.first(-F.lit(resolution) * F.col("strength") * (F.col("own_held") - F.col("strength"))))
        to = F.max(F.when((F.col("label") != F.col("own")) & (ahead == F.lit(r % 2 == 0)), F.struct("gain", F.xxhash64("label", F.lit(r)).alias("tie"), "label")))
        wish = F.max(F.when(F.col("label") != F.col("own"), F.col("gain")))
        best = some.groupBy("node").agg(stay.alias("stay"), to.alias("to"), wish.alias("wish")).where("wish > stay")
        moved = best.select("node", F.when(F.col("to.gain") > F.col("stay"), F.col("to.label")).alias("new"), F.lit(True).alias("wants"))
        labels = cut(labels.join(moved, "node", "left").select("node", "strength", F.coalesce("new", "label").alias("label"), F.coalesce("wants", F.lit(False)).alias("wants")))
        done = labels.where("wants").isEmpty()
        labels = labels.drop("wants")
        if done:
            break
    return labels


def _named(labels: DataFrame) -> DataFrame:
    """node, community: the smallest node of each label."""
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("community")), "label").select("node", "community")


def leiden(edges: DataFrame, resolution: float = 1.0, iterations: int = 1) -> DataFrame:
    """node, community (its smallest node): all communities are connected. Stops early where an iteration gains nothing."""
    return _leiden(_Edges(_both_ways(edges)), resolution, iterations)


def leiden_of_cliques(rows: DataFrame, resolution: float = 1.0, iterations: int = 1) -> DataFrame:
    """The same for rows(node, clique, sign): for two nodes the signs of the cliques that hold both add up to the weight of their edge, 0 or more.

    Single nodes, of the graph and of a community that is refined, start with
    their largest clique (all linked with one another) and move from there.
    """
    return _leiden(_clique_graph(rows), resolution, iterations)


def _leiden(graph: _Edges | _Cliques, resolution: float, iterations: int) -> DataFrame:
    nodes = cut(graph.strengths())
    total = nodes.agg(F.sum("strength")).first()[0] or 0
    found, best = graph.starts(nodes), None
    for _ in range(max(1, iterations)):
        found = _iteration(graph, found, total, resolution)
        quality = _quality(graph, found, resolution)
        if best is not None and quality <= best[0] + 1e-9:
            break
        best = quality, found
    # a community of several parts is split into them, which never loses
    parts = connected_components(graph.inside(best[1]).held_together())
    return nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def _iteration(graph: _Edges | _Cliques, start: DataFrame, total: int, resolution: float) -> DataFrame:
    """One pass of moves, refinement and contraction from the labels of ``start`` (node, strength, label)."""
    place = start.select("node", F.col("node").alias("at"))  # the contracted node that holds each node
    labels = start
    for _ in range(LEVELS):
        labels = _move(graph, labels, total, resolution)
        size, kinds = labels.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
        if kinds == size:
            break
        label = labels.select("node", "label")
        inside = graph.inside(label)
        parts = _move(inside, inside.starts(labels), total, resolution, REFINES)
        parts = cut(parts.select("node", F.col("label").alias("part")).join(label, "node"))
        if parts.agg(F.countDistinct("part")).first()[0] == size:  # no refinement gains: contract to the communities
            parts = parts.select("node", F.col("label").alias("part"), "label")
        into = parts.select("node", "part")
        labels = cut(labels.drop("label").join(parts, "node").groupBy("part").agg(F.sum("strength").alias("strength"), F.min("label").alias("label")).withColumnRenamed("part", "node"))
        graph = graph.contracted(into.withColumnRenamed("part", "label"))
        place = cut(place.join(into.withColumnRenamed("node", "at"), "at").select("node", F.col("part").alias("at")))
    final = place.join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", "label")
    return cut(start.select("node", "strength").join(final, "node"))


def fastgreedy(edges: DataFrame) -> DataFrame:
    """node, community (its smallest node), by agglomeration.

    A merge of i and j gains e_ij - k_i k_j / total. In a round each pair that is
    the best of both its communities merges, the best of all among them; of equal
    gains a hash of pair and round decides, so that many of a clique's pairs merge
    at once. What merges is contracted. Ends where no merge gains.
    """
    graph = _Edges(_both_ways(edges))
    nodes = cut(graph.strengths())
    return _agglomerated(nodes.select("node", F.col("node").alias("at")), graph.pairs(), nodes)


def fastgreedy_of_cliques(rows: DataFrame) -> DataFrame:
    """The same for rows(node, clique, sign) as ``leiden_of_cliques`` takes them.

    Nodes of one clique merge first, each with those of its largest one, where
    that gains; the pairs of what has merged so are the edges of the rounds.
    """
    graph = _clique_graph(rows)
    nodes = cut(graph.strengths())
    total = nodes.agg(F.sum("strength")).first()[0] or 0
    k = F.col("strength").cast("double")
    start = graph.starts(nodes)
    # all pairs of a clique have weight 1: its nodes' merges gain n (n - 1) / 2 x total less the sum of k_i k_j
    sums = start.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"), F.sum(k * k).alias("k2"))
    gains = sums.select("label", (F.col("n") * (F.col("n") - 1) * F.lit(float(total)) > F.col("k") * F.col("k") - F.col("k2")).alias("gains"))
    place = cut(start.join(gains, "label").select("node", "strength", F.when(F.col("gains"), F.col("label")).otherwise(F.col("node")).alias("at")))
    held = cut(place.groupBy(F.col("at").alias("node")).agg(F.sum("strength").alias("strength")))
    pairs = graph.contracted(place.select("node", F.col("at").alias("label"))).pairs()
    return _agglomerated(place.select("node", "at"), cut(pairs), held)


def _agglomerated(place: DataFrame, graph: DataFrame, held: DataFrame) -> DataFrame:
    """node, community from place(node, at: what it is part of), graph(src, dst, w: pairs of these) and held(node, strength) by rounds of merges."""
    total = held.agg(F.sum("strength")).first()[0] or 0
    for r in range(MERGES):
        ends = graph.join(held.select(F.col("node").alias("src"), F.col("strength").alias("k1")), "src").join(held.select(F.col("node").alias("dst"), F.col("strength").alias("k2")), "dst")
        gain = F.col("w") * F.lit(float(total)) - F.col("k1") * F.col("k2").cast("double")
        pairs = ends.select("src", "dst", gain.alias("gain"), F.xxhash64("src", "dst", F.lit(r)).alias("tie")).where("gain > 0")
        each = pairs.select(F.explode(F.array("src", "dst")).alias("node"), F.struct("gain", "tie", "src", "dst").alias("pair"))
        chosen = each.groupBy("node").agg(F.max("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merged = cut(chosen.select(F.col("pair.dst").alias("node"), F.col("pair.src").alias("into")))
        if merged.isEmpty():
            break
        into = lambda df, c: df.join(merged.select(F.col("node").alias(c), "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        place = cut(into(place, "at"))
        held = cut(into(held, "node").groupBy("node").agg(F.sum("strength").alias("strength")))
        moved = into(into(graph, "src"), "dst").where("src <> dst")
        graph = cut(moved.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w")).select(
            F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
    return _named(place.select("node", F.col("at").alias("label")))
