"""Places of a network's nodes: a size-aware force model in rounds, and packing of the components' boxes.

In a round a node is pulled along its edges and pushed by the other nodes of its
component; those are summed up by the cells of a grid over the component (each by
number, middle and mean radius, the node itself left out), so that a round is a
few shuffles of nodes and edges and one row per component, never all pairs. The
nodes of a component are held in blocks, and blocks are what is dealt. Nodes that
are all linked with one another may be given as a clique: its pairs meet in a
task, block by block, and are never written as edges.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.plans.lineage import written
from chainweave.plans.numbering import numbered

SIDE = 8  # cells along each side of a component's grid
BLOCK = 100_000  # ranks summed up by one task
NODES = 1024  # nodes in a block of a component, about
PAIRS = 1 << 20  # nodes and cells that meet at once
SMALL = 32  # nodes of a block, up to which blocks are put together
HEAT = 0.25  # how far a node may move in the first round, in square roots of its component; falls to none


def _start(seed: int, axis: str) -> Column:
    """A place between -1 and 1 by a hash, spread by the component's size."""
    share = F.pmod(F.xxhash64("ct", F.lit(axis), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (2 * share - 1) * F.sqrt("n_nodes")


def _blocks(nodes: DataFrame) -> DataFrame:
    """component, n_nodes, block, nodes (array of ct, size, x, y): a component's nodes in blocks, so that the largest one is many rows."""
    block = F.pmod(F.xxhash64("ct"), F.ceil(F.col("n_nodes") / NODES)).alias("block")
    own = nodes.groupBy("component", "n_nodes", block).agg(F.sort_array(F.collect_list(F.struct("ct", "size", "x", "y"))).alias("nodes"))
    return own.select("component", "n_nodes", "block", "nodes")


def _to_blocks(per: DataFrame) -> DataFrame:
    """A table with one row per component, and its n_nodes: that row for each block."""
    return per.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_nodes") / NODES) - 1))).drop("n_nodes")


def _push(batches):
    """ct, size, component, n_nodes, x, y of the nodes in blocks and px, py, the push of the cells of their component."""
    for batch in batches:
        nodes, cells = batch.column("nodes"), batch.column("cells")
        n, c = (v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for v in (nodes, cells))
        flat, grid = nodes.flatten(), cells.flatten()
        own, size, x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("cell", "size", "x", "y"))
        of, m, sx, sy, r = (grid.field(k).to_numpy(zero_copy_only=False) for k in ("cell", "m", "sx", "sy", "r"))
        row = np.repeat(np.arange(len(n)), n)
        first, many, root = (np.cumsum(c) - c)[row], c[row], np.sqrt(size)
        px, py = np.zeros(len(row)), np.zeros(len(row))
        ends = np.cumsum(many)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + PAIRS, side="right")))
            starts = np.cumsum(many[lo:hi]) - many[lo:hi]
            i = np.repeat(np.arange(lo, hi), many[lo:hi])
            k = np.arange(len(i)) - np.repeat(starts, many[lo:hi]) + first[i]
            same = of[k] == own[i]
            left = m[k] - same
            with np.errstate(divide="ignore", invalid="ignore"):
                dx, dy = x[i] - (sx[k] - same * x[i]) / left, y[i] - (sy[k] - same * y[i]) / left
                weight = left * (1 + 0.1 * (root[i] + r[k])) / np.maximum(dx * dx + dy * dy, 1e-9)
                for out, d in ((px, dx), (py, dy)):
                    out[lo:hi] = np.add.reduceat(np.where(left > 0, d * weight, 0.0), starts)
            lo = hi
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("component").take(take), flat.field("ct"), pa.array(size), batch.column("n_nodes").take(take),
                                          pa.array(x), pa.array(y), pa.array(px), pa.array(py)], names=["component", "ct", "size", "n_nodes", "x", "y", "px", "py"])


def _clique_pull(batches):
    """ct, fx, fy: what the nodes ``other`` of a clique pull at its nodes ``own``; a node doesn't pull at itself, its distance is 0."""
    def pull(x, y, u, v):
        dx, dy = u - x, v - y
        long = np.sqrt(dx * dx + dy * dy)
        return dx * long, dy * long

    for batch in batches:
        own, other = batch.column("own"), batch.column("other")
        n, m = (v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for v in (own, other))
        flat, there = own.flatten(), other.flatten()
        (x, y), (u, v) = ([t.field(k).to_numpy(zero_copy_only=False) for k in "xy"] for t in (flat, there))
        fx, fy = np.zeros(len(x)), np.zeros(len(x))
        first, start = np.cumsum(n) - n, np.cumsum(m) - m
        for r in np.flatnonzero(m > SMALL):
            here, far = slice(first[r], first[r] + n[r]), slice(start[r], start[r] + m[r])
            for out, d in zip((fx, fy), pull(x[here, None], y[here, None], u[None, far], v[None, far])):
                out[here] = d.sum(axis=1)
        small = np.flatnonzero(np.repeat(m <= SMALL, n))
        row = np.repeat(np.arange(len(n)), n)
        for lo in range(0, len(small), PAIRS // SMALL):
            i = small[lo:lo + PAIRS // SMALL]
            many = m[row[i]]
            ends = np.cumsum(many)
            a = np.repeat(i, many)
            b = np.arange(len(a)) - np.repeat(ends - many, many) + start[row[a]]
            for out, d in zip((fx, fy), pull(x[a], y[a], u[b], v[b])):
                out[i] = np.add.reduceat(d, ends - many)
        sign = batch.column("sign").to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([flat.field("ct"), pa.array(fx * sign), pa.array(fy * sign)], names=["ct", "fx", "fy"])


def _pulled_by_cliques(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """ct, fx, fy of members(ct, clique, sign, parts): each block of a clique meets all its blocks, in rows of their own."""
    at = members.join(nodes.select("ct", "x", "y"), "ct")
    part = F.pmod(F.xxhash64("ct"), F.col("parts")).alias("part")
    held = at.groupBy("clique", "sign", "parts", part).agg(F.sort_array(F.collect_list(F.struct("ct", "x", "y"))).alias("own"))
    alone = held.where("parts = 1").select("sign", "own", F.col("own").alias("other"))
    many = held.where("parts > 1")
    dealt = many.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = dealt.join(many.select("clique", F.col("part").alias("with"), F.col("own").alias("other")), ["clique", "with"]).select("sign", "own", "other")
    return alone.union(met).mapInArrow(_clique_pull, "ct long, fx double, fy double")


def _round(blocks: DataFrame, edges: DataFrame | None, heat: float, members: DataFrame | None = None) -> DataFrame:
    """Blocks after one round in which no node moves further than ``heat`` x sqrt(n_nodes)."""
    ends_of = [agg(f"nodes.{v}").alias(f"{v}{k}") for v in "xy" for k, agg in ((0, F.array_min), (1, F.array_max))]
    box = blocks.select("component", "n_nodes", *ends_of).groupBy("component", "n_nodes").agg(*[agg(f"{v}{k}").alias(f"{v}{k}") for v in "xy" for k, agg in ((0, F.min), (1, F.max))])
    at = lambda n, v: F.least(F.floor((n[v] - F.col(f"{v}0")) / F.greatest(F.col(f"{v}1") - F.col(f"{v}0"), F.lit(1e-9)) * SIDE), F.lit(SIDE - 1))
    cell = lambda n: (at(n, "x") * SIDE + at(n, "y")).cast("int").alias("cell")
    # blocks meet their component's box and cells by component and block: no task gets a component as a whole
    placed = blocks.join(_to_blocks(box), ["component", "block"])
    placed = placed.select("component", "n_nodes", "block", F.transform("nodes", lambda n: F.struct(n["ct"].alias("ct"), n["size"].alias("size"), n["x"].alias("x"), n["y"].alias("y"), cell(n))).alias("nodes"))
    cells = placed.select("component", "n_nodes", F.inline("nodes")).groupBy("component", "n_nodes", "cell").agg(
        F.count(F.lit(1)).alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.avg(F.sqrt("size")).alias("r"))
    cells = cells.groupBy("component", "n_nodes").agg(F.sort_array(F.collect_list(F.struct("cell", "m", "sx", "sy", "r"))).alias("cells"))  # SIDE x SIDE at most
    pushed = placed.join(_to_blocks(cells), ["component", "block"]).select("component", "n_nodes", "nodes", "cells").mapInArrow(
        _push, "component long, ct long, size double, n_nodes long, x double, y double, px double, py double")

    nodes = blocks.select(F.inline("nodes"))
    pulls = []
    if edges is not None:
        ends = edges.join(nodes.select(F.col("ct").alias("src"), F.col("x").alias("xs"), F.col("y").alias("ys")), "src").join(
            nodes.select(F.col("ct").alias("dst"), F.col("x").alias("xd"), F.col("y").alias("yd")), "dst")
        dx, dy = F.col("xs") - F.col("xd"), F.col("ys") - F.col("yd")
        long = F.sqrt(dx * dx + dy * dy)
        pulls.append(ends.select(F.col("src").alias("ct"), (-dx * long).alias("fx"), (-dy * long).alias("fy")))
    if members is not None:
        pulls.append(_pulled_by_cliques(members, nodes))
    pull = reduce(DataFrame.union, pulls).groupBy("ct").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    moved = pushed.join(pull, "ct", "left")
    moved = moved.withColumns({"sx": F.col("px") + F.coalesce("fx", F.lit(0.0)), "sy": F.col("py") + F.coalesce("fy", F.lit(0.0))})
    far = F.greatest(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")), F.lit(1e-9))
    step = F.least(far, F.sqrt("n_nodes") * heat) / far
    return _blocks(moved.select("component", "ct", "size", "n_nodes", (F.col("x") + F.col("sx") * step).alias("x"), (F.col("y") + F.col("sy") * step).alias("y")))


def running_sum(rows: DataFrame, rank: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all smaller ranks (0, 1, ...); sums of blocks of ranks first."""
    rows = rows.withColumn("_block", F.floor(F.col(rank) / BLOCK))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    base = rows.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base"))
    own = Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0.0))).join(base, "_block").withColumn(name, F.col("_base") + F.col("_own")).drop("_block", "_own", "_base")


def packed(boxes: DataFrame, packing: str = "shelves", gap: float = 1.0) -> DataFrame:
    """boxes(component, w, h) -> component, left, low: places where boxes don't overlap and lie ``gap`` apart.

    ``shelves``: boxes by falling height side by side, a new shelf wherever their
    summed widths pass a multiple of the square root of their area; a shelf is as
    high as its first box. ``grid``: one pitch for all, that of the largest box.
    """
    wide, high = F.col("w") + gap, F.col("h") + gap
    if packing == "grid":
        ranked = numbered(boxes, "component", "k")
        pitch = boxes.agg(F.greatest(F.max(wide), F.max(high)).alias("pitch"), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("side"))
        return ranked.join(F.broadcast(pitch)).select("component", (F.col("k") % F.col("side") * F.col("pitch")).alias("left"), (F.floor(F.col("k") / F.col("side")) * F.col("pitch")).alias("low"))
    if packing != "shelves":
        raise ValueError("packing: shelves, grid")
    ranked = running_sum(numbered(boxes, [F.desc("h"), F.col("component")], "k").withColumns({"wide": wide, "high": high}), "k", "wide", "before")
    width = ranked.agg(F.greatest(F.sqrt(F.sum(F.col("wide") * F.col("high"))), F.max("wide"))).first()[0]
    ranked = written(ranked.withColumn("shelf", F.floor(F.col("before") / F.lit(float(width or 1.0)))), "packed-boxes")
    shelves = ranked.groupBy("shelf").agg(F.max("high").alias("high"), F.min("before").alias("first"))
    shelves = running_sum(numbered(shelves, "shelf", "s"), "s", "high", "low")
    return ranked.join(shelves.select("shelf", "first", "low"), "shelf").select("component", (F.col("before") - F.col("first")).alias("left"), "low")


def layout(nodes: DataFrame, links_: DataFrame | None, iterations: int = 20, seed: int = 42, packing: str = "shelves", cliques: DataFrame | None = None) -> DataFrame:
    """ct, x, y of nodes(ct, component, size): each component by forces, their boxes packed.

    Nodes are joined by links_(src, dst), or by cliques(ct, clique, sign), whose
    nodes are all linked: a pair counts as often as the signs of the cliques that hold it add up to.
    """
    counts = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    rows = nodes.select("ct", "component", F.col("size").cast("double").alias("size")).join(counts, "component")
    blocks = written(_blocks(rows.select("component", "ct", "size", "n_nodes", _start(seed, "x").alias("x"), _start(seed, "y").alias("y"))), "layout")
    known, both, members = nodes.select("ct"), None, None
    if links_ is not None:
        both = links_.where("src <> dst").select("src", "dst").union(links_.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        both = written(both.join(known.withColumnRenamed("ct", "src"), "src", "left_semi").join(known.withColumnRenamed("ct", "dst"), "dst", "left_semi").select("src", "dst"), "layout-edges")
    if cliques is not None:
        own = cliques.select("ct", "clique", "sign").join(known, "ct", "left_semi")
        sizes = own.groupBy("clique").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = written(own.join(sizes, "clique").select("ct", "clique", "sign", F.ceil(F.col("n") / NODES).alias("parts")), "layout-cliques")
    for k in range(iterations):
        blocks = written(_round(blocks, both, HEAT * (1 - k / iterations), members), "layout")
    rows = blocks.select("component", F.inline("nodes"))
    box = rows.groupBy("component").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    places = packed(box.select("component", "w", "h"), packing)
    return rows.join(box, "component").join(places, "component").select("ct", (F.col("x") - F.col("x0") + F.col("left")).alias("x"), (F.col("y") - F.col("y0") + F.col("low")).alias("y"))
