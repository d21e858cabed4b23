"""Exact top-k search by inner product with ball trees.

Vectors become integers, floor(scale * x) with x as double. Candidates are dealt
over cells, that of the nearest of at most ``PIVOTS`` pivots (rows chosen by a
hash), and cells over shards of about ``shard_rows`` rows by a hash of the id.
One ball tree is built for each shard and written. Queries are answered in blocks
of ``BLOCK``: nodes are taken in the order of their upper bound q.c + |q| r, each
with the queries that it can still improve, and queries whose current k-th score
beats the bound skip the node. The k-th scores are shared: a first pass asks the
query's own shard, and the k-th score found there decides which cells' balls can
hold more; only their shards are asked, starting from that score.

Queries are a stated set of rows (here: ids divisible by ``every``). Memory of a
task: one shard's tree and one block; the driver sees a row per cell. Ties go to
smaller ids.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part; null ids neither; shorter vectors count as padded with zeros; equal rows
(id and vector) are one query, and of the rows equal to a query one is its own
and no candidate, while further copies and other rows with its id are; fewer than
k candidates are all returned; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.plans.lineage import written

LEAF, BLOCK, SHARD_ROWS, PIVOTS = 128, 512, 16_384, 1024
SCHEMA = "query_id long, query long, vec_id long, score long"
NONE = np.iinfo(np.int64).min


def usable(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long): the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * float(scale)).cast("long")).alias("v"))


class BallTree:
    """Nodes: centre, radius and children, or rows of a leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.ids, self.rows, self.leaf = ids, rows, leaf
        self.centre, self.radius, self.kids, self.own = [], [], [], []
        self.exact = np.float64 if rows.size == 0 or float(np.abs(rows).max()) ** 2 * rows.shape[1] < 2**52 else np.int64
        # the first of equal rows stands for the query itself
        order = np.lexsort((*rows.T[::-1], ids)) if rows.size else np.arange(len(ids))
        twin = np.r_[False, (ids[order][1:] == ids[order][:-1]) & (rows[order][1:] == rows[order][:-1]).all(axis=1)]
        self.first = np.ones(len(ids), dtype=bool)
        self.first[order[twin[:len(order)]]] = False
        if len(ids):
            self.build(np.arange(len(ids)))

    def build(self, at: np.ndarray) -> int:
        x = self.rows[at].astype(np.float64)
        c = x.mean(axis=0)
        far = np.sqrt(((x - c) ** 2).sum(axis=1))
        node = len(self.centre)
        self.centre.append(c)
        self.radius.append(float(far.max()))
        self.kids.append(None)
        self.own.append(at if len(at) <= self.leaf else None)
        if len(at) > self.leaf:
            a = x[far.argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            side = x @ (b - a)
            order = np.argsort(side, kind="stable")  # halves, so that depth is bounded for equal vectors too
            half = len(at) // 2
            self.kids[node] = (self.build(at[order[:half]]), self.build(at[order[half:]]))
        return node

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        ub = q @ self.centre[node] + norm * self.radius[node]
        return ub + 1e-9 * (np.abs(ub) + norm * np.linalg.norm(self.centre[node])) + 1

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray):
        """(ids, scores) of the k best per query whose score is at least kth; unused places hold the score NONE."""
        n = len(q)
        best, names = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        if not len(self.ids):
            return names, best
        qf = q.astype(np.float64)
        norm, low = np.sqrt((qf**2).sum(axis=1)), kth.astype(np.float64)
        qx = q.astype(self.exact)
        heap = [(-float(self.bound(0, qf, norm).max()), 0, np.arange(n))]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[self.bound(node, qf[who], norm[who]) >= low[who]]
            if not len(who):
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    ub = self.bound(kid, qf[who], norm[who])
                    may = ub >= low[who]
                    if may.any():
                        heapq.heappush(heap, (-float(ub[may].max()), kid, who[may]))
                continue
            at = self.own[node]
            s = (qx[who] @ self.rows[at].astype(self.exact).T).astype(np.int64)
            x, y = np.nonzero((qid[who][:, None] == self.ids[at][None, :]) & self.first[at][None, :])
            same = (q[who[x]] == self.rows[at[y]]).all(axis=1)
            s[x[same], y[same]] = NONE
            better = (s >= low[who][:, None]).any(axis=1)
            who, s = who[better], s[better]
            if not len(who):
                continue
            alls = np.concatenate([best[who], s], axis=1)
            alln = np.concatenate([names[who], np.broadcast_to(self.ids[at], s.shape)], axis=1)
            order = np.lexsort((alln, -alls.astype(np.float64) if self.exact is np.float64 else ~alls), axis=1)[:, :k]
            best[who], names[who] = np.take_along_axis(alls, order, 1), np.take_along_axis(alln, order, 1)
            full = best[who, k - 1]
            low[who] = np.maximum(low[who], np.where(full == NONE, -np.inf, full))
        return names, best


def stacked(vectors, dims: int) -> np.ndarray:
    """Arrow lists as rows of a matrix, padded with zeros."""
    x = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        own = v.values.to_numpy()
        x[i, :len(own)] = own
    return x


class Cells:
    """Pivots, the radius of the rows nearest to each, and the shards of each cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float64)
        self.square = (self.pivots**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of each row."""
        cell = np.concatenate([(self.square[None] - 2 * x[lo:lo + 4096] @ self.pivots.T).argmin(axis=1) for lo in range(0, len(x), 4096)] or [np.zeros(0, int)])
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def deal(self, counts: dict, radii: dict, shard_rows: int):
        self.shards = np.array([-(-counts.get(c, 0) // shard_rows) for c in range(len(self.pivots))])
        self.base, self.radius = np.cumsum(self.shards) - self.shards, np.array([radii.get(c, 0.0) for c in range(len(self.pivots))])
        return int(self.shards.sum())

    def shard_of(self, cell: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        return self.base[cell] + hashed % np.maximum(self.shards[cell], 1)

    def open_to(self, q: np.ndarray, kth: float) -> np.ndarray:
        """Shards whose cell's ball may hold a score of kth or more."""
        norm = float(np.sqrt((q**2).sum()))
        ub = self.pivots @ q + norm * self.radius
        ub = ub + 1e-9 * (np.abs(ub) + norm * np.sqrt(self.square)) + 1
        return np.concatenate([np.arange(self.base[c], self.base[c] + self.shards[c]) for c in np.flatnonzero((ub >= kth) & (self.shards > 0))] or [np.zeros(0, int)])


def _trees(dealt: DataFrame, dims: int, width: int) -> DataFrame:
    """dealt(shard, id, v) -> shard and its tree."""

    def run(batches):
        shard, ids, vecs = None, [], []

        def tree():
            own = BallTree(np.array(ids, dtype=np.int64), stacked(vecs, dims))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pickle.dumps(own, 5)], pa.binary())], names=["shard", "tree"])

        for b in batches:
            for s, i, v in zip(b.column("shard").to_pylist(), b.column("id").to_pylist(), b.column("v")):
                if s != shard:
                    if ids:
                        yield tree()
                    shard, ids, vecs = s, [], []
                ids.append(i)
                vecs.append(v)
        if ids:
            yield tree()

    return dealt.repartition(width, "shard").sortWithinPartitions("shard", "id").mapInArrow(run, "shard int, tree binary")


def _answers(trees: DataFrame, asked: DataFrame, k: int, dims: int, width: int) -> DataFrame:
    """Answers of the shards' trees to asked(shard, id, query, v, kth), in blocks."""

    def run(batches):
        shard = tree = None
        held = []

        def flush():
            if tree is not None and held:
                ids, names, vecs, kths = zip(*held)
                q = np.array(ids, dtype=np.int64)
                found, best = tree.search(q, stacked(vecs, dims), k, np.array([NONE if t is None else t for t in kths]))
                at = best != NONE
                n = at.sum(axis=1)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q, n), "query": np.repeat(np.array(names, dtype=np.int64), n), "vec_id": found[at], "score": best[at]})
            held.clear()

        for b in batches:
            for s, t, *row in zip(*(b.column(c) if c == "v" else b.column(c).to_pylist() for c in ("shard", "tree", "id", "query", "v", "kth"))):
                if s != shard or len(held) >= BLOCK:
                    yield from flush()
                if s != shard:
                    shard, tree = s, None
                if t is not None:
                    tree = pickle.loads(t)
                else:
                    held.append(row)
        yield from flush()

    none = {"id": "long", "query": "long", "v": "array<long>", "kth": "long"}
    rows = trees.select("shard", "tree", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).union(
        asked.select("shard", F.lit(None).cast("binary"), *none))
    return rows.repartition(width, "shard").sortWithinPartitions("shard", F.col("tree").isNull(), "id").mapInArrow(run, SCHEMA)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query (vec_id, v) with other rows of vectors (vec_id, v)."""
    spark = vectors.sparkSession
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_pivots = min(pivots, max(1, n // shard_rows))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), F.xxhash64("v")).limit(n_pivots).select("v").collect()  # at most ``pivots`` rows
    cells = Cells(np.array([list(r.v) + [0] * (dims - len(r.v)) for r in chosen] or [[0] * dims], dtype=np.int64).reshape(max(1, len(chosen)), dims))
    held = spark.sparkContext.broadcast(cells)  # at most ``pivots`` vectors

    def placed(df: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                cell, far = held.value.nearest(stacked(b.column("v"), dims).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "cell", "far"])

        rows = df.select(F.col("vec_id").alias("id"), F.xxhash64("v").alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)).alias("hashed"), "v")
        return rows.mapInArrow(run, "id long, query long, hashed long, v array<long>, cell int, far double")

    dealt = written(placed(vectors), "topk-cells")
    table = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row per pivot
    shards = cells.deal({r.cell: r.n for r in table}, {r.cell: r.far for r in table}, shard_rows)
    width = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at = F.create_map(*[F.lit(int(x)) for c in range(len(cells.base)) for x in (c, cells.base[c])])[F.col("cell")]
    size = F.create_map(*[F.lit(int(x)) for c in range(len(cells.base)) for x in (c, max(1, cells.shards[c]))])[F.col("cell")]
    home = (at + F.pmod(F.col("hashed"), size.cast("long"))).cast("int").alias("shard")
    trees = written(_trees(dealt.select(home, "id", "v"), dims, width), "topk-trees")
    asked = written(placed(queries.select("vec_id", "v").distinct()).select("id", "query", "v", home), "topk-queries")
    found = _answers(trees, asked.withColumn("kth", F.lit(None).cast("long")), k, dims, width)
    place = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        found = written(found, "topk-first")
        kth = found.withColumn("rank", F.row_number().over(place)).where(f"rank = {k}").select(F.col("query_id").alias("id"), "query", F.col("score").alias("kth"))
        table_ = spark.sparkContext.broadcast(cells)

        def route(batches):
            for b in batches:
                x = stacked(b.column("v"), dims).astype(np.float64)
                own = [table_.value.open_to(q, -np.inf if t is None else t) for q, t in zip(x, b.column("kth").to_pylist())]
                own = [o[o != s] for o, s in zip(own, b.column("shard").to_pylist())]
                take = np.repeat(np.arange(len(own)), [len(o) for o in own])
                for lo in range(0, len(take), BLOCK):
                    part = b.take(pa.array(take[lo:lo + BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)[lo:lo + BLOCK].astype(np.int32)), *(part.column(c) for c in ("id", "query", "v", "kth"))],
                                                     names=["shard", "id", "query", "v", "kth"])

        other = asked.join(kth, ["id", "query"], "left").mapInArrow(route, "shard int, id long, query long, v array<long>, kth long")
        found = found.union(_answers(trees, other, k, dims, width))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
