"""Similarity joins under substitution costs, by seeds in a reduced alphabet.

Letters that replace each other cheaply share a group, so that a mismatch across
groups costs at least ``least``. A pair within the budget then has at most
budget / least such mismatches, and of one part more than that (part i: every
so-many-th compared letter from i on) one is equal in the reduced alphabet. Pairs
meet under such a part, an equi-join that loses nothing; the full costs decide.

Rows are shuffled once, by seed. A seed with more than ``block`` sequences on it is
dealt into blocks, and each pair of blocks is a group of its own, so no
group holds more than two blocks of each side whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.plans.lineage import written

BLOCK = 1024
PAIRS = 1 << 19  # compared side by side
SMALL = 100_000  # rows that are broadcast
KEY = ["arm", "short", "d", "flip", "place", "i", "part"]
EDGES = "arm string, seq1 string, seq2 string, dist int"


def reduced_alphabet(cost: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """(group of each letter, least cost across groups) of the grouping whose parts tell most.

    Letters cheaper than a threshold to replace are joined, transitively; of all
    thresholds the one with most bits of entropy for each letter of a part is taken.
    """
    n, best = len(cost), None
    for least in np.unique(cost[cost > 0]):
        group = np.arange(n)
        for a, b in zip(*np.nonzero(cost < least)):
            group[group == group[b]] = group[a]
        share = np.unique(group, return_counts=True)[1] / n
        bits = -(share * np.log2(share)).sum() / (budget // least + 1)
        if best is None or bits >= best[0]:
            best = bits, np.unique(group, return_inverse=True)[1], int(least)
    if best is None:
        raise ValueError("all substitutions are free")
    return best[1:]


@dataclass
class Scoring:
    """Distance of two sequences whose lengths differ by d: the least, over the gap's places and the tables, of the
    summed costs of the compared letters, and ``gap`` for each letter of the gap.

    ``places``: where the gap may stand, an array column of (the shorter length, d); ``core``: the compared letters, a
    column of (sequence, its length, the shorter length, d, place); ``positions``: for each place the same as a list of
    pairs of positions in the shorter and the longer sequence, in the order of the core.
    """

    letters: str
    tables: list[np.ndarray]
    cutoff: int
    gap: int
    longest_gap: int
    places: Callable[[Column, Column], Column]
    core: Callable[[Column, Column, Column, Column, Column], Column]
    positions: Callable[[int, int], list[list[tuple[int, int]]]]
    keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None  # of pairs within the cutoff, judged on their codes
    group: np.ndarray = field(init=False)
    least: int = field(init=False)

    def __post_init__(self):
        low = np.min(self.tables, axis=0)
        if low.min() < 0:
            raise ValueError("a substitution that costs less than none can't be sought by seeds")
        self.group, self.least = reduced_alphabet(low, self.cutoff)

    def parts(self, d: int) -> int:
        return (self.cutoff - self.gap * d) // self.least + 1

    def differences(self) -> range:
        return range(min(self.longest_gap, self.cutoff // self.gap if self.gap else self.longest_gap) + 1)

    def distance(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, places: list[list[tuple[int, int]]], d: int) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs are within the cutoff, their distances) of rows i of a and j of b, given as codes by position."""
        budget, found = self.cutoff - self.gap * d, {}
        for pairs in places:
            for table in self.tables:
                at, total = np.arange(len(i)), np.zeros(len(i), dtype=np.int32)
                for u, v in pairs:
                    total = total + table[a[u][i[at]], b[v][j[at]]]
                    stays = total <= budget
                    at, total = at[stays], total[stays]
                found.setdefault("at", []).append(at)
                found.setdefault("total", []).append(total)
        at, total = np.concatenate(found["at"]), np.concatenate(found["total"])
        order = np.lexsort((total, at))
        at, total = at[order], total[order]
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, dtype=bool)
        return at[first], total[first] + self.gap * d

    def met_before(self, a: np.ndarray, b: np.ndarray, places: list[list[tuple[int, int]]], parts: int, place: int, part: int) -> np.ndarray:
        """Which pairs (row k of a with row k of b, by position) also share an earlier seed than this one."""
        met = np.zeros(a.shape[1], dtype=bool)
        for p in range(place + 1):
            same = [self.group[a[u]] == self.group[b[v]] for u, v in places[p]]
            for q in range(part if p == place else parts):
                met |= np.logical_and.reduce(same[q::parts]) if same[q::parts] else True
        return met


def _seeds(df: DataFrame, scoring: Scoring, side: str | None) -> DataFrame:
    """A row for each seed of a sequence; ``second``: it stands on the second side of the seed's pairs."""
    names = "".join(chr(ord("a") + g) for g in scoring.group)
    roles = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(longer).alias("longer"), F.lit(scoring.parts(d)).alias("parts"))
                      for d in scoring.differences() for longer in ((False, True) if d else (False,))))
    rows = df.select("arm", "seq", F.length("seq").alias("n"), F.translate("seq", scoring.letters, names).alias("reduced"), F.explode(roles).alias("r"))
    rows = rows.select("arm", "seq", "n", "reduced", "r.*").withColumn("short", F.when(F.col("longer"), F.col("n") - F.col("d")).otherwise(F.col("n"))).where("short >= 0")
    rows = rows.select("*", F.posexplode(scoring.places(F.col("short"), F.col("d"))).alias("place", "g"))
    rows = rows.withColumn("core", scoring.core(F.col("reduced"), F.col("n"), F.col("short"), F.col("d"), F.col("g")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part, rest = F.col("core"), F.substring("core", F.col("i") + 1, F.length("core"))
    for parts in sorted({scoring.parts(d) for d in scoring.differences()} - {1}):
        part = F.when(F.col("parts") == parts, F.regexp_replace(rest, f"(.).{{0,{parts - 1}}}", "$1")).otherwise(part)
    flip = F.lit(False) if side is None else (F.col("d") > 0) & (F.col("longer") == F.lit(side == "left"))
    second = F.when(F.col("d") > 0, F.col("longer")).otherwise(F.lit(side == "right"))
    return rows.select("arm", "short", "d", flip.alias("flip"), "place", "i", part.alias("part"), second.alias("second"), "seq")


def _tasks(rows: DataFrame, square: bool, block: int) -> DataFrame:
    """A row for each seed, or pair of its blocks: the sequences of both sides in the blocks lo and hi."""
    full = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).withColumn(
        "blocks", F.ceil(F.col("size") / block).cast("int")).drop("size"), "seed-blocks")
    if full.count() <= SMALL:
        full = F.broadcast(full)
    rows = rows.join(full, KEY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*KEY, "second", "seq", "b", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"))
    pick = lambda second, end: F.collect_list(F.when((F.col("second") == second) & (F.col("b") == F.col(end)), F.col("seq")))
    upper = F.col("hi") > F.col("lo")
    made = rows.groupBy(*KEY, "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("second").alias("n2"), pick(False, "lo").alias("x_lo"), pick(True, "lo").alias("y_lo"),
        F.collect_list(F.when(~F.col("second") & upper & (F.col("b") == F.col("hi")), F.col("seq"))).alias("x_hi"),
        F.collect_list(F.when(F.col("second") & upper & (F.col("b") == F.col("hi")), F.col("seq"))).alias("y_hi"))
    both = (F.col("n2") > 0) & (F.col("n2") < F.col("n"))
    return made.where(both | ((F.col("d") == 0) & (F.col("n") > 1)) if square else both)


def _codes(column: pa.ListArray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequences, their codes by position, offsets of the lists) of a column of lists of strings of one length."""
    flat, offsets = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    raw = np.frombuffer("".join(flat.to_pylist()).encode(), dtype=np.uint8).reshape(len(flat), width)
    return flat, np.ascontiguousarray(table[raw].T), offsets


def _verify(batches, scorings: dict[str, Scoring] | Scoring, square: bool):
    for batch in batches:
        names = [np.array(batch.column(c).to_pylist(), dtype=object) for c in ("arm", "short", "d", "flip", "place", "i")]
        kinds: dict[tuple, list[int]] = {}
        for row, kind in enumerate(zip(*names)):
            kinds.setdefault(kind, []).append(row)
        for (arm, short, d, flip, place, i), rows in kinds.items():
            scoring = scorings[arm] if isinstance(scorings, dict) else scorings
            code = np.zeros(256, dtype=np.uint8)
            code[np.frombuffer(scoring.letters.encode(), dtype=np.uint8)] = np.arange(len(scoring.letters))
            part = batch.take(pa.array(rows))
            lists = {c: _codes(part.column(c), short + (d if c[0] == "y" else 0), code) for c in ("x_lo", "x_hi", "y_lo", "y_hi")}
            alone = (np.array(part.column("lo").to_pylist()) == np.array(part.column("hi").to_pylist()))
            if square and d == 0:
                meets = [("x_lo", "x_lo", alone, True), ("x_lo", "x_hi", ~alone, False)]
            else:
                meets = [("x_lo", "y_lo", alone, False), ("x_lo", "y_hi", ~alone, False), ("x_hi", "y_lo", ~alone, False)]
            places, parts = scoring.positions(short, d), scoring.parts(d)
            for left, right, which, half in meets:
                (seqs1, a, off1), (seqs2, b, off2) = lists[left], lists[right]
                for p, q in _pairs(off1, off2, which, half):
                    at, dist = scoring.distance(a, b, p, q, places, d)
                    p, q = p[at], q[at]
                    own, others = a[:, p], b[:, q]
                    new = ~scoring.met_before(own, others, places, parts, place, i)
                    if scoring.keep is not None:
                        new &= scoring.keep(own, others)
                    if not new.any():
                        continue
                    one, two = seqs1.take(pa.array(p[new])), seqs2.take(pa.array(q[new]))
                    if flip:
                        one, two = two, one
                    yield pa.RecordBatch.from_arrays([pa.array([arm] * int(new.sum()), pa.string()), one, two, pa.array(dist[new].astype(np.int32))],
                                                     names=["arm", "seq1", "seq2", "dist"])


def _pairs(off1: np.ndarray, off2: np.ndarray, which: np.ndarray, half: bool):
    """Index pairs of the lists of the chosen rows, ``PAIRS`` at a time; ``half``: of one list with itself, each pair once."""
    n1, n2 = np.diff(off1) * which, np.diff(off2) * which
    ends = np.cumsum(n1 * n2)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, PAIRS):
        k = np.arange(lo, min(total, lo + PAIRS))
        row = np.searchsorted(ends, k, side="right")
        k = k - (ends[row] - n1[row] * n2[row])
        i, j = k // n2[row], k % n2[row]
        if half:
            row, i, j = row[i < j], i[i < j], j[i < j]
        yield off1[row] + i, off2[row] + j


def seeded_join(left: DataFrame, right: DataFrame | None, scorings: dict[str, Scoring] | Scoring, block: int = BLOCK) -> DataFrame:
    """arm, seq1, seq2, dist: pairs of (arm, seq) rows within the cutoff, each once; of one table: different sequences, in one direction.

    All letters must belong to the alphabet. Sequences of ``scorings`` given by arm are compared by their arm's.
    """
    square, rows = right is None, None
    for side, df in ((None, left),) if square else (("left", left), ("right", right)):
        for arm, scoring in scorings.items() if isinstance(scorings, dict) else [(None, scorings)]:
            own = _seeds(df if arm is None else df.where(F.col("arm") == arm), scoring, side)
            rows = own if rows is None else rows.union(own)
    return _tasks(rows, square, block).mapInArrow(lambda batches: _verify(batches, scorings, square), EDGES)


def of_alphabet(letters: str) -> Column:
    return ~F.col("seq").rlike(f"[^{letters}]")



def keyed_join(left: DataFrame, right: DataFrame | None, keys: Column, kernel: Callable, cutoff: int, len_diff: int, block: int = BLOCK) -> DataFrame:
    """arm, seq1, seq2, dist: the pairs within the cutoff among those that share one of ``keys``; of one table in one direction."""
    square, rows = right is None, None
    for df, second in ((left, False),) if square else ((left, False), (right, True)):
        own = df.select("arm", F.lit(0).alias("short"), F.lit(0).alias("d"), F.lit(False).alias("flip"), F.lit(0).alias("place"), F.lit(0).alias("i"),
                        F.explode(F.array_distinct(keys)).alias("part"), F.lit(second).alias("second"), "seq")
        rows = own if rows is None else rows.union(own)

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                alone = t["lo"] == t["hi"]
                if square:
                    meets = [(t["x_lo"], t["x_lo"])] if alone else [(t["x_lo"], t["x_hi"])]
                else:
                    meets = [(t["x_lo"], t["y_lo"])] if alone else [(t["x_lo"], t["y_hi"]), (t["x_hi"], t["y_lo"])]
                for x, y in meets:
                    if not x or not y:
                        continue
                    d = kernel(x, y)
                    i, j = np.nonzero(d <= cutoff)
                    if square and alone:
                        i, j = i[i < j], j[i < j]
                    near = np.array([abs(len(x[p]) - len(y[q])) <= len_diff for p, q in zip(i, j)], dtype=bool)
                    one, two = ([s[k] for k in at[near]] for s, at in ((x, i), (y, j)))
                    if square:
                        one, two = [min(p) for p in zip(one, two)], [max(p) for p in zip(one, two)]
                    yield pa.RecordBatch.from_arrays([pa.array([t["arm"]] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(two, pa.string()),
                                                      pa.array(d[i, j][near].astype(np.int32))], names=["arm", "seq1", "seq2", "dist"])

    return _tasks(rows, square, block).mapInArrow(run, EDGES).distinct()  # a pair may share several keys
