"""Similarity joins of receptor sequences.

Each metric gives edges (arm, seq1, seq2, dist) over distinct upper-case
sequences; both directions and the diagonal are present in a self join. Metrics
on few mismatches find candidates by equi-joins on segments (pigeonhole), so no
pair is looked at that shares no segment; scoring metrics do the same with seeds
in a reduced alphabet (``seeds.py``). Only what has no such bound (sequences with
letters outside the alphabet, alignments with gaps, own calculators) is compared
in blocks of sequences of near length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.operators.seeds import Scoring, keyed_join, of_alphabet, seeded_join
from chainweave.plans.lineage import written

#: fixed values: the public BLOSUM62 matrix, lower triangle in the order of LETTERS
LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
CUTOFFS = {"identity": 0, "levenshtein": 2, "hamming": 2, "normalized_hamming": 2, "gpu_hamming": 2, "tcrdist": 20, "alignment": 10, "fastalignment": 10}
BLOCK = 1024


def substitution_matrix(text: str = BLOSUM62, letters: str = LETTERS) -> np.ndarray:
    m = np.zeros((len(letters), len(letters)), dtype=np.int64)
    for i, row in enumerate(text.strip().splitlines()):
        for j, v in enumerate(row.split()):
            m[i, j] = m[j, i] = int(v)
    return m


def sequences(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """arm, seq: the distinct upper-case sequences of each arm's columns."""
    found = F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.upper(c).alias("seq")) for arm, cols in columns.items() for c in cols]))
    return df.select(found.alias("x")).select("x.arm", "x.seq").where("seq is not null").distinct()


def _edges(a: Column, b: Column, d: Column):
    return [F.col("arm"), a.alias("seq1"), b.alias("seq2"), d.cast("int").alias("dist")]


def identity(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    rows = left if right is None else left.join(right, ["arm", "seq"], "left_semi")
    return rows.select(*_edges(F.col("seq"), F.col("seq"), F.lit(0)))


def mismatches(a: Column, b: Column) -> Column:
    """Places that differ in two arrays of letters of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)


def _most(cutoff: int, normalized: bool) -> Column:
    """Mismatches allowed at a length."""
    if not normalized:
        return F.lit(cutoff)
    # largest m with int(100 m / length + 0.5) <= cutoff
    return F.greatest(F.ceil((cutoff + 0.5) * F.length("seq") / 100 - 1e-9).cast("int") - 1, F.lit(0))


def _strided(df: DataFrame, cutoff: int, normalized: bool) -> DataFrame:
    """One row for each of k + 1 parts of a sequence: part i holds every (k + 1)-th letter from i on.

    Receptors share their ends; parts that run through the whole sequence are all about equally rare.
    """
    k = df.withColumn("k", _most(cutoff, normalized)).withColumn("n", F.length("seq"))
    k = k.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    letters = F.filter(F.split("seq", ""), lambda x, at: at % (F.col("k") + 1) == F.col("i"))
    return k.select("arm", "seq", "n", "k", "i", F.array_join(letters, "").alias("part"))


def _segments(df: DataFrame, cutoff: int) -> DataFrame:
    """One row for each of cutoff + 1 consecutive parts of a sequence."""
    k = df.withColumn("n", F.length("seq")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cutoff))))
    a, b = F.floor(F.col("i") * F.col("n") / (cutoff + 1)), F.floor((F.col("i") + 1) * F.col("n") / (cutoff + 1))
    return k.select("arm", "seq", "n", "i", F.substring("seq", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))


def hamming(left: DataFrame, right: DataFrame | None = None, cutoff: int = 2, normalized: bool = False) -> DataFrame:
    """Mismatches of sequences of one length, or their rounded percentage."""
    square = right is None
    a = _strided(left, cutoff, normalized)
    b = _strided(left if square else right, cutoff, normalized).withColumnRenamed("seq", "seq2")
    pairs = a.join(b.drop("k"), ["arm", "n", "i", "part"])
    if square:
        pairs = pairs.where("seq < seq2")
    pairs = pairs.select("arm", "seq", "seq2", "n", "k").distinct()
    m = mismatches(F.split("seq", ""), F.split("seq2", ""))
    pairs = pairs.withColumn("m", m).where(F.col("m") <= F.col("k"))
    dist = F.floor(100 * F.col("m") / F.greatest("n", F.lit(1)) + 0.5) if normalized else F.col("m")
    return _mirror(pairs.select(*_edges(F.col("seq"), F.col("seq2"), dist)), left if square else None)


def _mirror(half: DataFrame, square: DataFrame | None) -> DataFrame:
    if square is None:
        return half
    back = half.select("arm", F.col("seq2").alias("seq1"), F.col("seq1").alias("seq2"), "dist")
    return half.union(back).union(identity(square))


def levenshtein(left: DataFrame, right: DataFrame | None = None, cutoff: int = 2) -> DataFrame:
    """Edit distance. Of cutoff + 1 segments of one sequence, one stands in the other, moved by at most the cutoff."""
    square = right is None
    other = left if square else right
    n = F.length("seq")
    held = _segments(other, cutoff).select("arm", F.col("seq").alias("seq2"), "n", "i", "part")
    probe = left.withColumn("m", n).withColumn("n", F.explode(F.sequence(F.greatest(n - cutoff, F.lit(0)), n + cutoff)))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cutoff))))
    a, b = F.floor(F.col("i") * F.col("n") / (cutoff + 1)), F.floor((F.col("i") + 1) * F.col("n") / (cutoff + 1))
    probe = probe.withColumns({"a": a.cast("int"), "w": (b - a).cast("int")}).withColumn("shift", F.explode(F.sequence(F.lit(-cutoff), F.lit(cutoff))))
    probe = probe.withColumn("at", F.col("a") + F.col("shift")).where("at >= 0 and at + w <= m").select(
        "arm", "seq", "n", "i", F.substring("seq", F.col("at") + 1, F.col("w")).alias("part")).distinct()
    pairs = probe.join(held, ["arm", "n", "i", "part"])
    if square:
        pairs = pairs.where("seq < seq2")
    pairs = pairs.select("arm", "seq", "seq2").distinct().withColumn("d", F.levenshtein("seq", "seq2", cutoff)).where("d >= 0")
    return _mirror(pairs.select(*_edges(F.col("seq"), F.col("seq2"), F.col("d"))), left if square else None)


def encode(seqs: list[str], letters: str = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with the code after the last letter, lengths)."""
    table = np.full(256, len(letters), dtype=np.int64)
    table[np.frombuffer(letters.encode(), dtype=np.uint8)] = np.arange(len(letters))
    lens = np.array([len(s) for s in seqs], dtype=np.int64)
    out = np.full((len(seqs), int(lens.max(initial=0))), len(letters), dtype=np.int64)
    for i, s in enumerate(seqs):
        out[i, :len(s)] = table[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)]
    return out, lens


Kernel = Callable[[list[str], list[str]], np.ndarray]


def block_tasks(left: DataFrame, right: DataFrame | None, len_diff: int, block: int) -> DataFrame:
    """arm, n, b, seqs, m, b2, seqs2: pairs of blocks of sequences of near length, each a task's matrix."""
    square = right is None
    sides = []
    for df in (left, left if square else right):
        sizes = df.groupBy("arm", F.length("seq").alias("n")).agg(F.count(F.lit(1)).alias("size"))
        rows = df.withColumn("n", F.length("seq")).join(sizes, ["arm", "n"])
        own = F.pmod(F.xxhash64("seq"), F.ceil(F.col("size") / block)).cast("int")
        sides.append(rows.select("arm", "n", own.alias("b"), "seq").groupBy("arm", "n", "b").agg(F.sort_array(F.collect_list("seq")).alias("seqs")))
    a = sides[0].withColumn("m", F.explode(F.sequence(F.greatest(F.col("n") - len_diff, F.lit(0)), F.col("n") + len_diff)))
    b = sides[1].select("arm", F.col("n").alias("m"), F.col("b").alias("b2"), F.col("seqs").alias("seqs2"))
    tasks = a.join(b, ["arm", "m"])
    if square:
        tasks = tasks.where("n < m or (n = m and b <= b2)")
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(width, "arm", "n", "b", "m", "b2")


def blockwise(left: DataFrame, right: DataFrame | None, kernel: Kernel, cutoff: float, len_diff: int, block: int = BLOCK) -> DataFrame:
    """Edges of all pairs within a cutoff. ``kernel`` may be a mapping of one for each arm."""
    return _mirror(in_blocks(left, right, kernel, cutoff, len_diff, block), left if right is None else None)


def in_blocks(left: DataFrame, right: DataFrame | None, kernel: Kernel, cutoff: float, len_diff: int, block: int = BLOCK) -> DataFrame:
    """The same, of one table in one direction; only pairs within the cutoff leave a task."""
    square = right is None

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = row["seqs"], row["seqs2"]
                d = (kernel[row["arm"]] if isinstance(kernel, dict) else kernel)(x, y)
                i, j = np.nonzero(d <= cutoff)
                if square and (row["n"], row["b"]) == (row["m"], row["b2"]):
                    i, j = i[i < j], j[i < j]
                yield pa.RecordBatch.from_pydict({"arm": [row["arm"]] * len(i), "seq1": [x[k] for k in i], "seq2": [y[k] for k in j],
                                                  "dist": pa.array(d[i, j].astype(np.int32), pa.int32())},
                                                 schema=pa.schema([("arm", pa.string()), ("seq1", pa.string()), ("seq2", pa.string()), ("dist", pa.int32())]))

    return block_tasks(left, right, len_diff, block).mapInArrow(run, "arm string, seq1 string, seq2 string, dist int")


def least_in_blocks(left: DataFrame, kernel: Kernel, block: int = BLOCK) -> DataFrame:
    """arm, seq, d: least distance to another sequence of its length; a task gives one row per sequence, never its pairs."""
    far = np.iinfo(np.int64).max

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = row["seqs"], row["seqs2"]
                d = kernel(x, y).astype(np.int64)
                same = (row["n"], row["b"]) == (row["m"], row["b2"])
                if same:
                    np.fill_diagonal(d, far)
                sides = [(x, d.min(axis=1, initial=far))] + ([] if same else [(y, d.min(axis=0, initial=far))])
                for seqs, low in sides:
                    at = np.flatnonzero(low < far)
                    yield pa.RecordBatch.from_pydict({"arm": [row["arm"]] * len(at), "seq": [seqs[k] for k in at], "d": pa.array(low[at].astype(np.int32), pa.int32())},
                                                     schema=pa.schema([("arm", pa.string()), ("seq", pa.string()), ("d", pa.int32())]))

    return block_tasks(left, None, 0, block).mapInArrow(run, "arm string, seq string, d int").groupBy("arm", "seq").agg(F.min("d").alias("d"))


def tcrdist_table(matrix: np.ndarray | None = None, dist_weight: int = 3, offset: int = 4, cap: int | None = 4) -> np.ndarray:
    """Cost of each substitution; a letter costs nothing against itself."""
    w = offset - (substitution_matrix() if matrix is None else matrix)
    if cap is not None:
        w = np.minimum(w, cap)
    w = w * dist_weight
    np.fill_diagonal(w, 0)
    return w


def gap_places(short: int, fixed: bool) -> list[int]:
    """Where a gap may stand, by the length of the shorter sequence."""
    if fixed:
        return [min(6, 3 + (short - 5) // 2)]
    lo, hi = 5, short - 5
    while lo > hi:
        lo, hi = lo - 1, hi + 1
    return list(range(lo, hi + 1))


def tcrdist_kernel(matrix: np.ndarray | None = None, dist_weight: int = 3, gap_penalty: int = 4, ntrim: int = 3, ctrim: int = 2,
                   fixed_gappos: bool = True, offset: int = 4, cap: int | None = 4) -> Kernel:
    """Weighted substitutions between the trimmed ends; one gap, at a fixed place or the best one; unknown letters cost nothing."""
    table = np.zeros((len(LETTERS) + 1,) * 2, dtype=np.int64)
    table[:-1, :-1] = tcrdist_table(matrix, dist_weight, offset, cap)

    def kernel(x: list[str], y: list[str]) -> np.ndarray:
        (a, la), (b, lb) = encode(x), encode(y)
        out = np.zeros((len(x), len(y)), dtype=np.int64)
        for na in np.unique(la):
            for nb in np.unique(lb):
                i, j = np.flatnonzero(la == na), np.flatnonzero(lb == nb)
                p, q = a[i][:, :na], b[j][:, :nb]
                cost = lambda u, v: table[p[:, u][:, None], q[:, v][None, :]]
                if na == nb:
                    d = sum((cost(k, k) for k in range(ntrim, na - ctrim)), np.zeros((len(i), len(j)), dtype=np.int64))
                else:
                    short = min(na, nb)
                    d = None
                    for g in gap_places(short, fixed_gappos):
                        own = sum((cost(k, k) for k in range(ntrim, g)), np.zeros((len(i), len(j)), dtype=np.int64))
                        own = own + sum((cost(na - 1 - k, nb - 1 - k) for k in range(ctrim, short - g)), np.zeros_like(own))
                        d = own if d is None else np.minimum(d, own)
                    d = d + gap_penalty * abs(int(na) - int(nb))
                out[np.ix_(i, j)] = d
        return out

    return kernel


def tcrdist_scoring(cutoff: int, matrix: np.ndarray | None = None, dist_weight: int = 3, gap_penalty: int = 4, ntrim: int = 3, ctrim: int = 2,
                    fixed_gappos: bool = True, offset: int = 4, cap: int | None = 4) -> Scoring:
    """The same distance for seeds: the letters before and behind the gap, without the trimmed ends."""
    def positions(short: int, d: int) -> list[list[tuple[int, int]]]:
        if not d:
            return [[(k, k) for k in range(ntrim, short - ctrim)]]
        return [[(k, k) for k in range(ntrim, g)] + [(short - 1 - k, short + d - 1 - k) for k in reversed(range(ctrim, short - g))] for g in gap_places(short, fixed_gappos)]

    def places(short: Column, d: Column) -> Column:
        if fixed_gappos:
            return F.array(F.least(F.lit(6), 3 + F.floor((short - 5) / 2)).cast("int"))
        near = F.sequence(F.least(F.lit(5), F.floor(short / 2).cast("int")), F.greatest(short - 5, F.ceil(short / 2).cast("int")))
        return F.when(d == 0, F.array(F.lit(0))).otherwise(near)

    def core(seq: Column, n: Column, short: Column, d: Column, g: Column) -> Column:
        piece = lambda a, b: F.substring(seq, (F.greatest(a, F.lit(0)) + 1).cast("int"), F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)).cast("int"))
        return F.when(d == 0, piece(F.lit(ntrim), n - ctrim)).otherwise(F.concat(piece(F.lit(ntrim), g), piece(n - short + g, n - ctrim)))

    return Scoring(LETTERS, [tcrdist_table(matrix, dist_weight, offset, cap).astype(np.int32)], cutoff, gap_penalty, cutoff, places, core, positions)


def read_matrix(path: str) -> np.ndarray:
    """A substitution matrix from a text file: a line of letters, then for each letter a line with it and its values, in any order of LETTERS."""
    with open(path) as f:
        rows = [line.split() for line in f if line.strip() and not line.startswith("#")]
    head, m = rows[0], np.zeros((len(LETTERS),) * 2, dtype=np.int64)
    for letter, *values in rows[1:]:
        for other, v in zip(head, values):
            if letter in LETTERS and other in LETTERS:
                m[LETTERS.index(letter), LETTERS.index(other)] = int(v)
    return m


def by_seeds(left: DataFrame, right: DataFrame | None, scorings: dict[str, Scoring] | Scoring, kernel: Kernel, cutoff: int, len_diff: int) -> DataFrame:
    """Edges by seeds; sequences with letters outside the alphabet are compared in blocks with all of near length."""
    sides = [written(x.select("arm", "seq"), "sequences") for x in ((left,) if right is None else (left, right))]
    plain, odd = zip(*((x.where(of_alphabet(LETTERS)), x.where(~of_alphabet(LETTERS))) for x in sides))
    found = seeded_join(plain[0], None if right is None else plain[1], scorings)
    some = [not x.isEmpty() for x in odd]
    if right is None:
        if some[0]:
            found = found.union(blockwise(odd[0], plain[0], kernel, cutoff, len_diff)).union(in_blocks(odd[0], None, kernel, cutoff, len_diff))
        return _mirror(found, sides[0])
    if some[0]:
        found = found.union(blockwise(odd[0], sides[1], kernel, cutoff, len_diff))
    if some[1]:
        found = found.union(blockwise(plain[0], odd[1], kernel, cutoff, len_diff))
    return found


def tcrdist(left: DataFrame, right: DataFrame | None = None, cutoff: int = 20, gap_penalty: int = 4, matrices: dict | None = None, **options) -> DataFrame:
    """``matrices``: a substitution matrix for each arm; they share the offset 1 + the largest value off their diagonals, so that no mismatch is free."""
    if matrices is None:
        kernel, scoring = tcrdist_kernel(gap_penalty=gap_penalty, **options), tcrdist_scoring(cutoff, gap_penalty=gap_penalty, **options)
        return by_seeds(left, right, scoring, kernel, cutoff, cutoff // gap_penalty)
    offset = 1 + max(int(m[~np.eye(len(m), dtype=bool)].max()) for m in matrices.values())
    options = {"offset": offset, "cap": None, "gap_penalty": gap_penalty, **options}
    kernels = {arm: tcrdist_kernel(m, **options) for arm, m in matrices.items()}
    return by_seeds(left, right, {arm: tcrdist_scoring(cutoff, m, **options) for arm, m in matrices.items()}, kernels, cutoff, cutoff // gap_penalty)


def alignment_kernel(cutoff: int, matrix: np.ndarray | None = None, gap_open: int = 11, gap_extend: int = 11, penalty: int = 0) -> Kernel:
    """min of the self scores minus the global alignment's score; pairs that the length and letter filters reject are far."""
    s = substitution_matrix() if matrix is None else matrix
    table = np.full((len(LETTERS) + 1,) * 2, -4, dtype=np.int64)
    table[:-1, :-1] = s
    far = np.iinfo(np.int32).max

    def score(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of rows of p against the same rows of q, gaps affine."""
        n, m = p.shape[1], q.shape[1]
        low = np.full(len(p), -10**6)
        gap = lambda k: -gap_open - gap_extend * (k - 1) if k else 0
        best = [np.full(len(p), gap(j)) for j in range(m + 1)]
        up = [low for _ in range(m + 1)]
        for i in range(1, n + 1):
            new, left = [np.full(len(p), gap(i))], low
            for j in range(1, m + 1):
                up[j] = np.maximum(best[j] - gap_open, up[j] - gap_extend)
                left = np.maximum(new[j - 1] - gap_open, left - gap_extend)
                new.append(np.maximum(np.maximum(best[j - 1] + table[p[:, i - 1], q[:, j - 1]], up[j]), left))
            best = new
        return best[m]

    def kernel(x: list[str], y: list[str]) -> np.ndarray:
        (a, la), (b, lb) = encode(x), encode(y)
        own = lambda c, n: np.array([table[r[:k], r[:k]].sum() for r, k in zip(c, n)], dtype=np.int64)
        sa, sb = own(a, la), own(b, lb)
        letters = lambda c, n: np.stack([(c == v).sum(axis=1) for v in range(len(LETTERS))], axis=1) if len(n) else np.zeros((0, 20))
        ca, cb = letters(a, la), letters(b, lb)
        out = np.full((len(x), len(y)), far, dtype=np.int64)
        for na in np.unique(la):
            for nb in np.unique(lb):
                gap = abs(int(na) - int(nb))
                if gap > (cutoff - gap_open) / gap_extend + 1:
                    continue
                i, j = np.flatnonzero(la == na), np.flatnonzero(lb == nb)
                ok = np.full((len(i), len(j)), gap * gap_extend <= cutoff)
                if penalty:  # letters of the longer that the shorter lacks, less the difference in length
                    longer, shorter = (ca[i], cb[j]) if na >= nb else (cb[j], ca[i])
                    more = np.maximum(longer[:, None, :] - shorter[None, :, :], 0).sum(axis=2)
                    more = more if na >= nb else more.T
                    ok &= (more - gap) * penalty + gap * gap_extend <= cutoff
                u, v = np.nonzero(ok)
                p, q = a[i[u]][:, :na], b[j[v]][:, :nb]
                if na == nb and cutoff < gap_open + gap_extend and p.size and p.max() < len(LETTERS) and q.max(initial=0) < len(LETTERS):
                    got = table[p, q].sum(axis=1)  # a gap on either side costs more than any substitutions within the cutoff
                else:
                    got = score(p, q) if len(u) else np.zeros(0, dtype=np.int64)
                out[i[u], j[v]] = np.minimum(sa[i[u]], sb[j[v]]) - got
        same = np.array(x, dtype=object)[:, None] == np.array(y, dtype=object)[None, :]
        out[same.astype(bool)] = 0
        return out

    return kernel


def alignment_scoring(cutoff: int, matrix: np.ndarray | None = None, penalty: int = 0) -> Scoring:
    """Alignments without gaps, for seeds: what each letter loses against itself, summed from either side; the lesser sum is the distance."""
    s = substitution_matrix() if matrix is None else matrix
    loss = (s.diagonal()[:, None] - s).astype(np.int32)

    def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        more = sum(np.maximum((a == v).sum(axis=0) - (b == v).sum(axis=0), 0) for v in range(len(LETTERS)))
        return more * penalty <= cutoff

    return Scoring(LETTERS, [loss, loss.T.copy()], cutoff, 0, 0, lambda short, d: F.array(F.lit(0)), lambda seq, n, short, d, g: seq, lambda short, d: [[(k, k) for k in range(short)]], keep if penalty else None)


def alignment(left: DataFrame, right: DataFrame | None = None, cutoff: int = 10, gap_open: int = 11, gap_extend: int = 11,
              penalty: int = 0, matrix: np.ndarray | None = None) -> DataFrame:
    """By seeds where no gap fits into the cutoff and no letter gains by a substitution; else in blocks."""
    most = max(0, math.floor((cutoff - gap_open) / gap_extend + 1))
    kernel, s = alignment_kernel(cutoff, matrix, gap_open, gap_extend, penalty), substitution_matrix() if matrix is None else matrix
    if most or cutoff >= gap_open + gap_extend or (s > s.diagonal()[:, None]).any():
        return blockwise(left, right, kernel, cutoff, most)
    return by_seeds(left, right, alignment_scoring(cutoff, matrix, penalty), kernel, cutoff, 0)


def fastalignment(left: DataFrame, right: DataFrame | None = None, cutoff: int = 10, penalty: int = 4, **options) -> DataFrame:
    """Alignment with a filter on letters: each unmatched letter is taken to cost ``penalty`` (4 suits BLOSUM62). It loses pairs."""
    return alignment(left, right, cutoff, penalty=penalty, **options)


class DistanceCalculator:
    """Base of own metrics: a kernel gives the matrix of two lists of sequences, ``len_diff`` bounds the lengths compared.

    A metric that can name keys of a sequence (``keys``: an array of strings, of
    ``seq``) of which a pair within the cutoff shares one is compared under these
    keys only; others compare blocks of all sequences of near length.
    """

    def __init__(self, cutoff: int | None = None, len_diff: int = 1 << 10):
        self.cutoff = 0 if cutoff is None else cutoff
        if not 0 <= self.cutoff <= 255:
            raise ValueError("cutoff is between 0 and 255")
        self.len_diff = len_diff

    def kernel(self, x: list[str], y: list[str]) -> np.ndarray:
        raise NotImplementedError

    def keys(self) -> Column | None:
        return None

    def edges(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        if self.keys() is None:
            return blockwise(left, right, self.kernel, self.cutoff, self.len_diff)
        return _mirror(keyed_join(left, right, self.keys(), self.kernel, self.cutoff, self.len_diff), left if right is None else None)


def ir_dist(left: DataFrame, right: DataFrame | None = None, metric="identity", cutoff: int | None = None, **options) -> DataFrame:
    """Edges of (arm, seq) tables by a metric's name or an own calculator; cutoff 0 is identity."""
    if isinstance(metric, DistanceCalculator):
        return metric.edges(left, right)
    if metric not in CUTOFFS:
        raise ValueError(f"no metric {metric}; there are {', '.join(CUTOFFS)}")
    cutoff = CUTOFFS[metric] if cutoff is None else cutoff
    if cutoff == 0 or metric == "identity":
        return identity(left, right)
    if metric in ("hamming", "gpu_hamming", "normalized_hamming"):
        return hamming(left, right, cutoff, metric == "normalized_hamming")
    return {"levenshtein": levenshtein, "tcrdist": tcrdist, "alignment": alignment, "fastalignment": fastalignment}[metric](left, right, cutoff, **options)


def sequence_dist(rows: DataFrame, metric="identity", cutoff: int | None = None) -> DataFrame:
    """rows(pos, seq) -> pos1, pos2, dist for all positions within the cutoff: distances are taken of distinct sequences."""
    rows = rows.withColumn("seq", F.upper("seq"))
    edges = ir_dist(rows.select(F.lit("x").alias("arm"), "seq").distinct(), None, metric, cutoff)
    return edges.join(rows.select(F.col("pos").alias("pos1"), F.col("seq").alias("seq1")), "seq1").join(
        rows.select(F.col("pos").alias("pos2"), F.col("seq").alias("seq2")), "seq2").select("pos1", "pos2", "dist")


def nearest_neighbours(left: DataFrame, normalized: bool = False) -> DataFrame:
    """arm, seq, nearest: least mismatches (or percentage) to another sequence of its length; its length (100) where it is alone."""
    def kernel(x, y):
        a, b = encode(x, LETTERS + "BZXUO*_")[0], encode(y, LETTERS + "BZXUO*_")[0]
        d = sum((a[:, k][:, None] != b[:, k][None, :] for k in range(a.shape[1])), np.zeros((len(x), len(y)), dtype=np.int64))
        return np.floor(100 * d / max(1, a.shape[1]) + 0.5).astype(np.int64) if normalized else d

    return left.join(least_in_blocks(left, kernel), ["arm", "seq"], "left").select("arm", "seq", F.coalesce("d", F.lit(100) if normalized else F.length("seq")).alias("nearest"))
