import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chainweave.operators import distances as d
from chainweave.operators import seeds


def table(spark, seqs):
    return spark.createDataFrame([("VJ", s) for s in seqs], "arm string, seq string")


def edges(df):
    return {(r.seq1, r.seq2): r.dist for r in df.collect()}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matrix():
    m = d.substitution_matrix()
    assert (m == m.T).all() and m.diagonal().min() == 4 and (m - np.diag(m.diagonal() + 9)).max() == 3


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("ACD", min_size=0, max_size=7), min_size=1, max_size=25))
def test_blocked_joins_are_brute_force(spark, seqs):
    t = table(spark, seqs)
    ham = {(a, b): sum(x != y for x, y in zip(a, b)) for a in seqs for b in seqs if len(a) == len(b)}
    assert edges(d.hamming(t, None, 2)) == {k: v for k, v in ham.items() if v <= 2}
    pct = {k: int(100 * v / len(k[0]) + 0.5) if k[0] else 0 for k, v in ham.items()}
    assert edges(d.hamming(t, None, 40, True)) == {k: v for k, v in pct.items() if v <= 40}
    both = {(a, b): lev(a, b) for a in seqs for b in seqs}
    assert edges(d.levenshtein(t, None, 2)) == {k: v for k, v in both.items() if v <= 2}


def test_two_sided(spark):
    a, b = table(spark, ["AAA", "AAC", "CCCC"]), table(spark, ["AAC", "CCC"])
    assert edges(d.ir_dist(a, b)) == {("AAC", "AAC"): 0}
    assert edges(d.ir_dist(a, b, "hamming", 1)) == {("AAA", "AAC"): 1, ("AAC", "AAC"): 0}
    assert edges(d.ir_dist(a, b, "levenshtein", 1)) == {("AAA", "AAC"): 1, ("AAC", "AAC"): 0, ("CCCC", "CCC"): 1}


def test_scores(spark):
    seqs = ["CASSLGQAYEQYF", "CASSLGQAYEQFF", "CASSPGQAYEQYF", "CASSLGAYEQYF", "AAA"]
    got = edges(d.tcrdist(table(spark, seqs)))
    assert got["CASSLGQAYEQYF", "CASSLGQAYEQFF"] == 0  # the change lies in the trimmed end
    assert got["CASSLGQAYEQYF", "CASSPGQAYEQYF"] == 12
    al = edges(d.alignment(table(spark, seqs)))
    assert al["CASSLGQAYEQYF", "CASSLGQAYEQFF"] == 3  # Y to F: 3 instead of 6 for F itself, the lesser loss
    wide = edges(d.alignment(table(spark, seqs), None, 25))
    assert ("CASSLGQAYEQYF", "CASSLGAYEQYF") in wide and ("CASSLGQAYEQYF", "CASSLGAYEQYF") not in al
    with pytest.raises(ValueError):
        d.ir_dist(table(spark, seqs), None, "other")


def test_own_metric(spark):
    class Length(d.DistanceCalculator):
        def kernel(self, x, y):
            return np.abs(np.array([len(a) for a in x])[:, None] - np.array([len(b) for b in y])[None])

    assert edges(d.ir_dist(table(spark, ["A", "CC", "DDDD"]), None, Length(1, 1))) == {("A", "A"): 0, ("CC", "CC"): 0, ("DDDD", "DDDD"): 0, ("A", "CC"): 1, ("CC", "A"): 1}


def test_nearest(spark):
    got = {r.seq: r.nearest for r in d.nearest_neighbours(table(spark, ["AAA", "AAC", "CCC", "DDDD"])).collect()}
    assert got == {"AAA": 1, "AAC": 1, "CCC": 2, "DDDD": 4}


def test_nearest_over_blocks(spark, monkeypatch):
    r = np.random.RandomState(4)
    seqs = sorted({"".join(r.choice(list("ACDE"), 6)) for _ in range(120)})
    monkeypatch.setattr(d.least_in_blocks, "__defaults__", (16,))
    got = {x.seq: x.nearest for x in d.nearest_neighbours(table(spark, seqs)).collect()}
    assert got == {s: min(sum(a != b for a, b in zip(s, t)) for t in seqs if t != s) for s in seqs}


def test_matrix_of_each_arm(spark, tmp_path):
    """A matrix read from a file; arms share one offset, so equal values cost the same in both."""
    f = tmp_path / "m.txt"
    f.write_text("# letters\n  " + " ".join(d.LETTERS) + "\n" + "\n".join(f"{x} " + " ".join("5" if x == y else "2" if {x, y} == {"L", "P"} else "0" for y in d.LETTERS) for x in d.LETTERS) + "\n")
    m = d.read_matrix(str(f))
    assert m[d.LETTERS.index("L"), d.LETTERS.index("P")] == 2 and m[0, 0] == 5
    flat = np.where(np.eye(20, dtype=bool), 5, 1)
    rows = spark.createDataFrame([(a, s) for a in ("VJ", "VDJ") for s in ("CASSLGQAYEQYF", "CASSPGQAYEQYF", "CASSWGQAYEQYF")], "arm string, seq string")
    got = {(r.arm, r.seq1[4], r.seq2[4]): r.dist for r in d.tcrdist(rows, matrices={"VJ": m, "VDJ": flat}).collect()}
    assert got["VJ", "L", "P"] == 3 and got["VJ", "L", "W"] == 9 and got["VDJ", "L", "P"] == 6


def families(seed, n, letters=d.LETTERS):
    """Sequences of up to 18 letters with copies that differ by a few substitutions and gaps."""
    r, out = np.random.RandomState(seed), set()
    while len(out) < n:
        base = list(r.choice(list(letters), r.randint(0, 17)))
        for _ in range(8):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randint(len(x) + 1)
                if r.rand() < 0.2 or at == len(x):
                    x.insert(at, r.choice(list(letters)))
                elif r.rand() < 0.2:
                    del x[at]
                else:
                    x[at] = r.choice(list(letters))
            out.add("".join(x))
    return sorted(out)


SEEDED = [
    (lambda a, b: d.tcrdist(a, b), d.tcrdist_kernel(), 20, 5),
    (lambda a, b: d.tcrdist(a, b, fixed_gappos=False), d.tcrdist_kernel(fixed_gappos=False), 20, 5),
    (lambda a, b: d.tcrdist(a, b, 40, gap_penalty=9, ntrim=1, ctrim=0), d.tcrdist_kernel(gap_penalty=9, ntrim=1, ctrim=0), 40, 4),
    (lambda a, b: d.alignment(a, b), d.alignment_kernel(10), 10, 0),
    (lambda a, b: d.fastalignment(a, b), d.alignment_kernel(10, penalty=4), 10, 0),
]


@pytest.mark.parametrize("metric", range(len(SEEDED)))
def test_seeds_lose_nothing(spark, monkeypatch, metric):
    """All pairs within the cutoff, each once, of one table and of two; full seeds are dealt into blocks; X and * are outside the alphabet."""
    seeded, kernel, cutoff, len_diff = SEEDED[metric]
    monkeypatch.setattr(seeds.seeded_join, "__defaults__", (8,))
    a = families(metric, 120) + ["CASXLGQAYE", "CASALGQAYE"]
    b = sorted({*families(metric + 50, 60), *a[:30], "CAS*LGQAYEQ"})
    for left, right in ((a, None), (a, b)):
        got = sorted((r.seq1, r.seq2, r.dist) for r in seeded(table(spark, left), right and table(spark, right)).collect())
        all_ = kernel(left, right or left)
        if right is None:
            np.fill_diagonal(all_, 0)
        want = sorted((left[i], (right or left)[j], int(all_[i, j])) for i, j in zip(*np.nonzero(all_ <= cutoff)) if abs(len(left[i]) - len((right or left)[j])) <= len_diff)
        assert got == want


def test_reduced_alphabet():
    group, least = seeds.reduced_alphabet(d.tcrdist_table(), 20)
    names = sorted("".join(x for x, g in zip(d.LETTERS, group) if g == k) for k in set(group))
    assert (least, [n for n in names if len(n) > 1]) == (9, ["DQE", "HFWY", "ILMV", "RK"])
    cost = d.tcrdist_table()
    assert cost[group[:, None] != group[None]].min() == least
    with pytest.raises(ValueError):
        seeds.reduced_alphabet(np.zeros((3, 3)), 5)


def test_few_pairs_are_compared(spark):
    """Seeds bring together a small part of all pairs."""
    r = np.random.RandomState(1)
    seqs = sorted({"CAS" + "".join(r.choice(list(d.LETTERS), 9)) + "YF" for _ in range(1500)})
    tasks = seeds._tasks(seeds._seeds(table(spark, seqs), d.tcrdist_scoring(20), None), True, seeds.BLOCK).collect()
    met = sum(len(t.x_lo) * (len(t.x_lo) - 1) // 2 if t.d == 0 else len(t.x_lo) * len(t.y_lo) for t in tasks)
    assert met < 0.02 * len(seqs) ** 2 / 2
