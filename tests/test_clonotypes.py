import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chainweave.operators import clonotypes as ct

FIELDS = [f"{a}_{n}_{k}" for a in ("VJ", "VDJ") for n in (1, 2) for k in ("junction_aa", "junction", "v_call", "j_call")]


def wide(spark, rows):
    """rows: cell -> (VJ_1, VJ_2, VDJ_1, VDJ_2) sequences"""
    data = []
    for i, (cell, s) in enumerate(rows.items()):
        vals = [x for q in s for x in (q, q, q and f"V{q[1]}", q and "J")]
        data.append((cell, i, any(s), "TCR", *vals))
    return spark.createDataFrame(data, "cell_id string, cell_ord long, has_ir boolean, receptor_type string, " + ", ".join(f"{f} string" for f in FIELDS))


def random_cells(seed, n=40):
    r = random.Random(seed)
    seqs = ["CSRF", "CSQF", "CTQF", "CGGW", "CPLYW", "CPLHW"]
    out = {}
    for i in range(n):
        one = [r.choice(seqs) if r.random() < 0.8 else None for _ in range(2)]
        two = [r.choice(seqs) if first and r.random() < 0.4 else None for first in one]
        out[f"cell{i:02d}"] = (one[0], two[0], one[1], two[1])
    return out


def gap(a, b, cutoff, gene):
    """Mismatches of two chains, None beyond the cutoff."""
    if a is None or b is None or len(a) != len(b) or gene and a[1] != b[1]:
        return None
    d = sum(x != y for x, y in zip(a, b))
    return d if d <= cutoff else None


def arm_gap(p, q, dual, cutoff, gene):
    d = lambda x, y: gap(p[x], q[y], cutoff, gene)
    if dual == "primary_only":
        return d(0, 0)
    if dual == "any":
        return min((v for x in (0, 1) for y in (0, 1) if (v := d(x, y)) is not None), default=None)
    if (p[1] is None) != (q[1] is None):
        return None
    if p[1] is None:
        return d(0, 0)
    both = [max(v) for v in ((d(0, 0), d(1, 1)), (d(1, 0), d(0, 1))) if None not in v]
    return min(both, default=None)


def linked(p, q, arms, dual, cutoff, gene):
    found = [arm_gap(p[k:k + 2], q[k:k + 2], dual, cutoff, gene) for k in {"VJ": (0,), "VDJ": (2,)}.get(arms, (0, 2))]
    if arms != "all":
        return any(v is not None for v in found)
    have = [[x[k] is not None for k in (0, 2)] for x in (p, q)]
    if sum(have[0]) != sum(have[1]):
        return False
    return all(v is not None for v in found) if sum(have[0]) == 2 else any(v is not None for v in found)


def expected(cells, receptor_arms="all", dual_ir="any", cutoff=0, gene=False):
    columns = [k for k in range(4) if (receptor_arms in ("all", "any") or (k < 2) == (receptor_arms == "VJ")) and (dual_ir != "primary_only" or k % 2 == 0)]
    own = {c: tuple(s[k] if k in columns else None for k in range(4)) for c, s in cells.items()}
    own = {c: s for c, s in own.items() if any(s)}
    root = {c: c for c in own}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in combinations(own, 2):
        if own[a] == own[b] or linked(own[a], own[b], receptor_arms, dual_ir, cutoff, gene):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = {}
    for c in own:
        out.setdefault(find(c), []).append(c)
    return sorted(out.values())


def clusters(df):
    return {r.cell_id: r.cluster_id for r in df.collect()}


def groups(df):
    out = {}
    for c, k in clusters(df).items():
        out.setdefault(k, set()).add(c)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("arms", ["all", "any", "VJ", "VDJ"])
@pytest.mark.parametrize("dual", ["any", "all", "primary_only"])
def test_clusters_are_brute_force(spark, arms, dual):
    cells = random_cells(len(arms) + len(dual))
    df = wide(spark, cells)
    assert groups(ct.define_clonotype_clusters(df, receptor_arms=arms, dual_ir=dual)) == expected(cells, arms, dual)


@pytest.mark.parametrize("options", [{"receptor_arms": "all", "dual_ir": "any"}, {"receptor_arms": "VJ", "dual_ir": "all"}])
def test_clusters_within_a_cutoff(spark, options):
    cells = random_cells(11)
    df = wide(spark, cells)
    assert groups(ct.define_clonotype_clusters(df, metric="hamming", cutoff=1, **options)) == expected(cells, cutoff=1, **options)
    same = {"receptor_arms": options["receptor_arms"], "dual_ir": "any"}
    assert groups(ct.define_clonotype_clusters(df, metric="hamming", cutoff=1, same_v_gene=True, **same)) == expected(cells, cutoff=1, gene=True, **same)


def test_numbers_follow_the_first_cell(spark):
    cells = {"p": ("CSRF", None, "CGGW", None), "q": ("CTQF", None, None, None), "r": ("CSRF", None, "CGGW", None), "s": (None,) * 4, "t": (None, None, "CPLYW", None)}
    got = clusters(ct.define_clonotypes(wide(spark, cells), receptor_arms="all", dual_ir="primary_only"))
    assert got == {"p": "0", "q": "1", "r": "0", "t": "2"}


def test_query_and_annotation(spark):
    cells = wide(spark, {"p": ("CSRF", None, "CGGW", None), "q": ("CPLYW", None, "CTQF", None), "s": (None,) * 4, "u": ("CSRF", None, None, None)})
    ref = wide(spark, {"r1": ("CSRF", None, "CGGW", None), "r2": ("CSRF", None, "CGGW", None), "r3": ("CPLYW", None, "CTQF", None)}).withColumn("e", F.element_at(F.create_map(*[F.lit(x) for x in ("r1", "x", "r2", "y", "r3", "z")]), F.col("cell_id")))
    q = ct.ir_query(cells, ref, receptor_arms="all", dual_ir="primary_only")
    hits = ct.annotate_df(q, ref, ["e"])
    got = {s: {r.cell_id: r.e for r in ct.annotate(cells, hits, "e", s).collect()} for s in ("unique-only", "most-frequent", "json")}
    assert got["unique-only"]["p"] == got["most-frequent"]["p"] == "ambiguous" and got["json"]["p"] == '{"x":1,"y":1}'
    assert got["unique-only"]["q"] == "z" and got["unique-only"]["s"] is None and got["unique-only"]["u"] is None
    with pytest.raises(ValueError):
        ct.ir_query(cells, ref, same_j_gene=True)


def test_graph(spark):
    cells = random_cells(11)
    edges, members = ct.clonotype_graph(wide(spark, cells), metric="hamming", cutoff=1, receptor_arms="VJ", dual_ir="primary_only")
    first = {}
    for i, (c, s) in enumerate(cells.items()):
        if s[0]:
            first.setdefault(s[0], i)
    want = {(a, b): gap(p, q, 1, False) for p, a in first.items() for q, b in first.items() if a < b and gap(p, q, 1, False) is not None}
    got = {(r.src, r.dst): (r.dist, r.weight) for r in edges.collect()}
    assert got == {k: (d, (2 - d) / 2) for k, d in want.items()} and members.count() == sum(bool(s[0]) for s in cells.values())
