import math

import numpy as np
import pytest

from chainweave.operators import clonotypes as ct
from chainweave.operators import counting, diversity, figures, groups, mutation
from chainweave.plans.components import connected_components


def test_fisher_and_negative_binomial():
    assert groups.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert groups.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965034965)
    x = np.random.RandomState(1).negative_binomial(5, 0.4, 4000)
    r, p = groups.fit_negative_binomial(x)
    assert abs(r - 5) < 0.8 and abs(p - 0.4) < 0.05
    assert groups.negative_binomial_cdf(1000, r, p) == pytest.approx(1.0)


def test_diversity(spark):
    rows = spark.createDataFrame([("A", c) for c in "aabbcd"] + [("B", "x")] * 3 + [("C", None)], "g string, t string")
    got = lambda m, **o: {r.g: r.value for r in diversity.alpha_diversity(rows, "g", "t", m, **o).collect()}
    shannon = got("normalized_shannon_entropy")
    p = [2 / 6, 2 / 6, 1 / 6, 1 / 6]
    assert shannon["A"] == pytest.approx(-sum(x * math.log(x) for x in p) / math.log(4)) and shannon["B"] == 0 and "C" not in shannon
    assert got("D50") == {"A": 50.0, "B": 100.0}
    assert got(max) == {"A": 2.0, "B": 3.0}
    with pytest.raises(ValueError):
        got("DXX")


def test_expansion(spark):
    rows = spark.createDataFrame([("1", "A", "x"), ("2", "A", "x"), ("3", "B", "x"), ("4", "B", "y"), ("5", "B", None), ("6", None, "y")], "cell_id string, g string, t string")
    got = {r.cell_id: r.clonal_expansion for r in counting.clonal_expansion(rows, "t").collect()}
    assert got == {"1": "> 2", "2": "> 2", "3": "> 2", "4": "<= 2", "5": "nan", "6": "<= 2"}
    own = {r.cell_id: r.clonal_expansion for r in counting.clonal_expansion(rows, "t", "g").collect()}
    assert own == {"1": "<= 2", "2": "<= 2", "3": "<= 1", "4": "<= 1", "5": "nan", "6": None}
    with pytest.raises(ValueError):
        counting.clonal_expansion(rows, "t", breakpoints=()).collect()


def test_mutations(spark):
    s, g = "ACGT" * 100, "ACGA" + "ACGT" * 98 + "AC.T"
    rows = spark.createDataFrame([(s, g, "A" * 30), (None, g, "A"), ("." * 400, g, "AAA")], "sequence_alignment string, germline_alignment_d_mask string, junction string")
    got = mutation.mutational_load(rows, ("full", "fwr1", "cdr3")).collect()
    assert got[0].full_mutation_count == 1 and got[0].fwr1_mutation_freq == pytest.approx(1 / 78) and got[0].cdr3_mutation_count == 0
    assert got[1].full_mutation_count is None and got[2].full_mutation_count is None
    with pytest.raises(Exception, match="differ in length"):
        mutation.mutational_load(spark.createDataFrame([("A", "AC", "A")], "sequence_alignment string, germline_alignment_d_mask string, junction string"), ("full",)).collect()


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 5), (6, 6), (10, 9), (9, 8), (8, 7), (7, 11), (5, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_overlap(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), ("C", "z")], "g string, t string")
    got = {(r.a, r.b): r.distance for r in groups.jaccard(rows, "g", "t").collect()}
    assert got == {("A", "B"): 0.5, ("A", "C"): 1.0, ("B", "C"): 1.0}
    presence, distances, linkage = groups.repertoire_overlap(rows, "g", "t")
    assert presence.count() == 4 and distances.count() == 3
    assert [tuple(r) for r in linkage.orderBy("step").collect()] == [(0, "A", "B", 0.5), (1, "A", "C", 1.0)]


def test_imbalance(spark):
    """Cells with and without a clonotype on both sides; a clonotype that all replicates have, and one that some lack."""
    data = [(p, s, c) for p, s, cells in [("p1", "F", "xxxy"), ("p2", "F", "xxyy"), ("p3", "O", "xyyy"), ("p4", "O", "xyyyyy")] for c in cells]
    rows = spark.createDataFrame(data + [("p4", "O", None), (None, "F", "x"), ("p5", "Q", "x")], "rep string, status string, clone string")
    both = rows.where("rep is null or rep <> 'p5'")
    got = {r.clone: r for r in groups.clonotype_imbalance(both, "rep", "status", "clone", "F", "O").collect()}
    assert got["x"].p_value == pytest.approx(groups.fisher_exact(5, 3, 2, 9)) and got["x"].hue == "All"
    eps = 0.01 * 1 / 4
    assert got["x"].log2_fc == pytest.approx(math.log2(((3 / 4 + 2 / 4) / 2 + eps) / ((1 / 4 + 1 / 7) / 2 + eps)))
    lone = rows.union(spark.createDataFrame([("p1", "F", "z")], rows.schema))
    stats = {r.clone: r for r in groups.clonotype_imbalance(lone, "rep", "status", "clone", "F", "O").collect()}
    assert stats["z"].log2_fc == float("inf") and stats["z"].log_p == pytest.approx(-math.log10(stats["z"].p_value))
    long = groups.imbalance_abundance(lone, "rep", "status", "clone", "F", None)
    assert long.where("clone = 'z'").count() == 5 and long.where("clone = 'z' and abundance > 0").count() == 1
    top = figures.top_imbalance(groups.clonotype_imbalance(lone, "rep", "status", "clone", "F"), long, "clone", 2)
    assert top.count() == 10


def test_abundance(spark):
    rows = spark.createDataFrame([(g, t) for g, ts in [("A", "xxy"), ("B", "y"), ("C", "zzzzzz")] for t in ts] + [("A", None), ("nan", "x")], "g string, t string")
    got = {(r.g, r.t): (r.value, r.group_rank, r.target_rank) for r in counting.group_abundance(rows, "g", "t", True).collect()}
    assert got == {("A", "x"): (2 / 3, 2, 2), ("A", "y"): (1 / 3, 2, 3), ("B", "y"): (1.0, 3, 3), ("C", "z"): (1.0, 1, 1)}
    some = {(r.g, r.t): r.group_rank for r in counting.group_abundance(rows, "g", "t", sort=["C", "A"]).collect()}
    assert some == {("C", "z"): 1, ("A", "x"): 2, ("A", "y"): 2}
    assert {r.group_rank for r in counting.group_abundance(rows, "g", "t", sort="alphabetical").where("g = 'C'").collect()} == {3}
    assert {(r.t): r.value for r in counting.group_abundance(rows, "g", "t", "t").where("g = 'A'").collect()} == {"x": 1.0, "y": 0.5}


def test_modularity(spark):
    """A clique among many nodes without edges inside their labels scores high; exact and fitted p agree in kind."""
    labels = spark.createDataFrame([(i, "clique" if i < 6 else f"l{i % 20}") for i in range(200)], "node long, label string")
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)] + [(i, i + 1) for i in range(6, 199)], "src long, dst long")
    for exact in (True, False):
        got = {r.label: r for r in groups.clonotype_modularity(labels, edges, 200, exact).collect()}
        assert got["clique"].n_edges == 15 and got["clique"].score > 3 and got["clique"].p_value <= 0.01 and got["l7"].score <= 0
    shown = {r.label: r.shown for r in figures.modularity_table(groups.clonotype_modularity(labels, edges, 100)).collect()}
    assert shown["clique"] and not shown["l7"]


def test_random_sets_are_permutations():
    for n in (1, 2, 7, 100, 1000):
        ranks = groups.keyed_ranks(np.arange(n), n, np.arange(30))
        assert (np.sort(ranks, axis=0) == np.arange(n)[:, None]).all()
    assert abs(groups.keyed_ranks(np.arange(50), 50, np.arange(4000)).mean(axis=1) - 24.5).max() < 1.2


def test_modularity_is_brute_force(spark):
    """Counts of every permutation from its own sets of nodes; adjusted p over several blocks."""
    r = np.random.RandomState(3)
    pairs = sorted({tuple(sorted(r.choice(40, 2, replace=False).tolist())) for _ in range(150)})
    label = {i: "abcdefgh"[int(i ** 0.5)] for i in range(40)}
    labels = spark.createDataFrame([(100 + i, x) for i, x in label.items()], "node long, label string")
    edges = spark.createDataFrame([(100 + a, 100 + b) for a, b in pairs], "src long, dst long")
    ranks, want = groups.keyed_ranks(np.arange(40), 40, np.arange(60) + 5), {}
    for name in set(label.values()):
        size = sum(x == name for x in label.values())
        own = sum(label[a] == label[b] == name for a, b in pairs)
        drawn = [sum(max(ranks[a, p], ranks[b, p]) < size for a, b in pairs) for p in range(60)]
        want[name] = size, own, math.log2((own + 1) / (np.mean(drawn) + 1)), max(np.mean(np.array(drawn) >= own), 1 / 60)
    got = {x.label: x for x in groups.clonotype_modularity(labels, edges, 60, True, 5).collect()}
    assert {k: (x["size"], x.n_edges) for k, x in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k].score == pytest.approx(v[2]) and got[k].p_value == pytest.approx(v[3]) for k, v in want.items())
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.r_[r.uniform(0, 1, 40) ** 3, 0.01, 0.01])], "k long, p double")
    p = np.array([x.p for x in rows.orderBy("k").collect()])
    order = np.lexsort((np.arange(42), p))
    q = np.minimum(1, np.minimum.accumulate((p[order] * 42 / np.arange(1, 43))[::-1])[::-1])
    fdr = {x.k: x.fdr for x in groups.false_discovery(rows, "p", "k", 5).collect()}
    assert [fdr[k] for k in order] == pytest.approx(q.tolist())


def test_network(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (9, "e")], "ct long, cell_id string")
    links = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    cells = spark.createDataFrame([(c, n, k) for c, n, k in zip("abcde", (1.0, 3.0, 5.0, None, 2.0), ("x", None, "y", "y", "x"))], "cell_id string, v double, label string")
    assert {r.ct for r in ct.network_nodes(members, links, 3, 2).collect()} == {1, 2, 3}
    assert {r.ct for r in ct.network_nodes(members, links, 1, 1, cells.where("cell_id = 'e'")).collect()} == {9}
    with pytest.raises(ValueError, match="no component"):
        ct.network_nodes(members, links, 3, 2, cells.where("cell_id = 'e'"))
    assert {r.ct: r.value for r in figures.node_means(members, cells, "v").collect()} == {1: 2.0, 2: 5.0, 3: None, 9: 2.0}
    assert {(r.ct, r.category): r.share for r in figures.node_shares(members, cells, "label").collect()} == {(1, "x"): 0.5, (1, "nan"): 0.5, (2, "y"): 1.0, (3, "y"): 1.0, (9, "x"): 1.0}
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 4.0)], "ct long, x double, y double")
    nodes, edges = figures.network_tables(at, members, cells, links)
    assert {(r.ct, r.label): (r.y, r["size"]) for r in nodes.collect()} == {(1, "x"): (4.0, 1), (2, "y"): (0.0, 1)} and [tuple(r) for r in edges.collect()] == [(1, 2)]


def test_curve(spark):
    values = spark.createDataFrame([(3, 2.0), (5, 1.0)], "v int, w double")
    got = {round(r.grid, 6): r.density for r in counting.kde(values, "v", "w").collect()}
    want = lambda x: sum(w / 3 * math.exp(-((x - v) / 0.6) ** 2 / 2) / (0.6 * math.sqrt(2 * math.pi)) for v, w in ((3, 2.0), (5, 1.0)))
    assert len(got) == 81 and all(d == pytest.approx(want(x)) for x, d in got.items())
