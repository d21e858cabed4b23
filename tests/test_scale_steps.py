"""Steps that must grow no faster than their input: what is dealt, how often it is read, and the same results."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from chainweave import catalogue
from chainweave.operators import clonotypes as ct
from chainweave.operators import counting, figures, groups, indexing, layouts, qc
from chainweave.operators.distances import ir_dist, sequences
from chainweave.plans import receptors
from chainweave.sources import tables

SF = "/root/testdata/sf0.001"
CONFIG = "ct long, VJ_1_junction_aa string, VJ_1_v_call string, VDJ_1_junction_aa string, VDJ_1_v_call string, receptor_type string"


def test_cells_hold_only_the_fields_asked_for_and_lines_are_dealt_once(spark):
    cells = receptors.receptor_cells(spark, SF, catalogue.CHAIN_FIELDS)
    assert cells.schema["airr"].dataType.elementType.names == list(catalogue.CHAIN_FIELDS)
    own = receptors.chains(spark, SF, keyed=True).groupBy("cell_ord").count()
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_usable_chains_give_the_same_indexed_cells(spark):
    show = lambda usable: {(r[0], str(r[1:])) for r in indexing.get_airr(indexing.index_chains(
        receptors.receptor_cells(spark, SF, catalogue.CHAIN_FIELDS, usable=usable)), ("junction", "v_call", "umi_count")).collect()}
    assert show(True) == show(False)
    plain = receptors.chains(spark, SF).where("productive and junction_aa is not null").count()
    assert receptors.chains(spark, SF, usable=True).count() == plain


def test_wide_table_without_arrays(spark):
    table = catalogue.wide(spark, SF)
    base = catalogue.base(spark, SF)
    old = indexing.with_airr(base, catalogue.WIDE_FIELDS).withColumn("has_ir", indexing.has_ir()).drop("airr", "chain_indices")
    show = lambda df: sorted(map(str, df.select(*sorted(old.columns)).collect()))
    assert show(table) == show(old)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("hashpartitioning(l_orderkey") == 1
    few = table.select("VJ_1_junction_aa")._jdf.queryExecution().optimizedPlan().toString()
    assert "v_call" not in few  # what nobody reads is not made
    columns = {a: [f"{a}_{n}_junction_aa" for n in (1, 2)] for a in ("VJ", "VDJ")}
    assert sorted(map(tuple, catalogue.seqs(spark, SF).collect())) == sorted(map(tuple, sequences(old, columns).collect()))


def test_chains_are_ranked_as_they_are_indexed(spark):
    rng = np.random.default_rng(5)
    some = lambda *x: x[rng.integers(len(x))]
    rows = [(i % 60, i // 60, some("TRA", "TRB", "IGH", "IGK", "XXX", None), some("CA", "CB", "CC"), some(None, "AC", "AG"), some(None, 1, 2), some(None, 1)) for i in range(420)]
    flat = spark.createDataFrame(rows, "cell_ord long, chain_idx int, locus string, junction_aa string, junction string, umi_count int, consensus_count long")
    flat = flat.withColumn("productive", F.lit(True))
    cells = flat.select("cell_ord", F.col("cell_ord").cast("string").alias("cell_id")).distinct()
    indexed = indexing.index_chains(receptors.nested(cells, flat, "cell_ord"))
    names = ("locus", "junction_aa", "junction", "umi_count")
    want = indexing.with_airr(indexed, names).withColumn("multichain", F.col("chain_indices.multichain"))
    got = cells.join(indexing.picked(indexing.ranked(flat, "cell_ord"), "cell_ord", names), "cell_ord", "left").withColumn("multichain", F.coalesce("multichain", F.lit(False)))
    columns = ["cell_ord", "multichain", *[f"{c}_{v}" for c in indexing.CHAINS for v in names]]
    show = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert show(got) == show(want)
    typed = qc.typed(got, lambda c, v: F.col(f"{c}_{v}"), F.coalesce("VJ_1_locus", "VDJ_1_locus").isNotNull(), F.col("multichain"))
    kinds = ("cell_ord", "receptor_type", "receptor_subtype", "chain_pairing")
    assert sorted(typed.select(*kinds).collect()) == sorted(qc.chain_qc(indexed).select(*kinds).collect())


def test_tests_are_dealt_and_made_once_for_each_table(spark, monkeypatch):
    rows = [(f"p{i % 4}", "case" if i % 4 < 2 else "control", f"t{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "replicate string, g string, target string")
    got = groups.clonotype_imbalance(df, "replicate", "g", "target", "case")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    counts = {r.target: tuple(map(int, (r.case_n, r.case_total - r.case_n, r.control_n, r.control_total - r.control_n)))
              for r in groups.imbalance_counts(df, "replicate", "g", "target", "case").collect()}
    assert {r.target: r.p_value for r in got.collect()} == {t: groups.fisher_exact(*v) for t, v in counts.items()}
    made = []
    monkeypatch.setattr(groups, "fisher_exact", lambda *t: made.append(t) or sum(t))
    assert groups.fisher_tables([(1, 2, 3, 4), (1, 1, 1, 1), (1, 2, 3, 4)]) == [10, 4, 10] and len(made) == 2


def _configurations(spark, n=150, seed=3):
    rng = np.random.default_rng(seed)
    seq = lambda: None if rng.random() < 0.25 else "C" + "".join(rng.choice(list("AD"), 4)) + "F"
    rows, seen = [], set()
    for i in range(n):
        a, b = seq(), seq()
        row = (a, None if a is None or rng.random() < 0.2 else "V%d" % rng.integers(2), b, None if b is None or rng.random() < 0.2 else "V%d" % rng.integers(2), ["TCR", "BCR", None][rng.integers(3)])
        if row not in seen and (a or b):
            seen.add(row)
            rows.append((i, *row))
    return spark.createDataFrame(rows, CONFIG)


def test_both_arms_at_once_gives_the_pairs_of_each_arm_apart(spark):
    table = _configurations(spark)
    for genes, square in itertools.product((False, True), (True, False)):
        s = ct.Setup(metric="hamming", cutoff=1, dual_ir="primary_only", same_v_gene=genes)
        columns = {a: [f"{a}_1_junction_aa"] for a in s.arms}
        edges = ir_dist(sequences(table, columns), None if square else sequences(table, columns), "hamming", 1)
        rows = ct.chain_rows(table, s)
        want = sorted(map(tuple, ct.pair_distances(rows, rows, edges, s, square).collect()))
        assert want and sorted(map(tuple, ct.near_pairs(table, None if square else table, s).collect())) == want


def test_annotation_by_configuration_equals_that_by_cell(spark):
    cells = spark.createDataFrame([(f"c{i}", i, True, "TCR", "CA%sF" % "ADE"[i % 3], None, ["x", "y", None][i % 5 % 3]) for i in range(20)],
                                  "cell_id string, cell_ord long, has_ir boolean, receptor_type string, VJ_1_junction_aa string, VDJ_1_junction_aa string, e string")
    ref = cells.where("cell_ord % 2 = 0 and VJ_1_junction_aa <> 'CAEF'")
    query = ct.ir_query(cells, ref, receptor_arms="all", dual_ir="primary_only")
    for strategy in ("unique-only", "most-frequent", "json"):
        want = sorted(map(str, ct.annotate(cells, ct.annotate_df(query, ref, ["e"]), "e", strategy).collect()))
        assert sorted(map(str, ct.annotate_query(cells, query, ref, "e", strategy).collect())) == want


def test_random_edges_against_all_sets(spark):
    n, sizes, perms = 40, [3, 9, 30], 7
    pairs = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 5))]
    ranks = groups.keyed_ranks(np.arange(n), n, np.arange(perms) + 5)
    want = {(p, s): sum(max(ranks[a, p], ranks[b, p]) < size for a, b in pairs) for p in range(perms) for s, size in enumerate(sizes)}
    got = {}
    for r in groups.random_edges(spark.createDataFrame(pairs, "a long, b long"), n, sizes, perms, 5).collect():
        for s in range(r.at, len(sizes)):
            got[r.perm, s] = got.get((r.perm, s), 0) + r.k
    assert {k: v for k, v in want.items() if v} == got


def test_cells_without_a_clone_don_t_join(spark):
    df = spark.createDataFrame([("a", "s", "x"), ("b", "s", "x"), ("c", "s", None), ("d", None, "x"), ("e", None, None)], "cell_id string, sample string, clone string")
    found = counting.clonal_expansion(df, "clone", "sample")
    assert {r.cell_id: r.clonal_expansion for r in found.collect()} == {"a": "<= 2", "b": "<= 2", "c": "nan", "d": None, "e": "nan"}
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_motif_and_top_targets_read_what_they_need(spark):
    df = spark.createDataFrame([("CAF",), ("CAF",), ("CDF",), (None,)], "s string")
    assert {(r.pos, r.letter): r.value for r in counting.motif(df, "s").collect()} == {(0, "C"): 3.0, (1, "A"): 2.0, (1, "D"): 1.0, (2, "F"): 3.0}
    stats = spark.createDataFrame([("x", 0.1), ("y", 0.01), ("z", 0.5)], "t string, p_value double")
    abundance = spark.createDataFrame([("x", "All", "case", "r1", 0.2), ("y", "All", "case", "r1", 0.3), ("z", "All", "control", "r2", 0.4)], "t string, hue string, side string, replicate string, abundance double")
    top = figures.top_imbalance(stats, abundance, "t", 2)
    assert {(r.replicate, r.t): r.abundance for r in top.collect()} == {("r1", "x"): 0.2, ("r1", "y"): 0.3, ("r2", "x"): 0.0, ("r2", "y"): 0.0}
    assert "LeftSemi" in top._jdf.queryExecution().optimizedPlan().toString()


def test_airr_may_be_compressed(spark, tmp_path):
    df = spark.createDataFrame([("c1", "TRA", True, 3.0)], "cell_id string, locus string, productive boolean, umi_count double")
    tables.write_airr(df, str(tmp_path / "x"), "gzip")
    assert list((tmp_path / "x").glob("*.csv.gz")) and tables.read_airr(spark, str(tmp_path / "x")).first().umi_count == 3


def test_cells_are_counted_before_groups_are_filtered(spark, monkeypatch):
    plans = []
    own = counting.cut
    monkeypatch.setattr(counting, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "x"), ("b", "nan"), ("NaN", "x"), ("b", None)], "g string, t string")
    got = {(r.g, r.t): (r.value, r.group_rank, r.target_rank) for r in counting.group_abundance(df, "g", "t", fraction=True).collect()}
    assert got == {("a", "x"): (2 / 3, 1, 1), ("a", "y"): (1 / 3, 1, 2), ("b", "y"): (1.0, 2, 2)}
    assert "Filter" not in plans[0]


def test_layout_of_a_component_in_blocks(spark, monkeypatch):
    """A component's nodes are many rows, and each is pushed by the component's cells as by a plain loop."""
    rng = np.random.default_rng(4)
    rows = [(0, i, float(rng.integers(1, 5)), 60, *map(float, rng.normal(size=2))) for i in range(60)] + [(100, 100 + i, 1.0, 2, float(i), 0.5) for i in range(2)]
    edges = spark.createDataFrame([(i, j) for a in range(59) for i, j in ((a, a + 1), (a + 1, a))] + [(100, 101), (101, 100)], "src long, dst long")
    nodes = spark.createDataFrame(rows, "component long, ct long, size double, n_nodes long, x double, y double")
    monkeypatch.setattr(layouts, "NODES", 8)
    monkeypatch.setattr(layouts, "PAIRS", 100)
    blocks = layouts._blocks(nodes)
    assert blocks.where("component = 0").count() == 8
    got = {r.ct: (r.x, r.y) for r in layouts._round(blocks, edges, 0.25).selectExpr("inline(nodes)").collect()}
    want = {}
    for comp in (0, 100):
        own = [r for r in rows if r[0] == comp]
        ends = [(min(r[k] for r in own), max(max(r[k] for r in own) - min(r[k] for r in own), 1e-9)) for k in (4, 5)]
        cell = {r[1]: tuple(min(int((r[k] - lo) / wide * layouts.SIDE), layouts.SIDE - 1) for k, (lo, wide) in zip((4, 5), ends)) for r in own}
        for _, i, size, n, x, y in own:
            f = [0.0, 0.0]
            for c in set(cell.values()):
                there = [r for r in own if cell[r[1]] == c]
                others = [r for r in there if r[1] != i]
                if others:
                    d = [x - sum(r[4] for r in others) / len(others), y - sum(r[5] for r in others) / len(others)]
                    w = len(others) * (1 + 0.1 * (size ** 0.5 + sum(r[2] ** 0.5 for r in there) / len(there))) / max(d[0] ** 2 + d[1] ** 2, 1e-9)
                    f = [f[k] + d[k] * w for k in (0, 1)]
            for r in own:
                if abs(r[1] - i) == 1:
                    d = (x - r[4], y - r[5])
                    f = [f[k] - d[k] * (d[0] ** 2 + d[1] ** 2) ** 0.5 for k in (0, 1)]
            far = max((f[0] ** 2 + f[1] ** 2) ** 0.5, 1e-9)
            step = min(far, 0.25 * n ** 0.5) / far
            want[i] = (x + f[0] * step, y + f[1] * step)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)


def test_identity_clusters_are_components_of_keys(spark, monkeypatch):
    """Many configurations that link the same keys are one edge, those of one key are none."""
    given = []
    own = ct.connected_components
    monkeypatch.setattr(ct, "connected_components", lambda edges, *names: given.append(edges.count()) or own(edges, *names))
    rows = [(i, "CAF", None, f"C{i}F", None, "TCR") for i in range(9)] + [(10 + i, "CAF", "CDF", None, None, "TCR") for i in range(2)] + [(20, "CDF", None, None, None, "TCR"), (21, "CDF", None, None, None, "BCR")]
    table = spark.createDataFrame(rows, "ct long, VJ_1_junction_aa string, VJ_2_junction_aa string, VDJ_1_junction_aa string, VDJ_2_junction_aa string, receptor_type string")
    got = {r.ct: r.low for r in ct.identity_labels(table, ct.Setup(receptor_arms="VJ")).collect()}
    assert given == [1] and got == {**{i: 0 for i in (*range(9), 10, 11, 20)}, 21: 21}


def test_each_cell_has_its_next_five_by_rank(spark):
    """Numbers that are missing between cells cost no link, and the last cells go on with the first."""
    nodes = [0, 1, 2, 9, 10, 30, 31, 32, 50, 100, 101, 102, 103]
    cells = spark.createDataFrame([(n,) for n in reversed(nodes)], "node long")
    want = {(n, nodes[(i + k) % len(nodes)]) for i, n in enumerate(nodes) for k in range(1, 6)}
    got = [tuple(r) for r in catalogue.ring(cells).collect()]
    assert len(got) == len(want) and set(got) == want
    assert catalogue.ring(cells.limit(0)).isEmpty()
    labels, edges = catalogue.neighbours(spark, SF)
    assert edges.count() == 5 * labels.count()


def test_each_linked_pair_pulls_once(spark, monkeypatch):
    """The cliques of shared keys hold every pair that shares one, once; a round by cliques, in blocks, equals a round by all pairs."""
    rng = np.random.default_rng(8)
    seq = lambda p: None if rng.random() < p else "C%sF" % "ADE"[rng.integers(3)]
    rows = {(seq(0.2), seq(0.4), seq(0.3), seq(0.5), "TCR") for _ in range(300)}
    rows = [(i, a, b if a else None, c, d if c else None, t) for i, (a, b, c, d, t) in enumerate(sorted(rows, key=str)) if a or c]
    table = spark.createDataFrame(rows, "ct long, VJ_1_junction_aa string, VJ_2_junction_aa string, VDJ_1_junction_aa string, VDJ_2_junction_aa string, receptor_type string")
    s = ct.Setup(receptor_arms="all", dual_ir="any")

    def keys(r):
        a, b = {x for x in r[1:3] if x}, {x for x in r[3:5] if x}
        return set(itertools.product(a, b)) if a and b else {("a", x) for x in a} | {("b", x) for x in b}

    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if keys(x) & keys(y) and bool(x[1]) == bool(y[1]) and bool(x[3]) == bool(y[3])}
    assert {tuple(r) for r in ct.linked_pairs(table, s).collect()} == want and ct.links(table, s).count() < len(want)
    found = ct.cliques(table, s)
    held = {}
    for r in found.collect():
        held.setdefault((r.clique, r.sign), []).append(r.ct)
    times = {}
    for (_, sign), own in held.items():
        for x in itertools.combinations(sorted(own), 2):
            times[x] = times.get(x, 0) + sign
    assert times == {x: 1 for x in want}
    monkeypatch.setattr(layouts, "NODES", 9)
    monkeypatch.setattr(layouts, "SMALL", 4)
    nodes = table.select("ct", F.lit(0).cast("long").alias("component"), F.lit(1).alias("size"))
    both = spark.createDataFrame(sorted(want), "src long, dst long")
    show = lambda **k: {r.ct: (r.x, r.y) for r in layouts.layout(nodes, iterations=1, **k).collect()}
    one, other = show(links_=None, cliques=found), show(links_=both)
    assert len(one) == len(rows) and set(one) == set(other) and all(np.allclose(one[i], other[i]) for i in one)


def test_one_mismatch_in_each_arm_is_a_shared_key(spark, monkeypatch):
    """Components over shared keys, without pairs, equal those over all pairs; stop marks, empty and missing sequences included."""
    table = _configurations(spark, 150, 3).union(spark.createDataFrame(
        [(900, "CA*F", "V0", "", "V0", "TCR"), (901, "CAAF", "V0", "", "V0", "TCR"), (902, "C*AF", "V0", "", "V0", "TCR"), (903, "CAAF", "V0", "A", "V0", "TCR"), (904, "", "V1", None, None, "TCR")], CONFIG))
    for genes in (False, True):
        s = ct.Setup(metric="hamming", cutoff=1, dual_ir="primary_only", same_v_gene=genes)
        pairs = {tuple(r)[:2] for r in ct.near_pairs(table, None, s).collect()}
        rows = {}
        for r in ct.near_hub_rows(table, s).collect():
            rows.setdefault(r.hub, set()).add(r.ct)
        assert pairs and {x for own in rows.values() for x in itertools.combinations(sorted(own), 2)} == pairs
        low = {r.node: r.component for r in ct.connected_components(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
        got = {r.ct: r.low for r in ct.key_labels(ct.near_hub_rows(table, s)).collect()}
        assert {k: v for k, v in got.items() if k != v or k in low} == low
    cells = table.selectExpr("concat('c', ct) cell_id", "ct cell_ord", "true has_ir", "VJ_1_junction_aa", "VDJ_1_junction_aa", "receptor_type")
    monkeypatch.setattr(ct, "near_pairs", None)  # no pair is made
    assert ct.define_clonotype_clusters(cells, metric="hamming", cutoff=1, receptor_arms="all", dual_ir="primary_only").count() == table.select("ct").count()


def test_pairs_of_any_chain_are_reported_once_without_being_dealt(spark):
    """By keys, the same pairs and distances as by grouped pairs of chains; what is dealt is configurations, not pairs."""
    rng = np.random.default_rng(6)
    seq = lambda p: None if rng.random() < p else "C" + "".join(rng.choice(list("ADE"), rng.integers(1, 4))) + "F"
    gene = lambda x: None if x is None or rng.random() < 0.1 else "V%d" % rng.integers(2)
    rows = []
    for i in range(120):
        own = [seq(p) for p in (0.2, 0.3, 0.2, 0.3)]
        rows.append((i, *[v for x in own for v in (x, gene(x))], ["TCR", "BCR", None][rng.integers(3)]))
    names = [f"{a}_{n}" for a in ("VJ", "VDJ") for n in (1, 2)]
    table = spark.createDataFrame(rows, "ct long, " + ", ".join(f"{c}_junction_aa string, {c}_v_call string" for c in names) + ", receptor_type string")
    for arms, genes, square in (("VJ", False, False), ("any", True, False), ("any", False, True)):
        s = ct.Setup(metric="hamming", cutoff=1, receptor_arms=arms, dual_ir="any", same_v_gene=genes)
        left, right = (table, None) if square else (table, table.where("ct % 3 = 0"))
        other = left if square else right
        columns = {a: [f"{a}_{n}_junction_aa" for n in (1, 2)] for a in s.arms}
        edges = ir_dist(sequences(left, columns), None if square else sequences(other, columns), "hamming", 1)
        want = sorted(map(tuple, ct.pair_distances(ct.chain_rows(left, s), ct.chain_rows(other, s), edges, s, square).collect()))
        got = ct.near_pairs(left, right, s)
        assert want and {w[2] for w in want} == {0, 1} and sorted(map(tuple, got.collect())) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[:plan.index("Join")]


def test_cells_meet_reference_cells_in_all_tasks(spark):
    """The last join keeps its number of tasks: its rows grow with the square of a configuration's cells, its bytes don't."""
    cells = spark.createDataFrame([(f"c{i}", i, True, "TCR", f"CA{'ADEFG'[i % 5]}F", None) for i in range(60)],
                                  "cell_id string, cell_ord long, has_ir boolean, receptor_type string, VJ_1_junction_aa string, VDJ_1_junction_aa string").withColumn("e", F.col("cell_id"))
    ref = cells.where("cell_ord % 2 = 0")
    found = ct.annotate_df(ct.ir_query(cells, ref, receptor_arms="all", dual_ir="primary_only"), ref, ["e"])
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((f"c{i}", f"c{j}", f"c{j}") for i in range(60) for j in range(0, 60, 2) if i % 5 == j % 5)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
