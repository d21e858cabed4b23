import random
from itertools import combinations

import pytest

from chainweave.operators import communities as c


def frame(spark, edges):
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight long")


def quality(edges, label, resolution=1.0):
    total, strength = 2 * sum(edges.values()), {}
    for (a, b), w in edges.items():
        strength[a], strength[b] = strength.get(a, 0) + w, strength.get(b, 0) + w
    inside = 2 * sum(w for (a, b), w in edges.items() if label[a] == label[b])
    held = {}
    for n, k in strength.items():
        held[label[n]] = held.get(label[n], 0) + k
    return inside / total - resolution * sum((k / total) ** 2 for k in held.values())


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [nodes[0], *rest[k]], *rest[k + 1:]]


def best_quality(edges):
    nodes = sorted({x for e in edges for x in e})
    return max(quality(edges, {n: k for k, p in enumerate(parts) for n in p}) for parts in partitions(nodes))


def labels(df):
    return {r.node: r.community for r in df.collect()}


def cliques(sizes, bridges=()):
    edges, at, starts = {}, 0, []
    for n in sizes:
        edges |= {(at + a, at + b): 3 for a, b in combinations(range(n), 2)}
        starts.append(at)
        at += n
    for a, b in bridges:
        edges[starts[a], starts[b]] = 1
    return edges, starts


@pytest.mark.parametrize("find", [c.leiden, c.fastgreedy])
def test_cliques(spark, find):
    edges, starts = cliques([4, 5, 3, 6], [(0, 1), (1, 2), (2, 3)])
    got = labels(find(frame(spark, edges)))
    assert got == {n: max(s for s in starts if s <= n) for n in range(18)}
    assert c.modularity(frame(spark, edges), find(frame(spark, edges))) == pytest.approx(quality(edges, got))


@pytest.mark.parametrize("find", [c.leiden, c.fastgreedy])
def test_near_the_best_modularity(spark, find):
    """A small random graph, against all partitions; communities are connected."""
    r = random.Random(1)
    edges = {(a, b): r.randrange(1, 4) for a, b in combinations(range(8), 2) if r.random() < (0.8 if a // 4 == b // 4 else 0.15)}
    got = labels(find(frame(spark, edges)))
    assert set(got) == {x for e in edges for x in e}
    assert quality(edges, got) >= 0.93 * best_quality(edges)
    for name in set(got.values()):
        own, seen = {n for n in got if got[n] == name}, {name}
        while True:
            more = {y for e in edges for x, y in (e, e[::-1]) if x in seen and y in own} | seen
            if more == seen:
                break
            seen = more
        assert seen == own


def test_the_two_differ(spark):
    """Agglomeration can't take back a merge, moves can."""
    r = random.Random(9)
    edges = {(a, b): 1 for a, b in combinations(range(24), 2) if r.random() < (0.6 if a % 4 == b % 4 else 0.12)}
    one, two = labels(c.leiden(frame(spark, edges))), labels(c.fastgreedy(frame(spark, edges)))
    assert one != two and min(quality(edges, one), quality(edges, two)) > 0.2


def test_resolution_and_odd_edges(spark):
    edges, _ = cliques([4, 4], [(0, 1)])
    assert len(set(labels(c.leiden(frame(spark, edges), resolution=6.0)).values())) > 2
    odd = spark.createDataFrame([(1, 1, 5), (None, 2, 1), (2, 3, 0), (4, 5, 2), (5, 4, 1)], "src long, dst long, weight long")
    for find in (c.leiden, c.fastgreedy):
        assert labels(find(odd)) == {4: 4, 5: 4}
        assert labels(find(odd.where("src = 1"))) == {}


def test_leiden_of_cliques(spark):
    """Configurations within one mismatch, as cliques with signs: weights are those of the pairs; connected communities, near the best modularity."""
    from chainweave.operators import clonotypes as ct

    r = random.Random(4)
    seq = lambda: None if r.random() < 0.1 else "C" + r.choice("ADE") + r.choice("ADEF") + "F"
    rows = sorted({(seq(), seq(), r.choice(["TCR", "BCR"])) for _ in range(90)}, key=str)
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "ct long, VJ_1_junction_aa string, VDJ_1_junction_aa string, receptor_type string")
    s = ct.Setup(metric="hamming", cutoff=1, dual_ir="primary_only")
    pairs = {(x.i, x.j): 1 for x in ct.near_pairs(table, None, s).collect()}
    cliques_, weight, held = ct.near_cliques(table, s).cache(), {}, {}
    for x in cliques_.collect():
        held.setdefault(x.clique, []).append((x.node, x.sign))
    assert all(len({sign for _, sign in own}) == 1 for own in held.values())
    for own in held.values():
        for (a, sign), (b, _) in combinations(sorted(own), 2):
            weight[a, b] = weight.get((a, b), 0) + sign
    assert {k: v for k, v in weight.items() if v} == pairs and len(pairs) > 200
    got = labels(c.leiden_of_cliques(cliques_))
    assert got == labels(c.leiden_of_cliques(cliques_)) and set(got) == {x for e in pairs for x in e}
    assert quality(pairs, got) >= 0.97 * quality(pairs, labels(c.leiden(frame(spark, pairs))))
    for name in set(got.values()):
        own, seen = {n for n in got if got[n] == name}, {name}
        while more := {y for e in pairs for x, y in (e, e[::-1]) if x in seen and y in own} - seen:
            seen |= more
        assert seen == own
    graph = c._Cliques(cliques_.selectExpr("clique", "0L part", "cast(sign as long) sign", "node", "1L n"))
    named = graph.strengths().join(spark.createDataFrame(sorted(got.items()), "node long, label long"), "node")
    assert c._quality(graph, named, 1.0) == pytest.approx(quality(pairs, got))


def test_fastgreedy_of_cliques(spark):
    """From cliques of shared keys: every node with a neighbour, connected communities, a modularity near that from the pairs, and of more than one clique."""
    from chainweave.operators import clonotypes as ct

    r = random.Random(7)
    rows = sorted({("C" + r.choice("AD") + r.choice("ADEF") + "F", "C" + r.choice("ADEF") + "F", r.choice(["TCR", "BCR"])) for _ in range(24)})
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "ct long, VJ_1_junction_aa string, VDJ_1_junction_aa string, receptor_type string")
    s = ct.Setup(metric="hamming", cutoff=1, dual_ir="primary_only")
    pairs = {(x.i, x.j): 1 for x in ct.near_pairs(table, None, s).collect()}
    got = labels(c.fastgreedy_of_cliques(ct.near_cliques(table, s)))
    assert set(got) == {x for e in pairs for x in e} and all(got[name] == name == min(n for n in got if got[n] == name) for name in set(got.values()))
    assert quality(pairs, got) >= 0.95 * quality(pairs, labels(c.fastgreedy(frame(spark, pairs))))
    for name in set(got.values()):
        own, seen = {n for n in got if got[n] == name}, {name}
        while more := {y for e in pairs for x, y in (e, e[::-1]) if x in seen and y in own} - seen:
            seen |= more
        assert seen == own
