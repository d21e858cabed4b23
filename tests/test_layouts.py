import random
from itertools import combinations

import pytest

from chainweave.operators import layouts


@pytest.mark.parametrize("packing", ["shelves", "grid"])
def test_boxes_do_not_overlap(spark, monkeypatch, packing):
    monkeypatch.setattr(layouts, "BLOCK", 7)
    r = random.Random(1)
    boxes = [(i, r.choice([0.0, 1.0, 5.0, 40.0]) * r.random(), r.choice([0.0, 1.0, 9.0]) * r.random()) for i in range(60)]
    at = {x.component: (x.left, x.low) for x in layouts.packed(spark.createDataFrame(boxes, "component long, w double, h double"), packing).collect()}
    assert len(at) == 60 and min(min(p) for p in at.values()) >= 0
    for (i, w, h), (j, v, g) in combinations(boxes, 2):
        (a, b), (c, d) = at[i], at[j]
        assert a + w + 1 <= c + 1e-9 or c + v + 1 <= a + 1e-9 or b + h + 1 <= d + 1e-9 or d + g + 1 <= b + 1e-9
    assert packing == "grid" or max(a + w for (i, w, _), (a, _) in zip(boxes, (at[i] for i, *_ in boxes))) * max(b + h for (i, _, h), (_, b) in zip(boxes, (at[i] for i, *_ in boxes))) < 2.5 * sum((w + 1) * (h + 1) for _, w, h in boxes)


def test_layout(spark):
    """Two cliques with a bridge and a lone node: neighbours stand nearer than others, nodes apart, components in boxes of their own; reruns agree."""
    edges = [(a, b) for g in (range(5), range(5, 10)) for a, b in combinations(g, 2)] + [(4, 5)]
    nodes = spark.createDataFrame([(i, 0, 1 + i % 3) for i in range(10)] + [(20, 20, 4)], "ct long, component long, size long")
    links = spark.createDataFrame(edges, "src long, dst long")
    got = {r.ct: (r.x, r.y) for r in layouts.layout(nodes, links, 12).collect()}
    assert set(got) == {*range(10), 20}
    far = lambda a, b: ((got[a][0] - got[b][0]) ** 2 + (got[a][1] - got[b][1]) ** 2) ** 0.5
    inside, across = [far(a, b) for a, b in edges], [far(a, b) for a in range(4) for b in range(6, 10)]
    assert min(far(a, b) for a, b in combinations(range(10), 2)) > 0.05
    assert sum(inside) / len(inside) < 0.6 * sum(across) / len(across)
    assert got == {r.ct: (r.x, r.y) for r in layouts.layout(nodes, links, 12).collect()}
