import random
import re

import pytest
import xxhash

from chainweave.llm import simhash
from tests.llm.fixtures import documents, prose, table


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, radius):
    root = dict(enumerate(range(len(fps))))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(fps))]


def test_query_is_brute_force(spark):
    rows = documents()
    fps = [plain(r[1]) for r in rows]
    want = sorted(zip((str(r[0]) for r in rows), (f"{f:016x}" for f in fps), components(fps, [r[0] for r in rows], 2)))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(table(spark)).collect())
    assert got == want


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def fps_table(spark, fps):
    return spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")


@pytest.mark.parametrize("bucket", [10, 40, 4096])
def test_hot_keys_lose_no_link(spark, bucket):
    """Many fingerprints near one another: keys above the bucket size are filed again, on several levels."""
    r, fps = random.Random(3), []
    for centre in (0x0123456789ABCDEF, 0x0123456789AB0000):
        for _ in range(150):
            f = centre
            for b in r.sample(range(64), r.randrange(5)):
                f ^= 1 << b
            fps.append(f)
    want = components(fps, list(range(len(fps))), 2)
    got = {x.doc_id: x.component_id for x in simhash.components(fps_table(spark, fps), 2, bucket).collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_rows_without_id_connect_others(spark):
    fps = [0, 0b11, 0b1111, 1 << 40, 7 << 50]
    rows = spark.createDataFrame(list(zip([5, None, 3, None, 9], fps)), "doc_id long, fp long")
    got = {(x.doc_id, x.fp): x.component_id for x in simhash.components(rows).collect()}
    assert got == {(5, 0): 3, (None, 3): 3, (3, 15): 3, (None, 1 << 40): 3, (9, 7 << 50): 9}


def test_empty(spark):
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_allotment():
    assert simhash.allot([[0, 1, 5], [0, 2, 3], [0, 9, 10]], 2)[1] == [1, 0, -1] or sum(simhash.allot([[0, 1, 5], [0, 2, 3], [0, 9, 10]], 2)[1]) == 0


def test_half_way_meetings_lose_no_link(spark):
    """Wide radius, where parts with two differing bits meet under a flipped key; links of small keys come once."""
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(150)]
    for f in fps[:100]:
        for n in (3, 6, 8):
            g = f
            for b in r.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    df = fps_table(spark, fps)
    for radius in (3, 5, 8):
        want = components(fps, list(range(len(fps))), radius)
        got = {x.doc_id: x.component_id for x in simhash.components(df, radius).collect()}
        assert [got[i] for i in range(len(fps))] == want
    n, ones, cov = simhash.bit_statistics(df)
    plans = [simhash.Plan(n, ones, cov, list(range(64)), 8)]
    keyed = simhash.filed(df.selectExpr("0L as key0", "0 as kind", "fp"), plans, 0)
    links = [(min(x), max(x)) for x in simhash.spanning_links(keyed, plans, 8, 4).collect()]
    want = {tuple(sorted((signed(fps[i]), signed(fps[j])))) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 8}
    assert set(links) == want and len(links) == len(want)
