import hashlib
from collections import Counter

import numpy as np
import pytest

from chainweave.llm import repeats
from tests.llm.fixtures import documents, prose, table


def plain(texts, length):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for b in data:
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("options", [{"shard_bytes": 700, "job_bytes": 3000}, {"group_bytes": 500}])
def test_is_brute_force(spark, options):
    """Also where every larger anchor is cut again, up to whole windows."""
    rows = documents()
    rows += [(100 + i, prose(50 + i, 30) + prose(2, 90)[40 * i:] + prose(70 + i, 30), "en", "a", 0, 0, "") for i in range(6)]
    want = sorted((str(r[0]), *p) for r, p in zip(rows, plain([r[1] for r in rows], 400)))
    assert result(repeats.removed_repeats(table(spark, rows), **options)) == want


def test_parts_of_texts_and_segments(spark, monkeypatch):
    """Texts longer than a chunk and segments longer than a run: what is cut there still meets."""
    texts = ["".join("acgt"[x] for x in np.random.RandomState(seed).randint(0, 4, n)) for seed, n in ((1, 3000), (2, 2500))]
    texts += [texts[0][700:1900] + "x" + texts[1][100:650], "ab" * 900, "a" * 1500 + texts[1][2000:], "a" * 700]
    rows = [(i, t, "en", "a", 0, 0, "") for i, t in enumerate(texts)]
    plain_rows = sorted((str(i), *p) for i, p in enumerate(plain(texts, 60)))
    got = []
    for chunk, run in ((1 << 20, 4096), (500, 37)):
        segments = repeats.segments
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        monkeypatch.setattr(repeats, "RUN", run)
        whole = [segments(t.encode(), 60, 8) for t in texts]
        assert all(hi.max() == len(t) - 60 and (hi - lo).max() < run and (lo[1:] == hi[:-1] + 1).all() for (_, lo, hi, _), t in zip(whole, texts))
        got.append(whole)
    assert any(len(a[1]) != len(b[1]) for a, b in zip(*got))

    def smaller(*args):  # tasks import the module anew: the sizes travel with the function
        repeats.CHUNK, repeats.RUN = 500, 37
        return segments(*args)

    monkeypatch.setattr(repeats, "segments", smaller)
    assert result(repeats.removed_repeats(table(spark, rows), length=60, gram=8, symbol=12, group_bytes=4000)) == plain_rows


def test_short_length(spark):
    rows = [(i, t, "en", "a", 0, 0, "") for i, t in enumerate(["abcabcabcabcabcabcabcabcabc", "xxabcabcabcabcyy", "é" * 30, "", None, "unlike anything else here"])]
    want = sorted((str(r[0]), *p) for r, p in zip(rows, plain([r[1] for r in rows], 12)))
    assert result(repeats.removed_repeats(table(spark, rows), length=12, gram=4, symbol=4, shard_bytes=20, job_bytes=40)) == want


def test_merge_is_a_suffix_order():
    """The merged interleave orders suffixes of several shards as sorting them together would."""
    rng = np.random.RandomState(5)
    texts = [rng.randint(1, 4, n) for n in (30, 17, 25, 9)]
    shards = [repeats.Shard(np.array([len(t)]), [t], 1) for t in texts]
    bwt = [s.transform(6) for s in shards]
    z, common = repeats.merge(bwt, 6)
    at, order = [0] * 4, []
    for s in z:
        p = shards[s].place[shards[s].order][at[s]]
        order.append(tuple(texts[s][p:p + 6]) + (0,) * (6 - len(texts[s][p:p + 6])))
        at[s] += 1
    assert order == sorted(order)
    for (a, b), c in zip(zip(order, order[1:]), common[1:]):
        want = next((k for k in range(6) if a[k] != b[k] or not a[k]), 6)  # ends of texts are not shared
        assert c == want if want == 6 or a[want] != b[want] else c >= want


def test_empty(spark):
    assert repeats.removed_repeats(table(spark, [])).count() == 0


def test_transforms_move_small_numbers():
    """Symbols, ranks and the interleave of a job are held in the fewest bytes its size needs; what is found stays the same."""
    shard = repeats.Shard(np.array([30]), [np.random.RandomState(1).randint(1, 4, 30).astype(np.int32)], 1)
    bwt = shard.transform(6)
    z, common = repeats.merge([bwt, bwt], 6)
    assert (bwt.dtype.itemsize, z.dtype.itemsize, common.dtype.itemsize) == (4, 1, 2)
    many = repeats.merge([bwt] * 300, 6)
    assert many[0].max() == 299 and sorted(np.bincount(many[0])) == [len(bwt)] * 300
    text = bytes(np.random.RandomState(2).randint(97, 100, 900).astype(np.uint8))
    flags = repeats.repeated_windows([text, text[100:500]], [1, 1], [1, 1], 40, 10, 300)
    seen = Counter(t[i:i + 40] for t in (text, text[100:500]) for i in range(len(t) - 39))
    assert [x.tolist() for x in flags] == [[seen[t[i:i + 40]] > 1 for i in range(len(t) - 39)] for t in (text, text[100:500])]
