import random
import zlib

import numpy as np
import pytest

from chainweave.llm import runs
from chainweave.llm.queries import with_repeated_tails
from tests.llm.fixtures import documents, prose, table


def plain(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, 2 * p):
                found.setdefault((start, length), p)
    return sorted((s, m, p) for (s, m), p in found.items())


def collapsed(words, found):
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("grid", [7, 60, 1 << 16])
def test_is_brute_force(monkeypatch, grid):
    monkeypatch.setattr(runs, "GRID", grid)
    r = random.Random(grid)
    for _ in range(250):
        k, w = r.choice([1, 2, 3, 20]), []
        for _ in range(r.randrange(8)):
            block = [r.randrange(k) for _ in range(r.randrange(1, 14))]
            w += (block * 9)[:r.randrange(1, 6 * len(block))] if r.random() < 0.5 else block
        assert runs.find_runs(np.array(w, dtype=np.int64)) == plain(w)


def test_long_sequences_take_few_comparisons():
    assert runs.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    assert runs.find_runs(np.tile(np.arange(40_000), 3)[:100_001]) == [(0, 100_001, 40_000)]
    assert runs.find_runs(np.arange(200_000)) == []


def test_rows(spark):
    rows = documents() + [(100 + i, prose(i, 20) + " " + prose(i + 60, 1 + i % 9) * (2 + i % 7) + " x " + (prose(i, 3) + "\n") * (i % 11), "en", "a", 0, 0, "") for i in range(40)]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(table(spark, rows)).collect())
    want = []
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().split()]
        found = plain(words)
        want.append((str(r[0]), len(words), found, collapsed(words, found)))
    assert got == sorted(want)


def test_repeated_tails(spark):
    rows = documents() + [(100 + i, prose(i, i % 50), "en", "a", 0, 0, "") for i in range(150)]
    got = sorted((str(r.doc_id), (r.text or "").split()) for r in with_repeated_tails(table(spark, rows)).collect())
    want = []
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().split()]
        h, n = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append((str(r[0]), [x for w in words for x in w.split()]))
    assert got == sorted(want)


def test_empty(spark):
    assert runs.periodic_runs(table(spark, [])).count() == 0
