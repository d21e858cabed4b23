import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from chainweave.llm import fim
from tests.llm.fixtures import documents, prose, table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def result(df):
    df = fim.fill_in_middle(df)
    return sorted(map(repr, df.select("*", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()))


def row_of(t):
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text")
    return "Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, t)) + ")"


def test_is_brute_force(spark):
    rows = documents() + [(200 + i, t, "en", "a", 0, 0, "") for i, t in enumerate(
        ["a <P> b", "<S>", "x<M", " lead", "trail \n", "　é\x1cß one\x0b two", "a<", "🤗 🤗", "\x85x y"] * 12)]
    rows += [(400 + i, "the same text in a third of all rows", "en", "a", 0, 0, "") for i in range(90)] + [(None, "the same text in a third of all rows", "en", "a", 0, 0, "")] * 40
    assert result(table(spark, rows)) == sorted(row_of(plain(r[0], r[1])) for r in rows)


def test_boundary_lists():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 200)
        values = np.cumsum([r.randrange(r.choice([1, 2, 9, 3000]) + 1) for _ in range(n)])
        ends = fim.EliasFano(values)
        assert [ends.select(i) for i in range(n)] == values.tolist()
    for text in (prose(4, 30), " a", "a ", "", " ", "é ß\n\n🤗x "):
        want = np.cumsum([len(u) for u in UNIT.findall(text)]).astype(int).tolist()
        assert fim.unit_ends(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == want
    long = fim.EliasFano(np.cumsum(np.full(10_000, 7)))
    assert long.nbytes < 5 * 10_000 / 8 + 16


def test_empty(spark):
    assert fim.fill_in_middle(table(spark, [])).count() == 0
