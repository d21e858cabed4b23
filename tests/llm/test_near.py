"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random

from chainweave.llm import near
from tests.llm.fixtures import table


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def text(r, n, vocabulary=5000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def changed(r, words, kind, share):
    n = max(1, int(len(words) * share))
    if kind == "appended":
        return words + text(r, n)
    if kind == "deleted":
        at = r.randrange(len(words) - n)
        return words[:at] + words[at + n:]
    out = list(words)
    for i in r.sample(range(len(out)), max(1, n // 5)):
        out[i] = f"new{r.randrange(10**6)}"
    return out


def found(spark, texts, **more):
    rows = [(i, t, "en", "a", 0, 0, "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, rows), **more).collect()}
    return [got[i] for i in range(len(texts))]


def test_edited_copies_are_brute_force(spark):
    """Appended, deleted and substituted copies on both sides of 0.8: what is linked is what brute force links."""
    r, texts = random.Random(11), []
    for kind in ("appended", "deleted", "substituted"):
        for k in range(40):
            words = text(r, 200 if k % 2 else 700, 400 if k % 4 == 0 else 5000)
            texts += [" ".join(words), " ".join(changed(r, words, kind, 0.05 + 0.25 * k / 40))]
    want = brute(texts)
    assert 40 < sum(w != i for i, w in enumerate(want)) < 110
    assert found(spark, texts) == want


def test_repeated_line_weighs_once(spark):
    line = "the same line again and again "
    r = random.Random(12)
    texts = [line * 400 + " ".join(text(r, 60)) for _ in range(4)]
    assert found(spark, texts) == [0, 1, 2, 3]


def test_exact_links_and_blocks(spark):
    """A group dealt into blocks, a chain that only neighbours link, and texts near the limit."""
    r = random.Random(13)
    words, texts = text(r, 300), []
    for _ in range(40):
        texts.append(" ".join(words))
        words = words[12:] + text(r, 12)
    base = text(r, 200)
    texts += [" ".join(changed(r, base, "substituted", 0.08 * (1 + k % 3))) for k in range(60)]
    want = brute(texts)
    sets = [near.shingles(t) for t in texts]
    rng = list(range(len(texts)))
    for i, j in near.exact_links(sets, 0.8):
        a, b = rng[i], rng[j]
        rng = [min(a, b) if x in (a, b) else x for x in rng]
    assert rng == want
    assert found(spark, texts) == found(spark, texts, tokens=3000) == want


def test_short_and_empty_texts(spark):
    texts = ["", " . ", "one two", "One two!", "one three", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h j k"]
    want = [0, 0, 2, 2, 4, 5, 5, 7]
    assert found(spark, texts) == want


def test_pipeline_stage_keeps_one_row_of_each_group(spark):
    """Equal ids with different texts, and copies without an id."""
    import corpus_pipeline

    r = random.Random(14)
    a, b, c, d = (" ".join(text(r, 80)) for _ in range(4))
    rows = [(i, t, "en", "a", 0, 0, "") for i, t in [(1, a), (5, b), (5, a), (5, b), (None, c), (None, c), (None, d), (7, d), (None, a)]]
    out = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "")
    assert sorted((str(x.doc_id), x.text) for x in out.collect()) == sorted([("1", a), ("5", b), ("None", c), ("7", d)])
    assert out.columns == table(spark, rows).columns
