"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

WORDS = "the of and amber basin candle dwarf ember fable garden hollow island jungle kettle lantern meadow needle orchard pebble quarry river saddle timber urchin velvet willow yonder zephyr".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) * (r.random() < 0.6) for _ in range(n))


def documents():
    base, passage = prose(1, 260), prose(2, 90)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base.replace(" ", "  ", 1), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "a"),
        (6, prose(3, 150) + " " + passage + " " + prose(4, 50), "en", "b"), (7, prose(5, 20) + " " + passage, None, "c"), (8, "one", "en", "c"), (9, "One two", "fr", None),
        (10, "ab" * 900, "en", "a"), (11, prose(6, 6000), "en", "a"), (12, prose(7, 300), "en", "d"), (12, prose(7, 300), "en", "d"), (None, prose(8, 40), "en", "a"),
        (13, "the river " * 300, "en", "b"), (14, prose(9, 200).upper(), "en", "b"), (15, "é" * 450 + " ß\u00a0x", "de", "a"),
    ]
    return [(d, t, g, s, len(t or ""), d, "x") for d, t, g, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, key string"


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
