"""python -m tests.llm.brute_repeats DIR: every row of op4_repeats against all 400-byte windows of DIR/documents.parquet, held in memory."""

import hashlib
import sys
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

LENGTH = 400


def window_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all windows, from those of powers of two; not the operator's."""
    rng = np.random.default_rng(99)
    x, out, at, k = rng.integers(1 << 63, size=256, dtype=np.uint64)[raw], None, 0, 1
    n = len(raw) - LENGTH + 1
    while at < LENGTH:
        if LENGTH & k:
            out = x[at:at + n].copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + x[at:at + n]
            at += k
        x = (x[:-k] ^ (x[:-k] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + x[k:]
        k *= 2
    return out


def main() -> None:
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "24")
             .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="run-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from chainweave.llm.queries import op4_repeats

    docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet").select("doc_id", "text").toPandas()
    texts = [(t or "").encode() for t in docs.text]
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    starts = ends - lens
    began = time.time()
    h = window_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
    inside = np.zeros(len(h), dtype=bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        inside[a:max(a, b - LENGTH + 1)] = True
    s = np.sort(h[inside])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    hit = np.flatnonzero(inside)
    hit = hit[np.isin(h[inside], twice)]
    cover = np.zeros(int(ends[-1]) + 1, dtype=np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + LENGTH, -1)
    gone = np.cumsum(cover)[:-1] > 0
    want = {}
    for i, a, b, t in zip(docs.doc_id.tolist(), starts.tolist(), ends.tolist(), texts):
        g = gone[a:b]
        kept = np.frombuffer(t, dtype=np.uint8)[~g].tobytes()
        want.setdefault(i, []).append((b - a, int(g.sum()), int((np.diff(np.r_[0, g.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    print("windows", len(s), "seconds", round(time.time() - began, 1), flush=True)
    got: dict = {}
    for r in op4_repeats(spark, sys.argv[1]).toLocalIterator():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    differ = [i for i in want.keys() | got.keys() if sorted(want.get(i, [])) != sorted(got.get(i, []))]
    removed = {i for i, rows in want.items() if any(x[1] for x in rows)}
    print("documents", len(texts), "with removals", len(removed), "that differ", len(differ), "e.g.", [(want.get(i), got.get(i)) for i in differ[:3]])
    # lines of over 50 words that stand in several documents, by whether they reach LENGTH bytes
    lines: dict = {}
    for i, t in zip(docs.doc_id.tolist(), docs.text):
        for line in {x for x in (t or "").split("\n") if len(x.split()) > 50}:
            lines.setdefault(line, set()).add(i)
    some = {x: d for x, d in lines.items() if len(d) > 1}
    short = sum(len(x.encode()) < LENGTH for x in some)
    touched = set().union(*some.values()) if some else set()
    print("repeating lines", len(some), "shorter than", LENGTH, "bytes", short, "; their documents", len(touched), "with removals", len(touched & removed), "; removals elsewhere", len(removed - touched))
    spark.stop()


if __name__ == "__main__":
    main()
