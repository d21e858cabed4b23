"""SimHash near-dedup on five-word shingles: documents with a Jaccard similarity of ``similarity`` or more are linked.

Words are those of decontaminate (lower case, ASCII punctuation as spaces); a
text of fewer than five words is one shingle. A set counts each shingle once.

Candidates: SimHash fingerprints of the sets within ``RADIUS`` bits, found by the
generalised pigeonhole search of simhash. At a similarity of 0.8 about 10 of 64
bits differ, further than any selective part reaches, so this alone would lose
most such pairs; sets that agree in one of several bands of ``ROWS`` min-hashes
are candidates too: a pair at the similarity shares a band with probability
``RECALL``, one above it more surely. Candidates chain into groups, each set
travels once to its group (a group of more than ``TOKENS`` shingles is dealt into
blocks, and every two blocks meet), and there every pair is compared by its exact
Jaccard similarity: an inverted index over the rarest shingles finds all that can
reach it. What comes out connects a group exactly as all its links do, never all
pairs.

Cases: texts without words have the empty set and are copies of one another;
null doc_ids are kept but can't name a component (it is null if no other member
has an id); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.llm.decontaminate import masked, word_hashes
from chainweave.llm.simhash import majority, search
from chainweave.plans.components import connected_components
from chainweave.plans.lineage import written

RADIUS, ROWS, RECALL, TOKENS = 3, 6, 0.9999, 1 << 21
SLACK = 1e-9


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's five-word shingles, ascending."""
    words = word_hashes(text)
    return np.unique(masked(words, "1" * min(5, len(words)))) if len(words) else words


def set_id(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - similarity**ROWS)) if similarity < 1 else 1


def multipliers(bands: int) -> np.ndarray:
    return np.random.RandomState(20240301).randint(1, 1 << 62, bands * ROWS + ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(own: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """One key per band of ROWS min-hashes."""
    low = np.full(len(odd) - ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(own), 256):
        low = np.minimum(low, (own[lo:lo + 256, None] * odd[None, ROWS:]).min(axis=0))
    low = low.reshape(-1, ROWS)
    x = ((low ^ (low >> np.uint64(32))) * odd[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(len(low), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def with_text_hash(docs: DataFrame) -> DataFrame:
    """``docs`` and text_hash, which with doc_id names a row's content."""
    return docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))


def simhash_of(own: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes, as a signed long."""
    x = (own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    fp = majority(x ^ (x >> np.uint64(29)))
    return fp - (fp >> 63 << 64)


def _sets(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_hash, set_id, n (shingles), bands and fp of every row; none of both where no other set can be similar."""
    odd = multipliers(bands_for(similarity))
    # n shingles differ from another set in one at least: below similarity when n / (n + 1) is
    least = next(n for n in range(1, 1 << 30) if n / (n + 1) >= similarity - SLACK) if similarity < 1 else 1 << 62

    def run(batches):
        for b in batches:
            own = [shingles(x.as_py()) for x in b.column("text")]
            keys = [band_keys(x, odd) if len(x) >= least else np.zeros(0, np.int64) for x in own]
            fps = [simhash_of(x) if len(x) >= least else None for x in own]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([set_id(x) for x in own], pa.int64()),
                 pa.array([len(x) for x in own], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "set_id", "n", "bands", "fp"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, set_id long, n long, bands array<long>, fp long")


def _stars(keyed: DataFrame, width: int) -> DataFrame:
    """src, dst: each set linked with the first of its band."""

    def run(batches):
        key = first = None
        for b in batches:
            k, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "set_id"))
            if not len(k):
                continue
            starts = np.r_[True, k[1:] != k[:-1]]
            heads = v[np.maximum.accumulate(np.where(starts, np.arange(len(k)), 0))]
            if key is not None and k[0] == key:
                heads = np.where(k == key, first, heads)
            key, first = k[-1], heads[-1]
            on = heads != v
            yield pa.RecordBatch.from_arrays([pa.array(heads[on]), pa.array(v[on])], names=["src", "dst"])

    return keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long").distinct()


def _index(tokens: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(tokens, kind="stable")
    return np.searchsorted(tokens[order], np.arange(n + 1)), docs[order]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def exact_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect the sets as all pairs with that Jaccard similarity or more do."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if len(sets) < 2 or not sizes.sum():
        return []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), sizes)
    # shingles of each set by rarity; a set that reaches the similarity shares one of the first few of both
    by = np.lexsort((token, count[token], doc))
    token, start = token[by], np.cumsum(sizes) - sizes
    prefix = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - SLACK).astype(np.int64) + 1, 0)
    at = _ranges(start, start + np.minimum(prefix, sizes))
    left, begin = np.ones(len(sets), dtype=bool), None
    mark, out, todo, indexed, remain = np.zeros(len(count), dtype=bool), [], [], 0, len(sets)
    for seed in range(len(sets)):
        if not remain:
            break
        if not left[seed]:
            continue
        left[seed], remain, todo = False, remain - 1, [seed]
        while todo and remain:
            if begin is None or 2 * remain < indexed:  # without those already placed
                at = at[left[doc[at]]]
                begin, posted = _index(token[at], doc[at], len(count))
                indexed = remain
            x = todo.pop()
            own = token[start[x]:start[x] + prefix[x]]
            near = posted[_ranges(begin[own], begin[own + 1])]
            near = np.unique(near[left[near]])
            near = near[np.minimum(sizes[near], sizes[x]) >= similarity * np.maximum(sizes[near], sizes[x]) - SLACK]
            if not len(near):
                continue
            mine = token[start[x]:start[x] + sizes[x]]
            mark[mine] = True
            hits = []
            for lo in range(0, len(near), 1024):
                some = near[lo:lo + 1024]
                n = sizes[some]
                hits.append(np.add.reduceat(mark[token[_ranges(start[some], start[some] + n)]].astype(np.int64), np.cumsum(n) - n))
            mark[mine] = False
            both = np.concatenate(hits)
            near = near[both >= similarity * (sizes[near] + sizes[x] - both) - SLACK]
            left[near], remain = False, remain - len(near)
            out.extend((x, int(y)) for y in near)
            todo.extend(near.tolist())
    return out


def _verified(shipped: DataFrame, similarity: float, width: int) -> DataFrame:
    """shipped(key, set_id, text) -> src, dst: exact links within each key."""

    def links(ids, sets):
        ids = np.array(ids, dtype=np.int64)
        found = np.array(exact_links(sets, similarity), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["src", "dst"])

    def run(batches):
        key, ids, sets = None, [], []
        for b in batches:
            for k, i, text in zip(b.column("key").to_pylist(), b.column("set_id").to_pylist(), b.column("text")):
                if k != key:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    key, ids, sets = k, [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    sets.append(shingles(text.as_py()))
        if len(ids) > 1:
            yield links(ids, sets)

    return shipped.repartition(width, "key").sortWithinPartitions("key", "set_id").mapInArrow(run, "src long, dst long")


def grouped(docs: DataFrame, similarity: float = 0.8, tokens: int = TOKENS) -> DataFrame:
    """doc_id, text_hash and component (a set's id) for every row of ``docs``."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = with_text_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = written(_sets(docs, similarity), "near-sets")
    keyed = rows.dropDuplicates(["set_id"]).select(F.explode("bands").alias("key"), "set_id")
    # sets of one fingerprint form a star, linked fingerprints an edge between the middles of theirs
    prints = rows.where("fp is not null").select("fp", "set_id").distinct()
    middles = written(prints.groupBy("fp").agg(F.min("set_id").alias("mid")), "near-prints")
    close = search(middles.select("fp"), RADIUS)
    close = close.join(middles.select(F.col("fp").alias("src"), F.col("mid").alias("a")), "src").join(
        middles.select(F.col("fp").alias("dst"), F.col("mid").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    own = prints.join(middles, "fp").where("set_id <> mid").select(F.col("mid").alias("src"), F.col("set_id").alias("dst"))
    groups = connected_components(_stars(keyed, width).union(close).union(own)).withColumnRenamed("component", "cluster")
    # one row of each set that has candidates
    held = rows.groupBy("set_id").agg(F.min("n").alias("n"), F.min(F.struct("text_hash", "doc_id")).alias("row")).join(
        groups.withColumnRenamed("node", "set_id"), "set_id")
    held = written(held.select("set_id", "n", "cluster", F.col("row.text_hash").alias("h"), F.col("row.doc_id").alias("d")), "near-groups")
    blocks = held.groupBy("cluster").agg(F.ceil(F.sum("n") / tokens).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    held = held.join(blocks, "cluster").withColumn("own", own)
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own")))
    # equal rows ship one text: what makes a row is grouped, and the groups stay where they are for the join
    row = lambda h, d: [F.col(h).alias("h"), F.coalesce(d, F.lit(0)).alias("d0"), F.col(d).isNull().alias("none")]
    texts = docs.select(*row("text_hash", "doc_id"), "text").groupBy("h", "d0", "none").agg(F.first("text").alias("text"))
    shipped = texts.join(held.select("cluster", "set_id", "blocks", "own", *row("h", "d")), ["h", "d0", "none"]).select("cluster", "set_id", "text", "own", F.explode(others).alias("other")).select(
        F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "set_id", "text")
    found = connected_components(_verified(shipped, similarity, width))
    return rows.select("doc_id", "text_hash", "set_id").join(found, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", "text_hash", F.coalesce("component", "set_id").alias("component"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, tokens: int = TOKENS) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the copies) for every row of ``docs``."""
    rows = written(grouped(docs, similarity, tokens), "near-rows")
    names = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "component").select("doc_id", "component_id")


def survivors(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash: one row of each group of copies, that with the smallest doc_id (none only if no other has one)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    return grouped(docs, similarity).groupBy("component").agg(first).select("row.doc_id", "row.text_hash")
