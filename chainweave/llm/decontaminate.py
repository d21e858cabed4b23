"""Benchmark decontamination by spaced seeds.

Texts become words: lower case, ASCII punctuation as spaces. Fixed masks
(``MASKS``) read some of a window's positions and ignore the others, so one hash
survives substitutions at ignored positions. Masked windows of the documents are
joined with those of the benchmark by mask and hash; each hit names a diagonal (a
placement of the item over the document), on which all words are compared. A
document overlaps an item where a window of ``WINDOW`` words (the whole item, if
shorter) agrees in at least ``AGREE`` of its places.

Items of up to ``SHORT`` words get masks of their own length, one for each set of
places that may differ, so that no placement that passes is missed.

Most windows of the documents hit nothing. So that these aren't shuffled, the
benchmark's hashes fill a bit filter of ``BITS_A_SEED`` bits each, at most
2 ** ``MOST_BITS`` in all, which is what is broadcast; documents are read once,
and only windows that pass it, with the words of their documents, go to the join.
A larger benchmark lets more windows pass, and loses none.

Cases: null and empty texts overlap nothing, nor do items without words; items of
fewer than five words must agree in every word; null doc_ids are kept; repeated
documents and items are reported each; empty tables give no overlaps; extra
columns are ignored (and kept by ``decontaminated``).
"""

from __future__ import annotations

import math
import string
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.llm.language import slices
from chainweave.plans.lineage import written

#: 1: position is read, 0: ignored
MASKS = ("1101011", "111001011", "1001101011", "11100000111")
WINDOW, AGREE, SHORT = 13, 0.8, 10
BITS_A_SEED, LEAST_BITS, MOST_BITS = 1024, 16, 29
CACHE_WORDS = 300_000
_PUNCT = str.maketrans(dict.fromkeys(string.punctuation, " "))
_ODD = np.random.RandomState(20240229).randint(1, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    import xxhash

    words = (text or "").lower().translate(_PUNCT).split()
    if len(_words) > CACHE_WORDS:
        _words.clear()
    get, h = _words.get, xxhash.xxh64_intdigest
    out = [get(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                out[i] = _words[w] = _words.get(w) or h(w.encode("utf-8", "surrogatepass"))
    return np.array(out, dtype=np.uint64)


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window's read positions."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.full(n, len(mask) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            x += words[k:k + n] * _ODD[k]
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def agreeing(n: int) -> int:
    """Words of a window of n that must agree."""
    return math.ceil(AGREE * n - 1e-9)


def short_masks(n: int) -> list[str]:
    """Masks of n positions, one for each set of ignored ones that the verification accepts."""
    return ["".join("0" if k in off else "1" for k in range(n)) for off in combinations(range(n), n - agreeing(n))]


#: (mask, words of the items that it serves: None for those of more than SHORT)
ALL_MASKS = [*((m, None) for m in MASKS), *((m, n) for n in range(1, SHORT + 1) for m in short_masks(n))]


def seeds_of(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(mask's number, hash of each window) of an item."""
    size = len(words) if len(words) <= SHORT else None
    return [(k, masked(words, mask)) for k, (mask, n) in enumerate(ALL_MASKS) if n == size and len(words)]


def benchmark_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: item, item_id, words; seeds: mask, hash, item, at) of benchmark(item_id, text)."""

    def words(batches):
        for b in batches:
            own = [word_hashes(x.as_py()).view(np.int64) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(own, pa.list_(pa.int64()))], names=["item", "item_id", "words"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(rows.mapInArrow(words, "item long, item_id long, words array<long>"), "benchmark-items")

    def seed(batches):
        for b in batches:
            for item, x in zip(b.column("item").to_pylist(), b.column("words")):
                for mask, h in seeds_of(x.values.to_numpy().view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), mask, np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)),
                                                      pa.array(np.arange(len(h)))], names=["mask", "hash", "item", "at"])

    return items, written(items.mapInArrow(seed, "mask int, hash long, item long, at long"), "benchmark-seeds")


class Filter:
    """Bits of the benchmark's hashes: two for each, in a table of bounded size; ``masks`` are those in use."""

    def __init__(self, seeds: DataFrame):
        self.masks = sorted(r[0] for r in seeds.select("mask").distinct().collect())  # at most len(ALL_MASKS)
        self.bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_SEED * seeds.count()).bit_length()))
        place = F.explode(F.array(F.shiftrightunsigned("hash", 64 - self.bits), F.shiftrightunsigned("hash", 0).bitwiseAND(F.lit((1 << self.bits) - 1))))
        rows = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
        table = np.zeros(1 << (self.bits - 6), dtype=np.int64)  # the filter itself: 2 ** MOST_BITS bits at most
        table[rows["w"].to_numpy()] = rows["v"].to_numpy()
        self.table = table.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that may be among the benchmark's."""
        bit = lambda p: (self.table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)
        at = np.flatnonzero(bit(hashes >> np.uint64(64 - self.bits)))
        return at[bit(hashes[at] & np.uint64((1 << self.bits) - 1)).astype(bool)]


def seeded(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents some window of which passes the filter: doc, doc_id, text_hash, words, hits(mask, hash, pos); a written table."""
    held = docs.sparkSession.sparkContext.broadcast(Filter(seeds))
    hit = pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        passes = held.value
        for batch in batches:
            for b in slices(batch):
                docs_ = [word_hashes(t) for t in b.column("text").to_pylist()]
                lens = np.array([len(d) for d in docs_], dtype=np.int64)
                words, doc, start, found = np.concatenate(docs_), np.repeat(np.arange(len(docs_)), lens), np.cumsum(lens) - lens, {}
                for k in passes.masks:
                    x = masked(words, ALL_MASKS[k][0])
                    at = passes.has(x)
                    at = at[doc[at] == doc[at + len(ALL_MASKS[k][0]) - 1]]  # windows that don't cross documents
                    for d, p, h in zip(doc[at].tolist(), at.tolist(), x[at].view(np.int64).tolist()):
                        found.setdefault(d, []).append({"mask": k, "hash": h, "pos": p - int(start[d])})
                own = sorted(found)
                part = b.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([docs_[d].view(np.int64) for d in own], pa.list_(pa.int64())),
                     pa.array([found[d] for d in own], pa.list_(hit))], names=["doc_id", "text_hash", "words", "hits"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, text_hash long, words array<long>, hits array<struct<mask:int,hash:long,pos:long>>")
    return written(rows.withColumn("doc", F.monotonically_increasing_id()), "benchmark-hits")


def agreement(words: np.ndarray, own: np.ndarray, first: int) -> tuple[int, int, int] | None:
    """(words that agree, first, end) of an item placed at ``first`` of a document, from the first to the last window that passes."""
    a, b = max(0, first), min(len(words), first + len(own))
    w = min(WINDOW, len(own))
    if not w or b - a < w:
        return None
    same = np.cumsum(np.r_[0, words[a:b] == own[a - first:b - first]])
    good = np.flatnonzero(same[w:] - same[:-w] >= agreeing(w))
    if not len(good):
        return None
    x, y = int(good[0]), int(good[-1] + w)
    return int(same[y] - same[x]), a + x, a + y


def found_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, start, end, n_agree: one row per document and overlapped item, the longest placement."""
    items, seeds = benchmark_tables(benchmark)
    hits = seeded(docs, seeds)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hits.select("doc", F.explode("hits").alias("h")).select("doc", "h.*").join(seeds, ["mask", "hash"]).select(
        "doc", "item", (F.col("pos") - F.col("at")).alias("first")).distinct()
    placed = placed.join(items, "item").select("doc", "item", "first", "item_id", "words", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_hash"))
    none = F.lit(None).cast("long")
    rows = hits.select("doc", none.alias("item"), none.alias("first"), none.alias("item_id"), "words", "doc_id", "text_hash").union(placed)

    def run(batches):
        """A document's words come first, then its placements, item by item."""
        item = best = held = None
        out = []

        def flush():
            if best is not None:
                out.append((*held[:2], item[1], best[1], best[2], best[0]))

        for b in batches:
            words = b.column("words")
            for i, (it, first, item_id, *ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("item", "first", "item_id", "doc_id", "text_hash")))):
                if it is None:
                    flush()
                    item, best, held = None, None, (*ids, words[i].values.to_numpy())
                    continue
                if item is None or item[0] != it:
                    flush()
                    item, best = (it, item_id), None
                got = agreement(held[2], words[i].values.to_numpy(), first)
                if got and (best is None or (got[0], -got[1], got[2]) > (best[0], -best[1], best[2])):
                    best = got
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 6)],
                                             names=["doc_id", "text_hash", "item_id", "start", "end", "n_agree"])
            out = []
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 6)],
                                         names=["doc_id", "text_hash", "item_id", "start", "end", "n_agree"])

    return rows.repartition(width, "doc").sortWithinPartitions("doc", F.col("item").asc_nulls_first(), "first").mapInArrow(
        run, "doc_id long, text_hash long, item_id long, start long, end long, n_agree long")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (words of the document), n_agree: one row per document and overlapped item."""
    return found_overlaps(docs, benchmark).drop("text_hash")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item; columns as they are."""
    bad = written(found_overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "benchmark-bad")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash")), "left_anti")
