"""Suffix-array dedup: bytes under repeated strings of ``length`` bytes, found by merging Burrows-Wheeler transforms.

1. Anchors. Every window of ``length`` bytes is filed under the least hash of
   its ``GRAM``-byte substrings, a function of the window alone, so equal windows
   meet under one anchor. Consecutive windows with one anchor form a segment.
   Only anchors that occur twice can hold a repeat; the rest is dropped here.
2. Equal segments of an anchor (by 64-bit digest besides the 64-bit anchor) are
   one string with a weight, their number.
3. Where an anchor has different segments, these are cut into symbols of
   ``symbol`` bytes at every offset (a window is ``length / symbol`` symbols).
   Shards of segments get their Burrows-Wheeler transforms by sorting, and all
   shards of a job are merged by interleave refinement: the interleave, a shard
   number per suffix, is re-sorted stably by the transforms' symbols, once per
   symbol of the window; after round t it is right for prefixes of t symbols, and
   a boundary that appears in round t has a common prefix of t - 1 symbols. No
   suffix is compared again. An interval whose prefix spans a window and whose
   weights sum to 2 or more is a repeat.
4. An anchor whose segments exceed ``group_bytes`` would not fit a task. Its
   segments are cut again, their windows filed under the least hash of their
   substrings of twice the length, and so on up to the whole window; the parts
   go the same way from step 2 on.
5. Repeated windows go back to their documents as byte ranges, joined there.

Cases: null text is empty; texts shorter than ``length`` keep all bytes;
repeated rows are occurrences of each other; null doc_ids are kept; an empty
table gives no rows; extra columns are ignored. Strings never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.plans.lineage import written

LENGTH, GRAM, SYMBOL = 400, 32, 40
CHUNK, RUN = 1 << 20, 4096  # bytes of a text, and windows of a segment, handled at once
SHARD_BYTES, JOB_BYTES, GROUP_BYTES = 1 << 17, 1 << 20, 1 << 24
_rng = np.random.RandomState(20240301)
_TABLES = [_rng.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + _rng.randint(0, 4, 256).astype(np.uint64) for _ in range(2)]
_ODD = [[np.uint64(int(x) * 2 + 1) for x in _rng.randint(1 << 40, 1 << 62, 40)] for _ in range(2)]


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit hash of every ``width``-byte substring, put together from powers of two."""
    x, k, out, done, bit = _TABLES[which][data], 1, None, 0, 0
    n = len(data) - width + 1
    while True:
        if width & k:
            part = x[done:done + n]
            out = part.copy() if out is None else out * _ODD[which][20 + bit] + part
            done += k
        if done == width:
            break
        x = x[:-k] * _ODD[which][bit] + x[k:]
        x ^= x >> np.uint64(31)
        k, bit = k * 2, bit + 1
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while s * 2 <= width:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[:len(x) - (width - s)], x[width - s:]) if width > s else x


def segments(data: bytes, length: int, gram: int):
    """(anchor, first window, last window, whether the anchor's value comes twice) of a text's segments."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out = []
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at:at + CHUNK + length - 1]
        h = rolling(part, gram)
        m = sliding_min(h, length - gram + 1)
        lo = np.r_[0, np.flatnonzero(m[1:] != m[:-1]) + 1]
        hi = np.r_[lo[1:], len(m)]
        if (hi - lo).max() > RUN:
            lo = np.concatenate([np.arange(a, b, RUN) for a, b in zip(lo, hi)])
            hi = np.r_[lo[1:], len(m)]
        values = m[lo]
        low = np.sort(h[h <= values.max()])
        twice = np.isin(values, low[1:][low[1:] == low[:-1]])
        out.append((values, at + lo, at + hi - 1, twice))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per segment: anchor m, digest d, document k1 k2, first and last window, twice."""
    from chainweave.llm.language import slices

    def run(batches):
        import xxhash

        h64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            for b in slices(batch):
                cols = [[] for _ in range(7)]
                for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text")):
                    data = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""
                    if len(data) < length:
                        continue
                    m, lo, hi, twice = segments(data, length, gram)
                    view = memoryview(data)
                    d = [h64(view[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist())]
                    for c, v in zip(cols, (m.view(np.int64), np.array(d, dtype=np.uint64).view(np.int64), np.full(len(m), k1), np.full(len(m), k2),
                                           lo.astype(np.int64), hi.astype(np.int64), twice)):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["m", "d", "k1", "k2", "lo", "hi", "twice"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "m long, d long, k1 long, k2 long, lo long, hi long, twice boolean")


# ---- Burrows-Wheeler transforms over symbols -------------------------------------------------------------------------


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable argsort of small non-negative integers by 16-bit digits."""
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if int(values.max(initial=0)) <= 0xFFFF:
        return low
    high = (values >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")]


class Shard:
    """Suffixes of some segments, at every byte offset, as sequences of symbols.

    A suffix starts at each place of the text that has a whole symbol, and an
    empty one stands after the last symbol of each offset class. ``symbol`` is
    what stands at a place (0: nothing), ``before`` what precedes it.
    """

    def __init__(self, lens: np.ndarray, ids: list[np.ndarray], step: int):
        # places 0 .. len of a segment: those past len - step hold no whole symbol and are the empty suffixes
        self.start = np.cumsum(lens + 1) - (lens + 1)
        n = int((lens + 1).sum())
        kind = ids[0].dtype if ids else np.int64  # holds the places of the job too, so it holds ranks
        symbol, before = np.zeros(n, dtype=kind), np.zeros(n, dtype=kind)
        keep = np.zeros(n, dtype=bool)
        nxt = np.full(n, n, dtype=np.int64)
        for s, length, x in zip(self.start.tolist(), lens.tolist(), ids):
            k = len(x)
            symbol[s:s + k] = x
            nxt[s:s + k] = np.arange(s + step, s + step + k)
            keep[s:s + min(k + step, length + 1)] = True
            before[s + step:s + step + k] = x
        self.place = np.flatnonzero(keep)
        where = np.full(n + 1, -1, dtype=np.int64)
        where[self.place] = np.arange(len(self.place))
        self.symbol, self.before, self.next = symbol[keep], before[keep], where[nxt[keep]]

    def transform(self, depth: int) -> np.ndarray:
        """Order of the suffixes by their first ``depth`` symbols; sets ``order`` and returns the transform in it."""
        n = len(self.symbol)
        rank, jump, have = self.symbol, self.next, 1
        while have < depth:  # prefix doubling inside the shard; the last step may look further than depth
            ahead = np.where(jump >= 0, rank[jump] + 1, 0)
            order = stable_order(ahead)
            order = order[stable_order(rank[order])]
            r, a = rank[order], ahead[order]
            new = np.empty(n, dtype=r.dtype)
            new[:1] = 0
            np.cumsum((r[1:] != r[:-1]) | (a[1:] != a[:-1]), out=new[1:])
            rank = np.empty(n, dtype=r.dtype)
            rank[order] = new
            jump = np.where(jump >= 0, jump[jump], -1)
            have *= 2
        self.order = stable_order(rank)
        return self.before[self.order]


def merge(transforms: list[np.ndarray], rounds: int):
    """Interleave of shards by refinement.

    Returns (z, common): the shard of each suffix in merged order, and how many
    symbols each suffix shares with the one before it (``rounds``: that many at least).
    """
    sizes = [len(t) for t in transforms]
    bwt = np.concatenate(transforms)
    n = len(bwt)
    kind = np.int32 if n < 1 << 31 else np.int64  # of places
    z = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) <= 256 else np.uint16), sizes)
    common, block, places = np.full(n, rounds, dtype=np.int16), np.zeros(n, dtype=kind), np.arange(n, dtype=kind)
    common[:1] = 0
    for t in range(rounds):
        item = np.empty(n, dtype=kind)  # the k-th suffix of a shard in the interleave is the k-th of the shard
        item[np.argsort(z, kind="stable")] = places
        symbol = bwt[item]
        to = stable_order(symbol)
        z, symbol, block = z[to], symbol[to], block[to]
        edge = np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])] if n else np.zeros(0, bool)
        common[edge & (common > t)] = t
        block = np.cumsum(edge, dtype=kind)
    return z, common


def repeated_windows(texts: list[bytes], weights: list[int], groups: list[int], length: int, step: int,
                     shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text which of its windows come twice among all texts, counted by weight."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum(lens) - lens
    hashes = rolling(raw, step)
    _, ids = np.unique(hashes, return_inverse=True)
    ids = (ids + 1).astype(np.int32 if len(raw) < 1 << 30 else np.int64)  # half the memory to move
    bins = np.cumsum(lens) // shard_bytes
    shards, transforms, of = [], [], []
    for s in np.unique(bins):
        own = np.flatnonzero(bins == s)
        shard = Shard(lens[own], [ids[starts[i]:starts[i] + lens[i] - step + 1] for i in own], step)
        transforms.append(shard.transform(length // step))
        shards.append(shard)
        of.append(own)
    z, common = merge(transforms, length // step)
    first = np.cumsum([0, *(len(t) for t in transforms)])
    item = np.empty(len(z), dtype=np.int64)
    item[np.argsort(z, kind="stable")] = np.arange(len(z))
    interval = np.cumsum(common < length // step) - 1  # equal in all symbols of a window
    weight, out = np.empty(len(z), dtype=np.int64), []
    place, text = np.empty(len(z), dtype=np.int64), np.empty(len(z), dtype=np.int64)
    for k, (shard, own) in enumerate(zip(shards, of)):
        at = shard.place[shard.order]
        which = np.searchsorted(shard.start, at, side="right") - 1
        sl = slice(first[k], first[k + 1])
        text[sl], place[sl] = own[which], at - shard.start[which]
    weight = np.array(weights, dtype=np.int64)[text]
    whole = place <= lens[text] - length
    text, place, weight, whole = text[item], place[item], weight[item], whole[item]
    total = np.bincount(interval[whole], weights=weight[whole], minlength=int(interval[-1]) + 1 if len(z) else 0)
    hit = whole & (total[interval] >= 2)
    base = np.cumsum(np.maximum(lens - length + 1, 0)) - np.maximum(lens - length + 1, 0)
    flags = np.zeros(int(np.maximum(lens - length + 1, 0).sum()), dtype=bool)
    flags[base[text[hit]] + place[hit]] = True
    for b, n in zip(base.tolist(), np.maximum(lens - length + 1, 0).tolist()):
        out.append(flags[b:b + n])
    return out


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _found(m, d, spans):
    return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(d, pa.int64()),
                                       pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _RANGES)], names=["m", "d", "windows"])


FOUND = "m long, d long, windows array<struct<a:long,b:long>>"


def merged_repeats(texts: DataFrame, length: int, step: int, width: int, shard_bytes: int, job_bytes: int) -> DataFrame:
    """texts(m, d, n, data): repeated windows of the segments, by merged transforms; an anchor's segments share a job."""

    def job(rows):
        m, d, n, data = zip(*rows)
        flags = repeated_windows(list(data), list(n), list(m), length, step, shard_bytes)
        own = [(a, b, r) for a, b, r in zip(m, d, map(ranges, flags)) if r]
        return _found(*zip(*own)) if own else _found([], [], [])

    def run(batches):
        rows, size, last, seen = [], 0, None, set()
        for batch in batches:
            for m, d, n, data in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "n", "data"))):
                if m != last and size >= job_bytes:
                    yield job(rows)
                    rows, size = [], 0
                if m != last:
                    last, seen = m, set()
                if d not in seen:
                    seen.add(d)
                    rows.append((m, d, n, data))
                    size += len(data)
        if rows:
            yield job(rows)

    return texts.repartition(width, "m").sortWithinPartitions("m", "d").mapInArrow(run, FOUND)


def cut_again(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts(m, d, n, data) -> the parts of each segment by anchors of ``gram`` bytes: m, d, n, lo (its first window in the whole), m2, d2, data."""

    def run(batches):
        import xxhash

        for batch in batches:
            for m, d, n, data in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "n", "data"))):
                values, lo, hi, _ = segments(data, length, gram)
                parts = [data[a:b] for a, b in zip(lo.tolist(), (hi + length).tolist())]
                own = np.array([xxhash.xxh3_64_intdigest(x) for x in parts], dtype=np.uint64).view(np.int64)
                anchor = (values ^ (np.array([m]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                k = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, m)), pa.array(np.full(k, d)), pa.array(np.full(k, n)), pa.array(lo.astype(np.int64)),
                                                  pa.array(anchor), pa.array(own), pa.array(parts, pa.binary())], names=["m", "d", "n", "lo", "m2", "d2", "data"])

    return texts.mapInArrow(run, "m long, d long, n long, lo long, m2 long, d2 long, data binary")


def distinct_repeats(texts: DataFrame, length: int, gram: int, step: int, width: int, shard_bytes: int, job_bytes: int, group_bytes: int) -> DataFrame:
    """texts(m, d, n, data, bytes: of all the anchor's segments): the repeated windows of each segment, as m, d, windows."""
    if gram >= length:  # all windows of an anchor are equal: its segments are runs of one window, at most one for each length
        return merged_repeats(texts, length, step, width, shard_bytes, job_bytes)
    found, large = merged_repeats(texts.where(F.col("bytes") <= group_bytes), length, step, width, shard_bytes, job_bytes), texts.where(F.col("bytes") > group_bytes)
    if large.isEmpty():
        return found
    gram = min(length, 2 * gram)
    parts = written(cut_again(large.dropDuplicates(["m", "d"]), length, gram), "repeat-parts")
    kinds = written(parts.groupBy("m2", "d2").agg(F.sum("n").alias("n"), F.min("data").alias("data")), "repeat-part-kinds")
    per = kinds.groupBy("m2").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count(F.lit(1)).alias("kinds"))
    kinds = kinds.select(F.col("m2").alias("m"), F.col("d2").alias("d"), "n", "data").join(per.withColumnRenamed("m2", "m"), "m")
    windows = F.octet_length("data") - length
    copies = kinds.where("n > 1").select("m", "d", F.array(F.struct(F.lit(0).cast("long").alias("a"), windows.cast("long").alias("b"))).alias("windows"))
    mixed = kinds.where((F.col("kinds") > 1) | (windows > 0)).drop("kinds")
    inner = copies.union(distinct_repeats(mixed, length, gram, step, width, shard_bytes, job_bytes, group_bytes))
    inner = inner.select(F.col("m").alias("m2"), F.col("d").alias("d2"), "windows")
    shifted = F.transform("windows", lambda w: F.struct((w["a"] + F.col("lo")).alias("a"), (w["b"] + F.col("lo")).alias("b")))
    return found.union(parts.select("m", "d", "lo", "m2", "d2").join(inner, ["m2", "d2"]).select("m", "d", shifted.alias("windows")))


def removed_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL, shard_bytes: int = SHARD_BYTES,
                    job_bytes: int = JOB_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row of ``docs``."""
    step = max(s for s in range(1, symbol + 1) if length % s == 0)
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(7), "doc_id")})
    rows = written(segment_rows(keyed, length, gram), "repeat-segments")
    # anchors that come twice: a count per anchor first, so that single ones go no further
    anchors = rows.groupBy("m").agg(F.count("*").alias("rows"), F.max("twice").alias("twice")).where("rows > 1 or twice").select("m")
    rows = written(rows.join(anchors, "m", "left_semi"), "repeat-candidates")
    kinds = rows.groupBy("m", "d").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("at"))
    kinds = written(kinds, "repeat-kinds")
    per = kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.max("twice").alias("any_twice"),
                                 F.sum(F.col("at.hi") - F.col("at.lo") + length).alias("bytes"))
    kinds = kinds.join(per, "m")
    # copies of one segment: all its windows are repeated, whatever else the anchor holds
    copies = kinds.where("n > 1").select("m", "d", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("at.hi") - F.col("at.lo")).alias("b"))).alias("windows"))
    mixed = kinds.where("kinds > 1 or any_twice").select("m", "d", "n", "at.*", "bytes")
    wanted = mixed.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "d", "n", "lo", "hi", "bytes")).alias("cuts"))

    def cut(batches):
        from chainweave.llm.language import slices

        for batch in batches:
            for b in slices(batch):
                out = [[] for _ in range(5)]
                for t, cuts in zip(b.column("text"), b.column("cuts").to_pylist()):
                    data = t.as_py().encode("utf-8", "surrogatepass")
                    for c in cuts:
                        for o, v in zip(out, (c["m"], c["d"], c["n"], data[c["lo"]:c["hi"] + length], c["bytes"])):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                                                 names=["m", "d", "n", "data", "bytes"])

    texts = written(keyed.join(wanted, ["k1", "k2"]).select("text", "cuts").mapInArrow(
        cut, "m long, d long, n long, data binary, bytes long"), "repeat-texts")
    found = copies.union(distinct_repeats(texts, length, gram, step, width, shard_bytes, job_bytes, group_bytes))
    places = rows.join(found, ["m", "d"]).select("k1", "k2", "lo", F.explode("windows").alias("w")).select(
        "k1", "k2", (F.col("lo") + F.col("w.a")).alias("a"), (F.col("lo") + F.col("w.b") + length).alias("b"))
    places = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("cover"))

    def strip(batches):
        from chainweave.llm.language import slices

        for batch in batches:
            for b in slices(batch):
                out = []
                for doc, t, cover in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("cover").to_pylist()):
                    data = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""
                    kept, at, spans, n = [], 0, 0, 0
                    end = -1
                    for x, y in sorted((c["a"], c["b"]) for c in cover or ()):
                        if x > end:
                            spans += 1
                            kept.append(data[at:x])
                        n += max(0, y - max(x, end))
                        end = at = max(end, y)
                    kept = b"".join([*kept, data[at:]])
                    out.append((doc, len(data), n, spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds_)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return keyed.join(places, ["k1", "k2"], "left").select("doc_id", "text", "cover").mapInArrow(
        strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
