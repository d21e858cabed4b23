"""SimHash near-dedup with a generalised pigeonhole search.

Fingerprint: lower-case A-Z, cut at ASCII white space, XXH64 (seed 42) of each
3-word shingle with repeats; a bit is set where more than half the hashes set it.
Fingerprints differing in at most ``radius`` bits are linked; a document's
component is the smallest doc_id reachable.

Search (exact): bits are grouped so that correlated bits share a part (greedy on
the bit covariance over all fingerprints); thresholds t_i >= -1 with
sum(t_i) = radius - parts + 1 are allotted by dynamic programming on candidate
counts estimated from the same statistics (as is the number of parts). Any two
fingerprints within the radius agree within t_i bits on some part i, so each
fingerprint is filed under its part's value and, for t_i > 0, under all values
within one bit: two that differ in one or two bits of the part meet half way.
Only fingerprints filed under one key are compared, and a pair is linked under
the first key of its level that both have. Work is on distinct fingerprints.

What is filed is written once per level. Fingerprints of a key that holds more
than ``bucket`` of them are filed again by parts of their remaining bits (planned
with the statistics of these rows, each taken relative to its key's first
fingerprint), which keeps every link, level by level until ``LAST_BITS`` bits are
left: then a key holds at most all values of these. Inside a key only a spanning
set of links is emitted, never all pairs.

Cases: null or wordless text has fingerprint zero and is linked like any other;
null doc_ids take part and may connect others, but can't name a component (it is
null if no member has an id); repeated rows share their fingerprint; an empty
table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.plans.components import connected_components
from chainweave.plans.lineage import written

BUCKET, LAST_BITS = 4096, 12
VIA = 128  # via: part times VIA, plus the flipped bit's place in the part from 1, or 0
FILE_COST = 500.0  # of filing a fingerprint under a key, in comparisons


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [h(b" ".join(words), 42)]
    else:
        hashes = [h(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(width)))]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        a = np.ascontiguousarray(hashes[lo:lo + (1 << 16)]).view("u1").reshape(-1, 8)
        ones += np.unpackbits(a, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            own = np.array([fingerprint(x.as_py()) for x in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones per bit, covariance of bits, over all of them."""

    def run(batches):
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            a = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False)).view("u1").reshape(-1, 8)
            bits = np.unpackbits(a, axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_pydict({"pos": np.arange(4097, dtype=np.int32), "v": np.append(both.ravel(), n)})

    rows = fps.select("fp").mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(4097)
    for r in rows:  # 4,097 numbers, whatever the input
        v[r.pos] = r.v
    n = max(1.0, v[4096])
    both = v[:4096].reshape(64, 64) / n
    ones = both.diagonal().copy()
    return int(v[4096]), ones, both - np.outer(ones, ones)


def group_bits(ones: np.ndarray, cov: np.ndarray, bits: list[int], parts: int) -> list[list[int]]:
    """Split ``bits`` into parts of near-equal width, putting correlated bits together."""
    sd = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    corr, left, out = np.abs(cov) / np.outer(sd, sd), set(bits), []
    for p in range(parts):
        width = -(-len(left) // (parts - p))
        if not left:
            out.append([])
            continue
        seed = max(left, key=lambda b: (sd[b], -b))
        own = [seed]
        left.discard(seed)
        while len(own) < width:
            nxt = max(left, key=lambda b: (corr[b, own].mean(), -b))
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def estimated_candidates(n: int, ones: np.ndarray, cov: np.ndarray, part: list[int], t: int) -> float:
    """Expected pairs that agree within t bits on a part: chain of bits, each given its most correlated predecessor."""
    if t < 0 or not part:
        return 0.0 if t < 0 else float(n) ** 2
    agree, odds = 1.0, [1.0, 0.0, 0.0]  # odds: of no, one and two differing bits against none
    for i, b in enumerate(part):
        p = ones[b] ** 2 + (1 - ones[b]) ** 2
        if i:
            a = max(part[:i], key=lambda x: abs(cov[x, b]))
            p = min(1.0, p + 4 * cov[a, b] ** 2 / max(1e-9, ones[a] ** 2 + (1 - ones[a]) ** 2))
        agree *= p
        x = (1 - p) / max(p, 1e-9)
        odds = [odds[0], odds[1] + x * odds[0], odds[2] + x * odds[1]]
    met = [1.0] if t == 0 else [len(part) + 1.0, 2.0, 2.0]  # keys under which such a pair meets
    return float(n) ** 2 * agree * sum(k * o for k, o in zip(met, odds))


def allot(costs: list[list[float]], radius: int) -> tuple[float, list[int]] | None:
    """(total cost, thresholds): thresholds (index - 1 into each cost row) with sum radius - parts + 1 and the least total cost."""
    goal, best = radius - len(costs) + 1, {0: (0.0, [])}
    for row in costs:
        nxt: dict = {}
        for s, (c, ts) in best.items():
            for k, cost in enumerate(row):
                key, new = s + k - 1, (c + cost, [*ts, k - 1])
                if key not in nxt or new < nxt[key]:
                    nxt[key] = new
        best = nxt
    return best.get(goal)


def plan(n: int, ones: np.ndarray, cov: np.ndarray, bits: list[int], radius: int) -> tuple[list[list[int]], list[int]]:
    """Parts of ``bits`` and their thresholds, with the least estimated cost of filing and comparing."""
    best = None
    for parts in range(max(2, (radius + 3) // 3), radius + 3):
        groups = [g for g in group_bits(ones, cov, bits, parts) if g]
        if len(groups) < parts:
            break
        costs = []
        for g in groups:
            costs.append([0.0, *(FILE_COST * n * (len(g) + 1 if t else 1) + estimated_candidates(n, ones, cov, g, t) for t in range(min(2, radius, len(g)) + 1))])
        found = allot(costs, radius)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], groups, found[1])
    return best[1], best[2]


def _gather(fps: np.ndarray, part: list[int]) -> np.ndarray:
    v = np.zeros(len(fps), dtype=np.uint64)
    for j, b in enumerate(part):
        v |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return v


def _mix(level: int, i: int, before: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One 64-bit key of (outer key, level, part, value); a clash only adds comparisons."""
    x = before ^ (v + np.uint64((level * 64 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


class Plan:
    """How fingerprints of one kind are filed: the bits not yet used, parts of these and their thresholds."""

    def __init__(self, n: int, ones: np.ndarray, cov: np.ndarray, free: list[int], radius: int):
        self.free = free
        self.parts, self.ts = plan(n, ones, cov, free, radius)
        self.masks = [sum(1 << b for b in g) for g in self.parts]
        self.reach = [2 if t > 0 else t for t in self.ts]


def filed(fps: DataFrame, plans: list[Plan], level: int) -> DataFrame:
    """fps(key0, kind, fp) -> one row per key that a fingerprint is filed under; kind: its plan; via: part and flipped bit."""

    def run(batches):
        for b in batches:
            key0, kind, fp = (np.ascontiguousarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("key0", "kind", "fp"))
            for k in np.unique(kind).tolist():
                at = kind == k
                own, k0 = fp[at], key0[at].view(np.uint64)
                u = own.view(np.uint64)
                for i, (part, t) in enumerate(zip(plans[k].parts, plans[k].ts)):
                    if t < 0:
                        continue
                    v = _gather(u, part)
                    for flip in range(-1, len(part) if t else 0):
                        mask = np.uint64(1 << flip if flip >= 0 else 0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_mix(level, i, k0, v ^ mask).view(np.int64)), pa.array(np.full(len(own), k, np.int32)), pa.array(own),
                             pa.array(np.full(len(own), i * VIA + flip + 1, np.int32))], names=["key", "kind", "fp", "via"])

    return fps.mapInArrow(run, "key long, kind int, fp long, via int")


def block(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (places in a, places in b) of all fingerprints a with all b."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links (places) that connect ``fps`` as all its links do, and whether these are all of them; where they are many, at most one for each fingerprint: from the first one met, breadth first.

    Most have no neighbour, so neighbours are counted first, in blocks.
    """
    n, src, dst, few, held = len(fps), [], [], [], 0
    for lo in range(0, n, 256):
        x, y = block(fps[lo:lo + 256], fps, radius)
        up = x + lo < y
        few.append((x[up] + lo, y[up]))
        held += int(up.sum())
        if held > 4 * n:
            few = None
            break
    if few is not None:
        return (*(np.concatenate(c) for c in zip(*few)), True)
    todo = np.arange(n)
    while len(todo):
        seed, front, todo = todo[0], todo[:1], todo[1:]
        while len(front) and len(todo):
            near = np.zeros(len(todo), dtype=bool)
            for lo in range(0, len(front), 256):
                left = np.flatnonzero(~near)
                if len(left):
                    near[left[np.unique(block(fps[front[lo:lo + 256]], fps[todo[left]], radius)[1])]] = True
            front, todo = todo[near], todo[~near]
            src.append(np.full(len(front), seed))
            dst.append(front)
    return (np.concatenate(src), np.concatenate(dst), False) if src else (todo, todo, False)


def first_meeting(fp: np.ndarray, via: np.ndarray, a: np.ndarray, b: np.ndarray, own_plan: Plan) -> np.ndarray:
    """For rows a and b of one key whether no earlier key holds both: the first part within its threshold; there the shared value, else that of the smaller fingerprint or of the lower flip."""
    part, x = via[a] // VIA, fp[a] ^ fp[b]
    first = part == via[b] // VIA
    own = np.zeros(len(a), dtype=np.int64)
    for i, (mask, t) in enumerate(zip(own_plan.masks, own_plan.reach)):
        d = np.bitwise_count(x & np.uint64(mask)).astype(np.int64)
        first &= (part <= i) | (d > t)
        own = np.where(part == i, d, own)
    fa, fb = via[a] % VIA, via[b] % VIA
    low = fp[a] < fp[b]
    return first & np.where(own == 2, np.where(low, fa < fb, fb < fa), np.where(low, fa, fb) == 0)


def spanning_links(keyed: DataFrame, plans: list[Plan], radius: int, width: int) -> DataFrame:
    """src, dst: links that connect, key by key, what is linked there; a pair within small keys comes once."""

    def links(key, kind, fp, via):
        u, src, dst = fp.view(np.uint64), [], []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= 24, sizes)

        def once(a, b):
            keep = np.zeros(len(a), dtype=bool)
            for k in np.unique(kind[a]).tolist():
                at = np.flatnonzero(kind[a] == k)
                keep[at] = first_meeting(u, via, a[at], b[at], plans[k])
            src.append(a[keep])
            dst.append(b[keep])

        for k in range(1, min(24, len(key))):
            if not (sizes > k).any():
                break
            a = np.flatnonzero((key[k:] == key[:-k]) & small[k:])
            a = a[np.bitwise_count(u[a] ^ u[a + k]) <= radius]
            once(a, a + k)
        for s, n in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
            x, y, whole = spanning(u[s:s + n], radius)
            if whole:
                once(x + s, y + s)
            else:
                src.append(x + s)
                dst.append(y + s)
        src, dst = (fp[np.concatenate(c)] if c else fp[:0] for c in (src, dst))
        return pa.RecordBatch.from_arrays([pa.array(src[src != dst]), pa.array(dst[src != dst])], names=["src", "dst"])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for b in batches:
            rows = [np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "kind", "fp", "via"))]
            if not len(rows[0]):
                continue
            cut = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on in the next batch
            held = [r[cut:] for r in rows]
            if cut:
                yield links(*(r[:cut] for r in rows))
        yield links(*held)

    return keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def search(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """src, dst: links that connect the distinct fingerprints ``fps``(fp), a written table, as all pairs within the radius do."""
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, ones, cov = bit_statistics(fps)
    plans, todo, level, edges = [Plan(n, ones, cov, list(range(64)), radius)], fps.select(
        F.lit(0).cast("long").alias("key0"), F.lit(0).alias("kind"), "fp"), 0, None
    while True:
        keyed = written(filed(todo, plans, level), "simhash-filed")
        again, more = [], None
        if any(len(p.free) > LAST_BITS for p in plans):
            big = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where(F.col("n") > bucket), "simhash-big")
            c = F.col("n").cast("double")
            mean = big.agg(F.sum(c * c) / F.sum(c)).first()[0]  # rows that a row of these keys is compared with
            if mean is not None:
                # a kind for each part of each plan that can be cut further: their bits are used up
                kinds = [(k, i) for k, p in enumerate(plans) for i, t in enumerate(p.ts) if t >= 0 and len(p.free) > LAST_BITS]
                kind = F.create_map(*[F.lit(x) for j, (k, i) in enumerate(kinds) for x in (k * VIA + i, j)])[
                    F.col("kind") * VIA + F.floor(F.col("via") / VIA).cast("int")]
                over = written(keyed.join(big.drop("n"), "key").withColumn("next", kind).where("next is not null"), "simhash-over")
                _, ones, cov = bit_statistics(over.select(F.col("fp").bitwiseXOR(F.col("first")).alias("fp")))
                again = [Plan(math.ceil(mean), ones, cov, [b for b in plans[k].free if b not in plans[k].parts[i]], radius) for k, i in kinds]
                more = over.select(F.col("key").alias("key0"), F.col("next").alias("kind"), "fp")
                keyed = keyed.join(over.select("key").distinct(), "key", "left_anti")
        own = spanning_links(keyed, plans, radius, width)
        edges = own if edges is None else edges.union(own)
        if more is None:
            return edges
        plans, todo, level = again, more, level + 1


def components(rows: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """rows(doc_id, fp), a written table -> doc_id, fp, component_id."""
    own = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = connected_components(search(own.select("fp"), radius, bucket))
    named = own.join(found, own.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    rows = written(fingerprints(docs), "simhash-fp")
    return components(rows, radius, bucket).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
