"""Clonotypes and clonotype clusters: equal configurations, pair distances, components.

Input is a wide table: cell_id, cell_ord, has_ir and, per arm and chain, the
columns {arm}_{n}_{junction or junction_aa}, {arm}_{n}_v_call, {arm}_{n}_j_call.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.operators.communities import fastgreedy, fastgreedy_of_cliques, leiden, leiden_of_cliques
from chainweave.operators.distances import ir_dist, sequences
from chainweave.plans.components import connected_components
from chainweave.plans.lineage import cut, written
from chainweave.plans.numbering import numbered

ARMS = ("VJ", "VDJ")
DEALS = 4  # parts in which one side of a key meets the other


@dataclass(frozen=True)
class Setup:
    sequence: str = "aa"
    metric: object = "identity"
    cutoff: int | None = None
    receptor_arms: str = "all"
    dual_ir: str = "any"
    same_v_gene: bool = False
    same_j_gene: bool = False
    match: tuple = ("receptor_type",)

    def __post_init__(self):
        if self.receptor_arms not in ("VJ", "VDJ", "all", "any") or self.dual_ir not in ("any", "primary_only", "all") or self.sequence not in ("aa", "nt"):
            raise ValueError("receptor_arms: VJ, VDJ, all, any; dual_ir: any, primary_only, all; sequence: aa, nt")

    @property
    def field(self) -> str:
        return "junction_aa" if self.sequence == "aa" else "junction"

    @property
    def arms(self):
        return ARMS if self.receptor_arms in ("all", "any") else (self.receptor_arms,)

    @property
    def chains(self):
        return (1,) if self.dual_ir == "primary_only" else (1, 2)

    @property
    def columns(self) -> list[str]:
        kinds = [self.field] + ["v_call"] * self.same_v_gene + ["j_call"] * self.same_j_gene
        return [f"{a}_{n}_{k}" for a in self.arms for n in self.chains for k in kinds]

    @property
    def identical(self) -> bool:
        return self.cutoff == 0 or self.metric == "identity"

    @property
    def one_mismatch(self) -> bool:
        """Linked where the primary chains of both arms differ in one letter at most: what ``near_keys`` can state."""
        return (self.metric, self.cutoff, self.receptor_arms, self.dual_ir) == ("hamming", 1, "all", "primary_only")


def configurations(cells: DataFrame, s: Setup) -> tuple[DataFrame, DataFrame]:
    """(clonotypes: ct, the first cell_ord of a configuration, and its columns; members: ct, cell_id)."""
    kinds = {c: F.upper(c) if c.endswith(s.field) else F.col(c) for c in s.columns}
    rows = cells.where("has_ir").where(F.coalesce(*[F.col(c).cast("string") for c in s.columns]).isNotNull())
    rows = written(rows.select("cell_id", "cell_ord", *[v.alias(c) for c, v in kinds.items()], *s.match), "cells")  # read once for the table and for its members
    keys = [*s.columns, *s.match]
    table = written(rows.groupBy(*keys).agg(F.min("cell_ord").alias("ct")), "configurations")
    key = lambda: [F.xxhash64(*keys).alias("hash"), F.struct(*keys).alias("key")]  # noqa: E731  one hash to deal by, nulls equal inside the key
    return table, rows.select("cell_id", *key()).join(table.select("ct", *key()), ["hash", "key"]).select("ct", "cell_id")


def chain_rows(table: DataFrame, s: Setup) -> DataFrame:
    """ct, arm, slot, seq, v, j, match columns, and how many chains and arms the configuration has."""
    out = None
    has = lambda a, n: F.col(f"{a}_{n}_{s.field}").isNotNull()
    for a in s.arms:
        for n in s.chains:
            gene = lambda g, on, a=a, n=n: (F.col(f"{a}_{n}_{g}") if on else F.lit(None).cast("string"))
            part = table.where(has(a, n)).select(
                "ct", F.lit(a).alias("arm"), F.lit(n).alias("slot"), F.col(f"{a}_{n}_{s.field}").alias("seq"),
                gene("v_call", s.same_v_gene).alias("v"), gene("j_call", s.same_j_gene).alias("j"), *s.match,
                sum((has(a, m).cast("int") for m in s.chains[1:]), has(a, 1).cast("int")).alias("n_chains"),
                sum((has(b, 1).cast("int") for b in s.arms[1:]), has(s.arms[0], 1).cast("int")).alias("n_arms"))
            out = part if out is None else out.union(part)
    return out


def _both(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))  # greatest alone passes over nulls


def pair_distances(left: DataFrame, right: DataFrame, edges: DataFrame, s: Setup, square: bool) -> DataFrame:
    """i, j, dist of configurations within the cutoff, from chain rows of both sides and sequence edges."""
    a = left.select(F.col("ct").alias("i"), "arm", F.col("slot").alias("s1"), F.col("seq").alias("seq1"), F.col("v").alias("v1"), F.col("j").alias("j1"),
                    F.col("n_chains").alias("c1"), F.col("n_arms").alias("a1"), *[F.col(m).alias(f"{m}_1") for m in s.match])
    b = right.select(F.col("ct").alias("j"), "arm", F.col("slot").alias("s2"), F.col("seq").alias("seq2"), F.col("v").alias("v2"), F.col("j").alias("j2"),
                     F.col("n_chains").alias("c2"), F.col("n_arms").alias("a2"), *[F.col(m).alias(f"{m}_2") for m in s.match])
    pairs = a.join(edges, ["arm", "seq1"]).join(b, ["arm", "seq2"])
    if square:
        pairs = pairs.where("i < j")
    if s.same_v_gene:
        pairs = pairs.where("v1 = v2")
    if s.same_j_gene:
        pairs = pairs.where("j1 = j2")
    for m in s.match:
        pairs = pairs.where(F.col(f"{m}_1").eqNullSafe(F.col(f"{m}_2")))
    best = {(arm, x, y): F.min(F.when((F.col("arm") == arm) & (F.col("s1") == x) & (F.col("s2") == y), F.col("dist"))).alias(f"{arm}_{x}{y}")
            for arm in s.arms for x in s.chains for y in s.chains}
    count = {f"{arm}_c{n}": F.max(F.when(F.col("arm") == arm, F.col(f"c{n}"))).alias(f"{arm}_c{n}") for arm in s.arms for n in (1, 2)}
    d = pairs.groupBy("i", "j").agg(*best.values(), *count.values(), F.max("a1").alias("a1"), F.max("a2").alias("a2"))
    arms = {}
    for arm in s.arms:
        c = lambda x, y, arm=arm: F.col(f"{arm}_{x}{y}")
        if s.dual_ir == "primary_only":
            arms[arm] = c(1, 1)
        elif s.dual_ir == "any":
            arms[arm] = F.least(c(1, 1), c(1, 2), c(2, 1), c(2, 2))
        else:
            two = F.least(_both(c(1, 1), c(2, 2)), _both(c(2, 1), c(1, 2)))
            arms[arm] = F.when(F.col(f"{arm}_c1") == F.col(f"{arm}_c2"), F.when(F.col(f"{arm}_c1") == 2, two).otherwise(c(1, 1)))
    if len(arms) == 1:
        dist = arms[s.arms[0]]
    elif s.receptor_arms == "any":
        dist = F.least(*arms.values())
    else:
        dist = F.when(F.col("a1") == F.col("a2"), F.when(F.col("a1") == 2, _both(*arms.values())).otherwise(F.coalesce(*arms.values())))
    return d.select("i", "j", dist.alias("dist")).where("dist is not null")


def both_arms_distances(left: DataFrame, right: DataFrame, edges: DataFrame, s: Setup, square: bool) -> DataFrame:
    """The same where the primary chains of both arms must agree, from configurations: no pair is made that agrees in one arm only.

    One side is spread to the neighbours of its first arm, the other to those of
    its second; a pair within the cutoff meets under the two sequences, once. An
    arm that is missing agrees with a missing one.
    """
    genes = [g for g, on in (("v_call", s.same_v_gene), ("j_call", s.same_j_gene)) if on]
    seq = lambda a: F.col(f"{a}_1_{s.field}")

    def spread(table: DataFrame, ct: str, arm: str, own: str, other: str) -> DataFrame:
        rows = table.where(F.coalesce(*map(seq, ARMS)).isNotNull())
        for a in ARMS:
            for g in genes:  # a chain without a gene call that must be the same agrees with none
                rows = rows.where(seq(a).isNull() | F.col(f"{a}_1_{g}").isNotNull())
        called = [F.when(seq(a).isNotNull(), F.col(f"{a}_1_{g}")) for a in ARMS for g in genes]
        rows = rows.select(F.col("ct").alias(ct), *[seq(a).alias(a) for a in ARMS], F.struct(F.lit(0).alias("same"), *called, *s.match).alias("same"))
        near = edges.where(F.col("arm") == arm).select(F.col(own).alias(arm), F.col(other).alias("to"), F.col("dist").alias(f"dist_{ct}"))
        found = rows.where(F.col(arm).isNotNull()).join(near, arm).withColumn(arm, F.col("to")).drop("to")
        found = found.unionByName(rows.where(F.col(arm).isNull()).withColumn(f"dist_{ct}", F.lit(0)))
        key = F.struct(*ARMS, "same")  # nulls are equal inside the key
        return found.select(ct, f"dist_{ct}", F.xxhash64(key).alias("hash"), key.alias("key"))

    pairs = spread(left, "i", ARMS[0], "seq1", "seq2").join(spread(right, "j", ARMS[1], "seq2", "seq1"), ["hash", "key"])
    return (pairs.where("i < j") if square else pairs).select("i", "j", F.greatest("dist_i", "dist_j").alias("dist"))


def any_near_pairs(left: DataFrame, right: DataFrame | None, s: Setup) -> DataFrame:
    """i, j, dist where a chain of one is within one mismatch of a chain of the other, from configurations: pairs aren't dealt to be counted once.

    Chains meet under the keys of ``near_keys``; each side also holds its smaller
    keys, and a pair is reported where it shares none of these. A whole sequence
    has a key below 0, so that a pair at distance 0 is reported there.
    """
    chains = [chain_rows(t, s).where(F.lit(True) if not s.same_v_gene else F.col("v").isNotNull()).where(F.lit(True) if not s.same_j_gene else F.col("j").isNotNull())
              for t in ((left,) if right is None else (left, right))]
    seqs = written(reduce(DataFrame.union, [c.select("arm", "seq") for c in chains]).distinct(), "sequences")
    holes = seqs.where("seq <> ''").select("arm", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("place"))
    holes = holes.select("arm", "seq", "place", F.expr("substr(seq, 1, place - 1) || substr(seq, place + 1)").alias("rest"))
    several = holes.groupBy("arm", "place", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("arm", "place", "rest")
    near = holes.join(several, ["arm", "place", "rest"]).select("arm", "seq", "place", "rest").union(seqs.select("arm", "seq", F.lit(0).alias("place"), F.col("seq").alias("rest")))
    named = F.struct("arm", "place", "rest", "v", "j", *s.match)
    keyed = [written(c.join(near, ["arm", "seq"]).select("ct", F.xxhash64(named).alias("hash"), named.alias("named")).distinct(), "key-rows") for c in chains]
    held = keyed[0].select("hash", "named").distinct()
    if right is not None:  # keys of one side alone bring nothing together
        held = held.join(keyed[1].select("hash", "named").distinct(), ["hash", "named"], "left_semi")
    ids = numbered(held, ["hash", "named"], "no")
    ids = written(ids.select("hash", "named", F.when(F.col("named.place") == 0, -1 - F.col("no")).otherwise(F.col("no")).alias("key")), "keys")
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(rows: DataFrame, ct: str) -> DataFrame:
        own = rows.join(ids, ["hash", "named"]).groupBy("ct").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a few: of its chains, without one letter
        own = own.select(F.col("ct").alias(ct), F.posexplode("keys").alias("at", "key"), "keys").withColumn("less", F.slice("keys", F.lit(1), F.col("at")))
        some = F.aggregate("less", F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))))
        return own.select(ct, "key", F.col("less").alias(f"less_{ct}"), some.alias(f"some_{ct}"))

    # a join's output is large for its input: one side is dealt once more, the other repeated
    a = side(keyed[0], "i").withColumn("deal", F.pmod(F.xxhash64("i"), F.lit(DEALS)))
    b = side(keyed[-1], "j").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    met = a.repartition(width, "key", "deal").join(b.repartition(width, "key", "deal"), ["key", "deal"])
    first = (F.col("some_i").bitwiseAND(F.col("some_j")) == 0) | ~F.arrays_overlap("less_i", "less_j")
    pairs = met.where(first).select("i", "j", F.when(F.col("key") < 0, 0).otherwise(1).alias("dist"))
    return pairs.where("i < j") if right is None else pairs


def near_pairs(left: DataFrame, right: DataFrame | None, s: Setup) -> DataFrame:
    """i, j, dist of the configurations within the cutoff: of one table each pair once (i < j), or of two."""
    columns = {a: [f"{a}_{n}_{s.field}" for n in s.chains] for a in s.arms}
    square = right is None
    other = left if square else right
    if (s.metric, s.cutoff, s.dual_ir) == ("hamming", 1, "any") and s.receptor_arms != "all":
        return any_near_pairs(left, right, s)
    distinct = [written(sequences(t, columns), "sequences") for t in ((left,) if square else (left, right))]
    edges = written(ir_dist(distinct[0], None if square else distinct[1], s.metric, s.cutoff), "edges")
    if s.receptor_arms == "all" and s.dual_ir == "primary_only":
        return both_arms_distances(left, other, edges, s, square)
    return pair_distances(chain_rows(left, s), chain_rows(other, s), edges, s, square)


def near_keys(table: DataFrame, s: Setup) -> DataFrame:
    """ct, a, b, same: of each configuration the keys of its two arms; any two that share a key of each arm, and ``same``, are linked, no others.

    Sequences of one length differ in one letter at most exactly if they are
    equal without the letter at some place. Of these keys (place, the other
    letters) only those of several sequences are kept; a sequence that has none
    is a key itself (place 0), as is an arm that is missing. So a configuration
    has a few keys, however many others are within the cutoff.
    """
    genes = [g for g, on in (("v_call", s.same_v_gene), ("j_call", s.same_j_gene)) if on]
    columns = {a: f"{a}_1_{s.field}" for a in ARMS}
    rows = table.where(F.coalesce(*columns.values()).isNotNull())
    for a, c in columns.items():
        for g in genes:  # a chain without a gene call that must be the same agrees with none
            rows = rows.where(F.col(c).isNull() | F.col(f"{a}_1_{g}").isNotNull())
    called = [F.when(F.col(c).isNotNull(), F.col(f"{a}_1_{g}")) for a, c in columns.items() for g in genes]
    rows = rows.select("ct", *columns.values(), F.struct(F.lit(0).alias("same"), *called, *s.match).alias("same"))
    key = lambda place, rest: F.struct(place.cast("int").alias("place"), rest.alias("rest"))
    for name, c in zip("ab", columns.values()):
        seqs = rows.where(F.col(c).isNotNull()).select(F.col(c).alias("seq")).distinct()
        at = seqs.where("seq <> ''").select("seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("place"))
        at = at.select("seq", key(F.col("place"), F.concat(F.expr("substr(seq, 1, place - 1)"), F.expr("substr(seq, place + 1)"))).alias("key"))
        several = at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        near = at.join(several, "key").groupBy(F.col("seq").alias(c)).agg(F.sort_array(F.collect_list("key")).alias(name))
        rows = rows.join(near, c, "left").withColumn(name, F.coalesce(name, F.array(key(F.lit(0), F.col(c)))))
    return rows.select("ct", "a", "b", "same")


def near_hub_rows(table: DataFrame, s: Setup) -> DataFrame:
    """ct, hash, hub: what configurations within one mismatch in each arm share, as ``hub_rows`` for identity."""
    rows = near_keys(table, s).select("ct", "same", F.explode("a").alias("a"), "b").select("ct", "same", "a", F.explode("b").alias("b"))
    hub = F.struct("a", "b", "same")
    return rows.select("ct", F.xxhash64(hub).alias("hash"), hub.alias("hub"))


def near_cliques(table: DataFrame, s: Setup) -> DataFrame:
    """node, clique, sign: configurations within one mismatch in each arm; for each such pair the signs of the cliques that hold both add up to 1.

    The sequences within one mismatch of a are those of its keys, where a itself
    counts once for each of its m keys; so a goes with -(m - 1) beside them. A
    configuration goes with the products of both arms.
    """
    def signed(arm: str, own: Column) -> Column:
        each = F.transform(arm, lambda k: F.struct(k.alias("key"), F.lit(1).alias("sign")))
        itself = F.struct(F.struct(F.lit(0).alias("place"), own.alias("rest")).alias("key"), (1 - F.size(arm)).alias("sign"))
        return F.when(F.size(arm) > 1, F.concat(each, F.array(itself))).otherwise(each)

    seqs = table.select("ct", *[F.col(f"{a}_1_{s.field}").alias(a) for a in ARMS])
    rows = near_keys(table, s).join(seqs, "ct").select("ct", "same", signed("a", F.col(ARMS[0])).alias("a"), signed("b", F.col(ARMS[1])).alias("b"))
    rows = rows.select("ct", "same", F.explode("a").alias("a"), "b").select("ct", "same", "a", F.explode("b").alias("b"))
    key = F.struct(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("same"))
    rows = written(rows.select("ct", F.xxhash64(key).alias("hash"), key.alias("key"), (F.col("a.sign") * F.col("b.sign")).alias("sign")), "key-rows")
    several = rows.groupBy("hash", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "key")
    return rows.join(numbered(several, ["hash", "key"], "clique"), ["hash", "key"]).select(F.col("ct").alias("node"), "clique", "sign")


def hubs(s: Setup) -> Column:
    """What two configurations must share, once at least, to be linked by identity: an array of composite keys.

    Any of two chains: one key per chain; both: the sorted pair. Where both arms
    must agree, a key of one arm with one of the other (four at most), besides
    those of configurations that have one arm only. Chains without a gene call
    that must be the same have no key.
    """
    has = lambda a, n: F.col(f"{a}_{n}_{s.field}").isNotNull()

    def chain(a: str, n: int) -> Column:
        gene = lambda g, on: F.col(f"{a}_{n}_{g}") if on else F.lit(None).cast("string")
        v, j = gene("v_call", s.same_v_gene), gene("j_call", s.same_j_gene)
        called = (v.isNotNull() if s.same_v_gene else F.lit(True)) & (j.isNotNull() if s.same_j_gene else F.lit(True))
        return F.when(has(a, n) & called, F.struct(F.lit(a).alias("arm"), F.col(f"{a}_{n}_{s.field}").alias("seq"), v.alias("v"), j.alias("j")))

    def keys(a: str) -> Column:
        if s.dual_ir == "all":
            one, two = chain(a, 1), chain(a, 2)
            pair = F.when(one.isNotNull() & two.isNotNull(), F.array_sort(F.array(one, two)))
            found = F.array(F.when(has(a, 1) & has(a, 2), pair).when(has(a, 1), F.when(one.isNotNull(), F.array(one))))
        else:
            found = F.array(*(F.when(chain(a, n).isNotNull(), F.array(chain(a, n))) for n in s.chains))
        return F.filter(found, lambda k: k.isNotNull())

    either = F.concat(*(keys(a) for a in s.arms))
    named = lambda arms, found: F.transform(found, lambda k: F.struct(F.lit(arms).alias("arms"), k.alias("chains"), *s.match))
    if s.receptor_arms != "all":
        return named(0, either)
    arms = sum((has(a, 1).cast("int") for a in s.arms), F.lit(0))
    both = F.flatten(F.transform(keys(s.arms[0]), lambda x: F.transform(keys(s.arms[1]), lambda y: F.concat(x, y))))
    return F.when(arms == 2, named(2, both)).when(arms == 1, named(1, either)).otherwise(named(0, either))


def hub_rows(table: DataFrame, s: Setup) -> DataFrame:
    """ct, hash, hub: the distinct composite keys of each configuration."""
    return table.select("ct", F.explode(F.array_distinct(hubs(s))).alias("hub")).select("ct", F.xxhash64("hub").alias("hash"), "hub")


def links(table: DataFrame, s: Setup) -> DataFrame:
    """src, dst of configurations in one cluster; by identity one star per shared key, never all its pairs."""
    if s.identical:
        rows = hub_rows(table, s)
        low = rows.groupBy("hash", "hub").agg(F.min("ct").alias("dst"))
        return rows.join(low, ["hash", "hub"]).where("ct <> dst").select(F.col("ct").alias("src"), "dst").distinct()
    return near_pairs(table, None, s).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def cliques(table: DataFrame, s: Setup) -> DataFrame:
    """ct, clique, sign: every pair of configurations that is linked by identity, without a row for any of them.

    The configurations of a key are all linked. Those that share several keys
    must count once, so the sets of their keys are cliques too, with signs that
    alternate by size: for each linked pair the signs add up to one, for others
    there are none. A configuration has four keys at most, so fifteen sets.
    """
    rows = hub_rows(table, s)
    shared = rows.groupBy("hash", "hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "hub")
    named = rows.join(numbered(shared, ["hash", "hub"], "key"), ["hash", "hub"]).groupBy("ct").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    none = F.array().cast("array<array<bigint>>")
    sets = F.aggregate("keys", F.concat(none, F.array(F.array().cast("array<bigint>"))), lambda acc, k: F.concat(acc, F.transform(acc, lambda x: F.concat(x, F.array(k)))))
    own = written(named.select("ct", F.explode(F.filter(sets, lambda x: F.size(x) > 0)).alias("keys")), "key-sets")
    several = own.groupBy("keys").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("keys")
    return own.join(numbered(several, "keys", "clique"), "keys").select("ct", "clique", F.when(F.size("keys") % 2 == 1, 1).otherwise(-1).alias("sign"))


def linked_pairs(table: DataFrame, s: Setup) -> DataFrame:
    """src, dst: every pair of configurations in reach of one another, once; ``links`` gives as many as hold them together."""
    if not s.identical:
        return links(table, s)
    rows = hub_rows(table, s)
    return rows.select("hash", "hub", F.col("ct").alias("src")).join(rows.select("hash", "hub", F.col("ct").alias("dst")), ["hash", "hub"]).where("src < dst").select("src", "dst").distinct()


def identity_labels(table: DataFrame, s: Setup) -> DataFrame:
    """ct, low: the smallest configuration reachable by shared keys, for each configuration that has a key."""
    return key_labels(hub_rows(table, s))


def key_labels(rows: DataFrame) -> DataFrame:
    """The same from rows(ct, hash, hub).

    A key goes by its smallest configuration (keys that share it are linked by
    it), and components are those of keys: only a configuration with several
    keys gives edges, and equal ones are one edge.
    """
    low = rows.groupBy("hash", "hub").agg(F.min("ct").alias("key"))
    keys = written(rows.join(low, ["hash", "hub"]).groupBy("ct").agg(F.min("key").alias("key"), F.collect_set("key").alias("keys")), "keys")  # a configuration has a few
    edges = keys.where(F.size("keys") > 1).select("key", F.explode("keys").alias("other")).where("other <> key").distinct()
    roots = connected_components(edges, "other", "key")
    found = keys.select("ct", "key").join(roots.select(F.col("node").alias("key"), "component"), "key", "left")
    return found.select("ct", F.coalesce("component", "key").alias("low"))


def define_clonotype_clusters(cells: DataFrame, partitions: str = "connected", resolution: float = 1.0, n_iterations: int = 1, **options) -> DataFrame:
    """cell_id, cluster_id (string, by first cell), cluster_size for each cell that has a configuration.

    ``resolution`` and ``n_iterations`` are those of ``leiden``.
    """
    s = Setup(**options)
    table, members = configurations(cells, s)
    if partitions == "connected" and s.identical and s.dual_ir == "primary_only" and s.receptor_arms != "any":
        label = table.select("ct", F.col("ct").alias("low"))  # a configuration is linked to none but itself
    elif partitions == "connected" and s.identical:
        label = identity_labels(table, s)
    elif partitions == "connected" and s.one_mismatch:
        label = key_labels(written(near_hub_rows(table, s), "key-rows"))
    elif partitions == "connected":
        label = connected_components(links(table, s)).select(F.col("node").alias("ct"), F.col("component").alias("low"))
    elif partitions in ("leiden", "fastgreedy") and s.one_mismatch:  # configurations are distinct: all distances are 1, all weights equal
        rows = near_cliques(table, s)
        found = leiden_of_cliques(rows, resolution, n_iterations) if partitions == "leiden" else fastgreedy_of_cliques(rows)
        label = found.select(F.col("node").alias("ct"), F.col("community").alias("low"))
    elif partitions in ("leiden", "fastgreedy"):
        pairs = cut(near_pairs(table, None, s))
        most = pairs.agg(F.max("dist")).first()[0] or 0
        edges = pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), (most + 1 - F.col("dist")).cast("long").alias("weight"))
        found = leiden(edges, resolution, n_iterations) if partitions == "leiden" else fastgreedy(edges)
        label = found.select(F.col("node").alias("ct"), F.col("community").alias("low"))
    else:
        raise ValueError("partitions: connected, leiden, fastgreedy")
    found = written(members.join(label, "ct", "left").select("cell_id", F.coalesce("low", "ct").alias("low")), "labels")  # read for the sizes and for the cells
    sizes = numbered(found.groupBy("low").agg(F.count(F.lit(1)).alias("cluster_size")), "low", "n")
    return found.join(sizes, "low").select("cell_id", F.col("n").cast("string").alias("cluster_id"), "cluster_size")


def define_clonotypes(cells: DataFrame, **options) -> DataFrame:
    """Clonotypes: identical nucleotide sequences, components."""
    return define_clonotype_clusters(cells, sequence="nt", metric="identity", **options)


def clonotype_graph(cells: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(src, dst, dist, weight: configurations within the cutoff, each pair once; ct, cell_id: their cells).

    The weight falls from 1 at distance 0 by 1 / (largest distance + 1) a step.
    """
    s = Setup(**options)
    table, members = configurations(cells, s)
    pairs = cut(near_pairs(table, None, s))
    most = F.lit((pairs.agg(F.max("dist")).first()[0] or 0) + 1)
    return pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), "dist", ((most - F.col("dist")) / most).alias("weight")), members


def ir_query(cells: DataFrame, reference: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(i, j, dist of query and reference configurations; members of the query; members of the reference)."""
    s = Setup(**options)
    if s.same_j_gene:
        raise ValueError("queries match V genes only")
    (q, qm), (r, rm) = configurations(cells, s), configurations(reference, s)
    if s.identical:
        shared = hub_rows(q, s).withColumnRenamed("ct", "i").join(hub_rows(r, s).withColumnRenamed("ct", "j"), ["hash", "hub"])
        return shared.select("i", "j", F.lit(0).alias("dist")).distinct(), qm, rm
    return near_pairs(q, r, s), qm, rm


def annotate_df(query, reference: DataFrame, columns) -> DataFrame:
    """cell_id, reference columns: one row per query cell and matching reference cell. ``query`` is what ir_query gives."""
    pairs, qm, rm = query
    named = rm.join(reference.select("cell_id", *columns), "cell_id").select(F.col("ct").alias("j"), F.col("cell_id").alias("ref_id"), *columns)
    # cells meet in the last join only: its rows are the result and are dealt no more; they grow with the square of a
    # configuration's cells, so its tasks stay as many as were asked for, however few bytes they read
    width = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, own = pairs.join(named, "j").drop("j", "dist"), qm.withColumnRenamed("ct", "i")
    return found.repartition(width, "i").join(own.repartition(width, "i"), "i").select("cell_id", "ref_id", *columns)


def annotate(spine: DataFrame, hits: DataFrame, column: str, strategy: str = "unique-only") -> DataFrame:
    """cell_id and the reduced ``column`` for every cell of ``spine``: unique-only, most-frequent or json."""
    counts = hits.where(F.col(column).isNotNull()).groupBy("cell_id", F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return spine.select("cell_id").join(_reduced(counts, "cell_id", column, strategy), "cell_id", "left")


def annotate_query(spine: DataFrame, query, reference: DataFrame, column: str, strategy: str = "unique-only") -> DataFrame:
    """The same of what ir_query gives: values are counted by configuration, so that no cell meets a reference cell."""
    pairs, qm, rm = query
    values = rm.join(reference.select("cell_id", F.col(column).alias("v")), "cell_id").where("v is not null").groupBy(F.col("ct").alias("j"), "v").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.join(values, "j").groupBy("i", "v").agg(F.sum("n").alias("n"))
    found = qm.join(_reduced(counts, "i", column, strategy).withColumnRenamed("i", "ct"), "ct").select("cell_id", column)
    return spine.select("cell_id").join(found, "cell_id", "left")


def _reduced(counts: DataFrame, key: str, column: str, strategy: str) -> DataFrame:
    """key, ``column`` from counts(key, v, n)."""
    if strategy == "unique-only":
        out = counts.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.min("v")).otherwise("ambiguous").alias(column))
    elif strategy == "most-frequent":
        top = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "v")), False).alias("t"))
        second = F.get("t", 1)["n"]
        out = top.select(key, F.when(second == F.get("t", 0)["n"], "ambiguous").otherwise(F.get("t", 0)["v"]).alias(column))
    elif strategy == "json":
        out = counts.groupBy(key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n"))))).alias(column))
    else:
        raise ValueError("strategy: unique-only, most-frequent, json")
    return out


def network_nodes(members: DataFrame, links_: DataFrame, min_cells: int = 1, min_nodes: int = 1, mask: DataFrame | None = None) -> DataFrame:
    """ct, component, n_nodes, n_cells of components with enough nodes and cells; members(ct, cell_id), links(src, dst).

    ``mask``(cell_id): only components with at least one of these cells. It is an error if nothing is left.
    """
    sizes = members.groupBy("ct").agg(F.count(F.lit(1)).alias("size"))
    parts = connected_components(links_)
    nodes = cut(sizes.join(parts, sizes.ct == parts.node, "left").select("ct", "size", F.coalesce("component", "ct").alias("component")))
    per = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("size").alias("n_cells"))
    kept = nodes.join(per.where((F.col("n_nodes") >= min_nodes) & (F.col("n_cells") >= min_cells)), "component")
    if mask is not None:
        seen = nodes.join(members.join(mask.select("cell_id").distinct(), "cell_id", "left_semi"), "ct").select("component").distinct()
        kept = kept.join(seen, "component", "left_semi")
    kept = cut(kept)
    if kept.isEmpty():
        raise ValueError(f"no component has {min_nodes} nodes, {min_cells} cells and a cell of the mask")
    return kept
