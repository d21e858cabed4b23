"""Which chains of a cell are its primary and secondary ones, and access to their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.functions.sequences import VDJ_LOCI, VJ_LOCI

#: sort keys with what stands for null, all descending
SORT_KEYS = {"umi_count": 0, "duplicate_count": 0, "consensus_count": 0, "junction": "", "junction_aa": ""}
CHAINS = ("VJ_1", "VJ_2", "VDJ_1", "VDJ_2")


def productive(chain: Column) -> Column:
    return F.coalesce(chain["productive"], F.lit(False))


def require_junction_aa(chain: Column) -> Column:
    return chain["junction_aa"].isNotNull()


def index_chains(df: DataFrame, filters=(productive, require_junction_aa), sort_keys=None) -> DataFrame:
    """Add ``chain_indices`` (VJ, VDJ: two positions in ``airr`` or null each; multichain). A projection: no shuffle."""
    have = df.schema["airr"].dataType.elementType.names
    keys = [(k, v) for k, v in (sort_keys or SORT_KEYS).items() if k in have]

    def entry(c: Column, i: Column) -> Column:
        ok = F.lit(True)
        for f in filters:
            ok = ok & F.coalesce(f(c), F.lit(False))
        return F.struct(*[F.coalesce(c[k], F.lit(v)).alias(f"k{n}") for n, (k, v) in enumerate(keys)], (-i).alias("back"),
                        c["locus"].alias("locus"), ok.alias("ok"))

    # columns of their own, so that chains are read and sorted once, not wherever an arm is named
    df = df.withColumn("_entries", F.filter(F.transform("airr", entry), lambda e: e["ok"]))
    arms = {"VJ": VJ_LOCI, "VDJ": VDJ_LOCI}
    # all keys descend; the position, negated, settles ties for the earlier chain
    df = df.withColumns({f"_{arm}": F.sort_array(F.filter("_entries", lambda e: e["locus"].isin(*loci)), asc=False) for arm, loci in arms.items()})  # noqa: B023
    two = lambda a: F.when(F.col("airr").isNotNull(), F.array(*[-F.get(f"_{a}", F.lit(i))["back"] for i in (0, 1)]))
    many = F.coalesce((F.size("_VJ") > 2) | (F.size("_VDJ") > 2), F.lit(False))
    return df.withColumn("chain_indices", F.struct(two("VJ").alias("VJ"), two("VDJ").alias("VDJ"), many.alias("multichain"))).drop("_entries", "_VJ", "_VDJ")


def ranked(rows: DataFrame, key: str, sort_keys=None) -> DataFrame:
    """Chains of a flat table, one row each, with ``arm`` and ``rank`` (from 1) among the cell's chains of this arm, in the order of ``index_chains``.

    Rows are those that may be indexed; ``key`` names their cell, chain_idx settles
    ties for the earlier chain. Rows dealt by ``key`` are not moved.
    """
    keys = [F.coalesce(F.col(k), F.lit(v)).desc() for k, v in (sort_keys or SORT_KEYS).items() if k in rows.columns]
    arm = F.when(F.col("locus").isin(*VJ_LOCI), "VJ").when(F.col("locus").isin(*VDJ_LOCI), "VDJ")
    rows = rows.withColumn("arm", arm).where("arm is not null")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "arm").orderBy(*keys, "chain_idx")))


def picked(rows: DataFrame, key: str, variables, chains=CHAINS) -> DataFrame:
    """``key``, multichain and one column {chain}_{variable} for each chain and variable, from what ``ranked`` gives.

    The columns of ``index_chains`` and ``with_airr`` without arrays: columns that nobody reads are not made.
    """
    at = {c: (F.col("arm") == c.split("_")[0]) & (F.col("rank") == int(c.split("_")[1])) for c in chains}
    return rows.groupBy(key).agg((F.max("rank") > 2).alias("multichain"), *[F.max(F.when(at[c], F.col(v))).alias(f"{c}_{v}") for c in chains for v in variables])


def chain_field(chain: str, var: str) -> Column:
    arm, n = chain.upper().split("_")
    if chain.upper() not in CHAINS:
        raise ValueError(f"no chain {chain}; there are {', '.join(CHAINS)}")
    return F.get("airr", F.get(f"chain_indices.{arm}", F.lit(int(n) - 1)))[var]


def get_airr(df: DataFrame, variables, chains=CHAINS) -> DataFrame:
    """cell_id and one column {chain}_{variable} for each chain and variable, chain by chain."""
    return df.select("cell_id", *[chain_field(c, v).alias(f"{c}_{v}") for c in chains for v in variables])


def with_airr(df: DataFrame, variables, chains=CHAINS) -> DataFrame:
    """The same as further columns of ``df``; drop them when they have been used."""
    return df.withColumns({f"{c}_{v}": chain_field(c, v) for c in chains for v in variables})


def has_ir() -> Column:
    some = lambda arm: F.coalesce(F.size(F.filter(f"chain_indices.{arm}", lambda x: x.isNotNull())), F.lit(0))
    return some("VJ") + some("VDJ") > 0


def merge_airr(a: DataFrame, b: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Full outer merge of two nested tables: chains of a, then of b, equal ones once; cell fields must not differ."""
    shared = [c for c in a.columns if c in b.columns and c not in ("cell_id", "airr")]
    right = b.select("cell_id", *[F.col(c).alias(f"_b_{c}") for c in b.columns if c != "cell_id"])
    out = a.join(right, "cell_id", "full_outer")
    empty = F.array().cast(a.schema["airr"].dataType)
    both = F.concat(F.coalesce("airr", empty), F.coalesce("_b_airr", empty))
    out = out.withColumn("airr", F.array_distinct(both) if drop_duplicates else both).drop("_b_airr")
    for c in shared:
        clash = F.col(c).isNotNull() & F.col(f"_b_{c}").isNotNull() & (F.col(c) != F.col(f"_b_{c}"))
        out = out.withColumn(c, F.when(clash, F.raise_error(F.concat(F.lit(f"different {c} for cell "), "cell_id")).cast(a.schema[c].dataType))
                             .otherwise(F.coalesce(c, f"_b_{c}"))).drop(f"_b_{c}")
    for c in [c for c in out.columns if c.startswith("_b_")]:
        out = out.withColumnRenamed(c, c[3:])
    return out
