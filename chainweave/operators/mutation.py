"""Mutational load of aligned sequences against their germline, per chain and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: first and last place (excluded) of the regions before the junction, from 0 (fixed values of the IMGT numbering)
REGIONS = {"v": (0, 312), "fwr1": (0, 78), "cdr1": (78, 114), "fwr2": (114, 165), "cdr2": (165, 195), "fwr3": (195, 312)}
IGNORED = (".", "N")


def region(seq: Column, name: str, junction: Column) -> Column:
    end = F.lit(312) + F.length(junction) - 6
    if name == "full":
        return seq
    if name == "cdr3":
        return F.substring(seq, F.lit(313), F.greatest(end - 312, F.lit(0)))
    if name == "fwr4":
        return F.substring(seq, end + 1, F.length(seq))
    a, b = REGIONS[name]
    return F.substring(seq, F.lit(a + 1), F.lit(b - a))


def mutations(seq: Column, germline: Column, ignored=IGNORED) -> Column:
    """Places where both letters count and differ; null where no place counts."""
    pairs = F.filter(F.arrays_zip(F.split(seq, "").alias("s"), F.split(germline, "").alias("g")),
                     lambda p: (p["s"] != "") & ~p["s"].isin(*ignored) & ~p["g"].isin(*ignored))
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: p["s"] != p["g"])))


def mutational_load(chains: DataFrame, regions=("full", "v"), sequence="sequence_alignment", germline="germline_alignment_d_mask",
                    junction="junction", ignored=IGNORED) -> DataFrame:
    """Add {region}_mutation_count and _freq; the frequency's base is the region's length, ignored letters included."""
    s, g = F.col(sequence), F.col(germline)
    same = F.when(F.length(s) != F.length(g), F.raise_error(F.lit("sequence and germline differ in length")).cast("string")).otherwise(s)
    out = chains.withColumn("_s", same)
    for r in regions:
        piece = region(F.col("_s"), r, F.col(junction))
        out = out.withColumn(f"{r}_mutation_count", mutations(piece, region(g, r, F.col(junction)), ignored))
        out = out.withColumn(f"{r}_mutation_freq", F.col(f"{r}_mutation_count") / F.length(piece))
    return out.drop("_s")
