"""Receptor type, subtype and chain pairing of a cell: projections over indexed chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.operators.indexing import CHAINS, chain_field, has_ir


def chain_qc(df: DataFrame) -> DataFrame:
    """Add receptor_type, receptor_subtype and chain_pairing to indexed cells."""
    return typed(df, chain_field, has_ir(), F.coalesce(F.col("chain_indices.multichain"), F.lit(False)))


def typed(df: DataFrame, field: Callable[[str, str], Column], ir: Column, many: Column) -> DataFrame:
    """The same from where a chain's locus and junction_aa stand (``field``), has_ir and multichain. Rules stand from the strongest down."""
    loci = [f"_{x}" for x in ("TRA", "TRB", "TRG", "TRD", "IGH", "IGK", "IGL")]
    # columns of their own: each is named by many rules
    df = df.withColumns({"_ir": ir, "_many": many, **{f"_locus_{c}": field(c, "locus") for c in CHAINS}})
    df = df.withColumns({x: F.coalesce(F.lit(x[1:]).isin(*[F.col(f"_locus_{c}") for c in CHAINS]), F.lit(False)) for x in loci})
    a, b, g, d, h, k, lam = map(F.col, loci)
    ir, many = F.col("_ir"), F.col("_many")
    tr, ig = a | b | g | d, h | k | lam
    kind = F.when(many & ir, "multichain").when(ig & ~tr, "BCR").when(tr & ~ig, "TCR").when(~ir, "no IR").otherwise("ambiguous")
    subtype = (F.when(many & ir, "multichain").when(k & lam & h & ~tr, "IGH+IGK/L").when(k & ~lam & ~tr, "IGH+IGK").when(lam & ~k & ~tr, "IGH+IGL")
               .when(h & ~k & ~lam & ~tr, "IGH").when((g | d) & ~a & ~b & ~ig, "TRG+TRD").when((a | b) & ~g & ~d & ~ig, "TRA+TRB")
               .when(~ir, "no IR").otherwise("ambiguous"))
    vj1, vj2, vdj1, vdj2 = (field(c, "junction_aa").isNotNull() for c in CHAINS)
    pairing = (F.when(many & ir, "multichain").when(F.col("receptor_subtype") == "ambiguous", "ambiguous")
               .when(vj1 & vj2 & vdj1 & vdj2, "two full chains").when(vdj2 & vj1 & vdj1, "extra VDJ").when(vj2 & vj1 & vdj1, "extra VJ")
               .when(vj1 & vdj1, "single pair").when(vdj1 | vdj2, "orphan VDJ").when(vj1 | vj2, "orphan VJ").otherwise("no IR"))
    df = df.withColumns({"receptor_type": kind, "receptor_subtype": subtype}).withColumn("chain_pairing", pairing)
    return df.drop("_ir", "_many", *[f"_locus_{c}" for c in CHAINS], *loci)


def in_all_cells(spine: DataFrame, qc: DataFrame) -> DataFrame:
    """Results for all cells of ``spine``; cells without receptor data are ``no IR``."""
    names = ["receptor_type", "receptor_subtype", "chain_pairing"]
    out = spine.join(qc.select("cell_id", *names), "cell_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit("no IR")) for n in names})


def is_orphan() -> Column:
    return F.col("chain_pairing").isin("orphan VJ", "orphan VDJ")
