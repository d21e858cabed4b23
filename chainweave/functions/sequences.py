"""Sequence and gene-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: loci of the two arms, and the order in which a locus is looked for in gene names
VJ_LOCI = ("TRA", "TRG", "IGK", "IGL")
VDJ_LOCI = ("TRB", "TRD", "IGH")
LOCUS_ORDER = ("TRA", "TRB", "TRD", "TRG", "IGH", "IGK", "IGL")
#: fixed values: the standard genetic code, codons in the order of the bases TCAG; _ stops
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codons() -> Column:
    at = iter(AMINO_ACIDS)
    pairs = [(a + b + c, next(at)) for a in BASES for b in BASES for c in BASES]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def translate(dna: Column) -> Column:
    """Protein of a DNA text: unknown codons are N, an incomplete last codon is left out."""
    n = F.floor(F.length(dna) / 3).cast("int")
    letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(codons(), F.substring(dna, i * 3 - 2, F.lit(3))), F.lit("N")))
    return F.when(dna.isNotNull(), F.when(n > 0, F.array_join(letters, "")).otherwise(""))


def without_allele(gene: Column) -> Column:
    return F.substring_index(gene, "*", 1)


def arm_of(locus: Column) -> Column:
    return F.when(locus.isin(*VJ_LOCI), "VJ").when(locus.isin(*VDJ_LOCI), "VDJ")


def cdr3_aa(junction_aa: Column) -> Column:
    """Without the conserved ends, C and W or F; null where they are not there."""
    return F.when(junction_aa.rlike("^C.*[WF]$"), F.substring(junction_aa, F.lit(2), F.length(junction_aa) - 2))


def cdr3_nt(junction: Column) -> Column:
    n = F.length(junction)
    first, last = translate(F.substring(junction, F.lit(1), F.lit(3))), translate(F.substring(junction, n - 2, F.lit(3)))
    return F.when((first == "C") & last.isin("W", "F"), F.substring(junction, F.lit(4), n - 6))


def infer_locus(v: Column, d: Column, j: Column, c: Column) -> Column:
    """The locus that all gene names which are there agree on; V genes shared by alpha and delta have no say."""
    v = F.when(~v.rlike("TRAV.*/DV"), v)
    calls = F.filter(F.array(v, d, j, c), lambda x: x.isNotNull())
    out = F.lit(None).cast("string")
    for locus in reversed(LOCUS_ORDER):
        out = F.when(F.forall(calls, lambda x: F.lower(x).contains(locus.lower())), locus).otherwise(out)
    return F.when(F.size(calls) > 0, out)
