import pytest
from pyspark.sql import functions as F

from chainweave.operators import indexing, qc

CHAIN = "array<struct<locus:string,junction_aa:string,junction:string,productive:boolean,umi_count:int,consensus_count:bigint>>"


def cells(spark, rows):
    return spark.createDataFrame(rows, f"cell_id string, airr {CHAIN}")


def chain(locus, aa, umi=1, productive=True, reads=0):
    return (locus, aa, None, productive, umi, reads)


def test_index_chains(spark):
    df = indexing.index_chains(cells(spark, [
        ("a", [chain("TRA", "CA", 1), chain("TRB", "CB", 1), chain("TRA", "CC", 5), chain("XXX", "CX", 9)]),
        ("b", [chain("TRA", "CA", 1), chain("TRA", "CB", 1), chain("TRG", "CC", 1)]),
        ("c", None),
        ("d", [chain("TRB", None), chain("TRB", "C", productive=False), chain("TRB", "CZ", None)]),
        ("e", [chain("IGK", "CA", 2, reads=1), chain("IGK", "CA", 2, reads=1), chain("IGH", "C", 1)]),
    ]))
    got = {r.cell_id: (r.chain_indices.VJ, r.chain_indices.VDJ, r.chain_indices.multichain) for r in df.collect()}
    assert got["a"] == ([2, 0], [1, None], False)
    assert got["b"][0] == [2, 1] and got["b"][2] is True
    assert got["c"] == (None, None, False)
    assert got["d"] == ([None, None], [2, None], False)
    assert got["e"] == ([0, 1], [2, None], False)
    wide = indexing.get_airr(df, ["junction_aa"], ["VJ_1", "vdj_1"]).where("cell_id = 'a'").first()
    assert (wide.VJ_1_junction_aa, wide["vdj_1_junction_aa"]) == ("CC", "CB")
    with pytest.raises(ValueError):
        indexing.get_airr(df, ["locus"], ["VJ_3"])


def test_chain_qc(spark):
    df = qc.chain_qc(indexing.index_chains(cells(spark, [
        ("pair", [chain("TRA", "A"), chain("TRB", "B")]), ("orphan", [chain("IGL", "A")]), ("none", None), ("extra", [chain("TRA", "A"), chain("TRB", "B"), chain("TRB", "C")]),
        ("mixed", [chain("TRA", "A"), chain("IGH", "B")]), ("full", [chain("IGK", "A"), chain("IGL", "B"), chain("IGH", "C"), chain("IGH", "D")]),
        ("many", [chain("TRA", "A"), chain("TRA", "B"), chain("TRA", "C")]), ("gd", [chain("TRG", "A"), chain("TRD", "B")]),
    ])))
    got = {r.cell_id: (r.receptor_type, r.receptor_subtype, r.chain_pairing) for r in df.collect()}
    assert got == {
        "pair": ("TCR", "TRA+TRB", "single pair"), "orphan": ("BCR", "IGH+IGL", "orphan VJ"), "none": ("no IR", "no IR", "no IR"),
        "extra": ("TCR", "TRA+TRB", "extra VDJ"), "mixed": ("ambiguous", "ambiguous", "ambiguous"), "full": ("BCR", "IGH+IGK/L", "two full chains"),
        "many": ("multichain", "multichain", "multichain"), "gd": ("TCR", "TRG+TRD", "single pair")}


def test_merge_airr(spark):
    a = cells(spark, [("x", [chain("TRA", "A")]), ("y", None)]).withColumn("s", F.lit("1"))
    b = cells(spark, [("x", [chain("TRA", "A"), chain("TRB", "B")]), ("z", [chain("TRB", "C")])]).withColumn("s", F.lit("1"))
    got = {r.cell_id: [c.junction_aa for c in r.airr] for r in indexing.merge_airr(a, b).collect()}
    assert got == {"x": ["A", "B"], "y": [], "z": ["C"]}
    with pytest.raises(Exception, match="different s"):
        indexing.merge_airr(a, b.withColumn("s", F.lit("2"))).collect()
