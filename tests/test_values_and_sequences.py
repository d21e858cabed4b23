from pyspark.sql import functions as F

from chainweave.functions import sequences as seq
from chainweave.functions import values


def test_missing_and_truth(spark):
    rows = spark.createDataFrame([(x,) for x in ("nan", "None", "N/A", "", None, "False", "0", "FALSE", "foobar", "42")], "x string")
    got = {r.x: (r.na, r.t, r.f) for r in rows.select("x", values.is_missing(F.col("x")).alias("na"), values.is_true(F.col("x")).alias("t"), values.is_false(F.col("x")).alias("f")).collect()}
    assert all(got[x] == (True, False, False) for x in ("nan", "None", "N/A", "", None))
    assert got["False"] == got["0"] == (False, False, True)
    assert got["FALSE"] == got["foobar"] == got["42"] == (False, True, False)


def test_translate_and_cdr3(spark):
    rows = spark.createDataFrame([("TGTGCATGG",), ("TGTNNNTTTA",), ("TG",), (None,), ("TAATGC",)], "x string")
    assert [r[0] for r in rows.select(seq.translate(F.col("x"))).collect()] == ["CAW", "CNF", "", None, "_C"]
    aa = spark.createDataFrame([("CASSF",), ("CASSW",), ("ASSF",), (None,)], "x string")
    assert [r[0] for r in aa.select(seq.cdr3_aa(F.col("x"))).collect()] == ["ASS", "ASS", None, None]


def test_infer_locus(spark):
    rows = spark.createDataFrame([("TRAV1*01", None, "TRAJ3", None), ("TRAV1", None, "TRBJ1", None), ("TRAV29/DV5", None, "TRDJ1", None), (None, None, None, None), ("IGHV1,IGHV2", "IGHD1", None, "IGHM")],
                                 "v string, d string, j string, c string")
    assert [r[0] for r in rows.select(seq.infer_locus(*map(F.col, "vdjc"))).collect()] == ["TRA", None, "TRD", None, "IGH"]
