from pyspark.sql import functions as F

from chainweave.operators.indexing import has_ir, index_chains, with_airr
from chainweave.operators.qc import chain_qc
from chainweave.streaming import ingest

SCHEMA = "cell_id string, chain_idx int, locus string, productive boolean, umi_count int, junction_aa string"


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_cells_grow(spark, tmp_path):
    """Chains of a cell in several files and batches, one of them twice: the newest state is that of all of them together."""
    first = [("a", 0, "TRA", True, 1, "CA"), ("b", 0, "IGH", True, 1, "CC")]
    second = [("a", 1, "TRB", True, 1, "CB"), ("a", 0, "TRA", True, 1, "CA"), ("c", 0, "TRB", None, 1, "CD")]
    for rows in (first, second, [("b", 1, "IGK", True, 2, "CE"), ("b", 2, "TRB", True, 2, "CF")]):
        arrive(spark, tmp_path, rows)
        ingest.qc_stream(ingest.stream_chains(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.cell_id: (r.receptor_type, r.chain_pairing) for r in ingest.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": ("TCR", "single pair"), "b": ("ambiguous", "ambiguous"), "c": ("no IR", "no IR")}
    steps = {(r.batch, r.cell_id): r.chain_pairing for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert steps == {(0, "a"): "orphan VJ", (0, "b"): "orphan VDJ", (1, "a"): "single pair", (1, "c"): "no IR", (2, "b"): "ambiguous"}


def test_stream_against_a_reference(spark, tmp_path):
    known = spark.createDataFrame([("r1", 0, "TRA", True, 1, "CA"), ("r1", 1, "TRB", True, 1, "CB"), ("r2", 0, "TRB", True, 1, "CB")], SCHEMA)
    fields = ["junction_aa"]
    cells = chain_qc(index_chains(ingest.whole_cells(known))).withColumn("has_ir", has_ir()).withColumn("cell_ord", F.xxhash64("cell_id"))
    reference = with_airr(cells, fields).withColumn("antigen", F.concat(F.lit("x"), "cell_id")).drop("airr", "chain_indices")
    options = {"receptor_arms": "all", "dual_ir": "primary_only"}
    for rows in ([("a", 0, "TRA", True, 1, "CA"), ("b", 0, "TRB", True, 1, "CB")], [("a", 1, "TRB", True, 1, "CB")]):
        arrive(spark, tmp_path, rows)
        ingest.annotation_stream(ingest.stream_chains(spark, str(tmp_path / "in"), SCHEMA), reference, ["antigen"], fields,
                                 str(tmp_path / "out"), str(tmp_path / "cp"), **options).awaitTermination(120)
    got = sorted((r.batch, r.cell_id, r.antigen) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "b", "xr2"), (1, "a", "xr1")]
