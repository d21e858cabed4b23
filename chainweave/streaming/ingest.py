"""Incremental ingest of contig tables.

A cell's chains may come in several files: a streaming aggregation keeps the
chains of each cell (a few) as state and gives the whole cell anew whenever one
arrives. What needs all cells at once (clonotype ids) is not streamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainweave.operators.clonotypes import annotate_df, ir_query
from chainweave.operators.indexing import has_ir, index_chains, with_airr
from chainweave.operators.qc import chain_qc

QC = ("receptor_type", "receptor_subtype", "chain_pairing")


def stream_chains(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of chains (cell_id, chain_idx and the fields) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def whole_cells(chains: DataFrame) -> DataFrame:
    """cell_id, airr: all chains of a cell that have come so far, in order. A chain delivered twice counts once.

    On a stream the chains are keyed state, and a cell is given again when it grows.
    """
    fields = [c for c in chains.columns if c not in ("cell_id", "chain_idx")]
    own = chains.groupBy("cell_id").agg(F.array_sort(F.collect_set(F.struct("chain_idx", F.struct(*fields).alias("c")))).alias("x"))
    return own.select("cell_id", F.transform("x", lambda e: e["c"]).alias("airr"))


def _each_batch(cells: DataFrame, made, out: str, checkpoint: str):
    def each(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure writes the same folder
        made(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return cells.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def qc_stream(chains: DataFrame, out: str, checkpoint: str):
    """Write quality control of the cells that each batch completes or extends."""
    return _each_batch(whole_cells(chains), lambda cells: chain_qc(index_chains(cells)).select("cell_id", *QC), out, checkpoint)


def annotation_stream(chains: DataFrame, reference: DataFrame, columns: list[str], fields: list[str], out: str, checkpoint: str, **options):
    """Write the matches of each batch's cells in a static reference (a table as ir_query takes it): cell_id, ref_id and its columns.

    ``fields``: those of the chains that the comparison needs; ``options`` as for ir_query.
    """
    def hits(cells: DataFrame) -> DataFrame:
        cells = chain_qc(index_chains(cells)).withColumn("has_ir", has_ir()).withColumn("cell_ord", F.xxhash64("cell_id"))
        query = with_airr(cells, fields).drop("airr", "chain_indices")
        return annotate_df(ir_query(query, reference, **options), reference, columns)

    return _each_batch(whole_cells(chains), hits, out, checkpoint)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest rows of each cell in what a stream of quality control has written."""
    newest = Window.partitionBy("cell_id").orderBy(F.desc("batch"))
    return spark.read.parquet(out).withColumn("_n", F.rank().over(newest)).where("_n = 1").drop("_n", "batch")
