"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and read again; all but the
last return the columns of documents. ``run`` writes the intermediate tables to
the shared folder of the session (spark.checkpoint.dir).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import decontaminate, language, mixing, near, token_files
from chainweave.llm.queries import language_model, table, tokenizer_file
from chainweave.plans.lineage import scratch, scratch_path, shared_dir

#: no stage but the mix has an SQL form (models, fingerprints, token files)
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without letters go."""
    return language.keep_identified(docs, language_model(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies: that with the smallest doc_id; rows count by id and text, so equal or missing ids lose no other text."""
    keep = near.survivors(docs).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    rows = near.with_text_hash(docs)
    return rows.join(keep, rows.doc_id.cast("long").eqNullSafe(keep.id) & (rows.text_hash == keep.hash), "left_semi").dropDuplicates(
        ["doc_id", "text_hash"]).select(*docs.columns)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often, and as much of it, as the mix takes."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what is read back from them per document."""
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"  # a result: it outlives the stage
    token_files.write_token_files(docs, out, tokenizer_file())
    return token_files.read_token_files(spark, out)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_overlaps),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows. What a stage wrote on its way goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
