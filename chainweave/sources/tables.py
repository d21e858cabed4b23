"""Readers and writers of contig tables: one row per chain, in the columns of the AIRR rearrangement schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweave.functions import sequences as seq
from chainweave.functions.values import is_true, nullify

#: columns of a chain and their types
FIELDS = {
    "cell_id": "string", "sequence_id": "string", "locus": "string", "productive": "boolean", "umi_count": "double", "consensus_count": "double",
    "v_call": "string", "d_call": "string", "j_call": "string", "c_call": "string", "junction": "string", "junction_aa": "string",
    "np1_length": "int", "np2_length": "int", "sequence": "string",
}


def _have(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _csv(spark: SparkSession, path, **options) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=False, **options)
    return df.select(*[nullify(F.col(f"`{c}`")).alias(c) for c in df.columns])


def _number(c: Column, kind: str) -> Column:
    return c.cast("double").cast(kind)


def number_chains(rows: DataFrame) -> DataFrame:
    """Add chain_idx, the place of a chain in its cell by sequence_id."""
    from pyspark.sql import Window

    return rows.withColumn("chain_idx", F.row_number().over(Window.partitionBy("cell_id").orderBy("sequence_id", "locus", "junction_aa", "v_call")) - 1)


def read_10x_csv(spark: SparkSession, path, filtered: bool = True) -> DataFrame:
    df = _csv(spark, path)
    if filtered:
        df = df.where(is_true(F.col("is_cell")) & is_true(F.col("high_confidence")))
    names = {"barcode": "cell_id", "contig_id": "sequence_id", "chain": "locus", "cdr3": "junction_aa", "cdr3_nt": "junction", "v_gene": "v_call", "d_gene": "d_call",
             "j_gene": "j_call", "c_gene": "c_call"}
    extra = [c for c in df.columns if c[:3] in ("fwr", "cdr") and c[3:4].isdigit() and c not in names]
    return df.select(*[F.col(a).alias(b) for a, b in names.items()], is_true(F.col("productive")).alias("productive"), _number(F.col("umis"), "long").alias("umi_count"),
                     _number(F.col("reads"), "long").alias("consensus_count"), is_true(F.col("is_cell")).alias("is_cell"), is_true(F.col("high_confidence")).alias("high_confidence"),
                     *[F.col(c).alias(c[:-3] if c.endswith("_nt") else f"{c}_aa") for c in extra])


_JSON = T.StructType([
    T.StructField("barcode", T.StringType()), T.StructField("contig_name", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField("cdr3", T.StringType()),
    T.StructField("cdr3_seq", T.StringType()), T.StructField("umi_count", T.LongType()), T.StructField("read_count", T.LongType()), T.StructField("productive", T.BooleanType()),
    T.StructField("is_cell", T.BooleanType()), T.StructField("high_confidence", T.BooleanType()),
    *[T.StructField(r, T.StructType([T.StructField("nt_seq", T.StringType()), T.StructField("aa_seq", T.StringType())])) for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "fwr4")],
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("contig_match_start", T.IntegerType()), T.StructField("contig_match_end", T.IntegerType()),
        T.StructField("feature", T.StructType([T.StructField("chain", T.StringType()), T.StructField("gene_name", T.StringType()), T.StructField("region_type", T.StringType())]))]))),
])


def read_10x_json(spark: SparkSession, path, filtered: bool = True) -> DataFrame:
    df = spark.read.schema(_JSON).json(path, multiLine=True)
    if filtered:
        df = df.where("is_cell and high_confidence")
    part = lambda r: F.get(F.filter("annotations", lambda a: a["feature"]["region_type"] == r), 0)
    df = df.withColumns({n: part(r) for n, r in (("v", "L-REGION+V-REGION"), ("d", "D-REGION"), ("j", "J-REGION"), ("c", "C-REGION"))})
    loci = F.array_distinct(F.transform(F.filter("annotations", lambda a: a["feature"]["region_type"].isin("L-REGION+V-REGION", "D-REGION", "J-REGION", "C-REGION")), lambda a: a["feature"]["chain"]))
    df = df.withColumn("locus", F.when(F.size(loci) == 1, F.get(loci, 0)))
    vdj = F.col("locus").isin(*seq.VDJ_LOCI)
    v_end, d_start, d_end, j_start = F.col("v.contig_match_end"), F.col("d.contig_match_start"), F.col("d.contig_match_end"), F.col("j.contig_match_start")
    return df.select(F.col("barcode").alias("cell_id"), F.col("contig_name").alias("sequence_id"), "sequence", "locus", F.coalesce("productive", F.lit(False)).alias("productive"), "umi_count",
                     F.col("read_count").alias("consensus_count"), F.col("cdr3").alias("junction_aa"), F.col("cdr3_seq").alias("junction"),
                     *[F.col(f"{g}.feature.gene_name").alias(f"{g}_call") for g in "vdjc"], F.when(vdj, d_start - v_end).otherwise(j_start - v_end).alias("np1_length"),
                     F.when(vdj, j_start - d_end).alias("np2_length"), "is_cell", "high_confidence",
                     *[F.col(f"{r}.{k}_seq").alias(r if k == "nt" else f"{r}_aa") for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "fwr4") for k in ("nt", "aa")])


def read_10x_vdj(spark: SparkSession, path: str, filtered: bool = True) -> DataFrame:
    """Contigs of the 10x pipeline, JSON or CSV by the file's ending; loci other than the seven stay and are passed over later."""
    return (read_10x_json if path.endswith((".json", ".json.gz")) else read_10x_csv)(spark, path, filtered)


def read_airr(spark: SparkSession, paths, infer: bool = True) -> DataFrame:
    """AIRR rearrangement tables: several are united by column name; a locus is inferred where a table has none."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        df = _csv(spark, path, sep="\t")
        truth = lambda c: F.when(c.isin("T", "t", "True", "true", "TRUE", "1"), True).when(c.isNotNull(), False)
        for c in ("productive", "rev_comp", "is_cell", "high_confidence", "vj_in_frame", "stop_codon"):
            if c in df.columns:
                df = df.withColumn(c, truth(F.col(c)))
        for c in ("umi_count", "duplicate_count", "consensus_count", "np1_length", "np2_length", "junction_length"):
            if c in df.columns:
                df = df.withColumn(c, _number(F.col(c), "long"))
        if infer and "locus" not in df.columns:
            df = df.withColumn("locus", seq.infer_locus(*(_have(df, f"{g}_call") for g in "vdjc")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_airr(chains: DataFrame, path: str, compression: str = "none") -> None:
    """One line per chain, tab-separated; whole numbers without a decimal part, booleans as T and F. ``compression``: none, gzip, ..., also read by ``read_airr``."""
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return F.when(c, "T").when(~c, "F").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string")).alias(f.name)
        return c.cast("string").alias(f.name)

    chains.select(*[text(f) for f in chains.schema]).write.csv(path, sep="\t", header=True, emptyValue="", compression=compression)


def read_bracer(spark: SparkSession, path) -> DataFrame:
    df = _csv(spark, path, sep="\t")
    locus = F.concat(F.lit("IG"), F.col("LOCUS"))
    n = lambda c: _number(F.col(c), "int")
    v_end, d_end = n("V_SEQ_START") + n("V_SEQ_LENGTH"), n("D_SEQ_START") + n("D_SEQ_LENGTH")
    vj = locus.isin(*seq.VJ_LOCI)
    np2 = n("J_SEQ_START") - d_end
    return df.select(F.col("CELL").alias("cell_id"), F.col("SEQUENCE_ID").alias("sequence_id"), locus.alias("locus"), is_true(F.col("FUNCTIONAL")).alias("productive"), F.col("V_CALL").alias("v_call"),
                     F.col("D_CALL").alias("d_call"), F.col("J_CALL").alias("j_call"), seq.without_allele(F.col("C_CALL")).alias("c_call"), F.col("JUNCTION").alias("junction"),
                     seq.translate(F.col("JUNCTION")).alias("junction_aa"), F.col("TPM").cast("double").alias("consensus_count"),
                     F.when(vj, n("J_SEQ_START") - v_end).when(np2.isNotNull(), n("D_SEQ_START") - v_end).alias("np1_length"), F.when(~vj & n("V_SEQ_START").isNotNull(), np2).alias("np2_length"))


#: fixed values: chain types of the BD pipeline
BD_LOCI = {"TCR_Alpha": "TRA", "TCR_Beta": "TRB", "TCR_Gamma": "TRG", "TCR_Delta": "TRD", "BCR_Lambda": "IGL", "BCR_Kappa": "IGK", "BCR_Heavy": "IGH"}


def read_bd_rhapsody(spark: SparkSession, path) -> DataFrame:
    df = _csv(spark, path, comment="#")
    locus = F.lit(None).cast("string")
    for k, v in BD_LOCI.items():
        locus = F.when(F.col("Chain_Type") == k, v).otherwise(locus)
    get = lambda c: F.col(c) if c in df.columns else F.col(f"{c}_Dominant")
    first = df.columns[0]
    return df.select(F.col(first).alias("cell_id"), locus.alias("locus"), get("V_gene").alias("v_call"), get("D_gene").alias("d_call"), get("J_gene").alias("j_call"), get("C_gene").alias("c_call"),
                     get("CDR3_Nucleotide").alias("junction"), get("CDR3_Translation").alias("junction_aa"), is_true(F.col("Productive")).alias("productive"),
                     _number(F.col("Read_Count"), "long").alias("consensus_count"), _number(F.col("Molecule_Count"), "long").alias("umi_count"))


def load_reference(spark: SparkSession, path: str, name: str, source: str | None = None) -> DataFrame:
    """A reference database in Parquet, its name in column ``db``; with ``source`` only the rows from there."""
    df = spark.read.parquet(path).withColumn("db", F.lit(name))
    return df if source is None else df.where(F.col("source") == source)
