"""All registered queries of the receptor library and the SQL they are held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.functions import sequences as seq
from chainweave.functions import values
from chainweave.operators import clonotypes as ct
from chainweave.operators import counting, distances, diversity, figures, groups, indexing, layouts, mutation, qc
from chainweave.plans import receptors
from chainweave.plans.lineage import scratch_path, written
from chainweave.plans.numbering import numbered
from chainweave.sources import legacy, tables

#: what indexing, quality control and the wide table read of a chain
CHAIN_FIELDS = ("locus", "productive", "umi_count", "consensus_count", "junction_aa", "junction", "v_call", "d_call", "j_call")
WIDE_FIELDS = ("locus", "junction_aa", "junction", "v_call", "d_call", "j_call", "umi_count")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed cells with quality control; of the chains only those that can be indexed."""
    return qc.chain_qc(indexing.index_chains(receptors.receptor_cells(spark, sf_dir, CHAIN_FIELDS, usable=True)))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that can be indexed, ranked within their cell and arm."""
    return indexing.ranked(receptors.usable_chains(spark, sf_dir).select("cell_ord", "chain_idx", *CHAIN_FIELDS), "cell_ord")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the fields of their chains as columns, has_ir, quality control and a clone named by its primary chains."""
    own = indexing.picked(ranked(spark, sf_dir), "cell_ord", WIDE_FIELDS)
    df = receptors.cells(spark, sf_dir).join(own, "cell_ord", "left").withColumns({"has_ir": F.col("multichain").isNotNull(), "multichain": F.coalesce("multichain", F.lit(False))})
    df = qc.typed(df, lambda c, v: F.col(f"{c}_{v}"), F.col("has_ir"), F.col("multichain")).drop("multichain")
    clone = F.when(F.coalesce("VJ_1_junction_aa", "VDJ_1_junction_aa").isNotNull(), F.concat_ws("/", F.coalesce("VJ_1_junction_aa", F.lit("-")), F.coalesce("VDJ_1_junction_aa", F.lit("-"))))
    return df.withColumn("clone", clone)


def held(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the wide table, written once: for queries that read them several times."""
    return written(wide(spark, sf_dir).select(*columns), "cells")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- oracle building blocks (any engine) -----------------------------------------------------------------------------

_CHAINS = f"chains as ({receptors.chains_sql('varchar', 'lineitem')})"
_CELLS = f"cells as ({receptors.cells_sql('varchar')})"
_RANKED = """ranked as (
  select *, case when locus in ('TRA','TRG','IGK','IGL') then 'VJ' else 'VDJ' end as arm,
    row_number() over (partition by cell_id, case when locus in ('TRA','TRG','IGK','IGL') then 'VJ' else 'VDJ' end
      order by coalesce(umi_count,0) desc, coalesce(consensus_count,0) desc, coalesce(junction,'') desc, coalesce(junction_aa,'') desc, chain_idx) as rn,
    count(*) over (partition by cell_id, case when locus in ('TRA','TRG','IGK','IGL') then 'VJ' else 'VDJ' end) as n
  from chains where productive and junction_aa is not null)"""
_PICK = ",\n  ".join(f"max(case when arm='{a}' and rn={n} then {v} end) as {a}_{n}_{v}" for a in ("VJ", "VDJ") for n in (1, 2) for v in ("chain_idx", *WIDE_FIELDS))
_W0 = f"""w0 as (select cells.*, i.* exclude (cell_id), coalesce(i.many, false) as multichain, i.cell_id is not null as has_ir
  from cells left join (select cell_id, max(n) > 2 as many, {_PICK} from ranked group by cell_id) i on cells.cell_id = i.cell_id)"""
_HAS = {x: f"coalesce('{x}' in (VJ_1_locus,VJ_2_locus,VDJ_1_locus,VDJ_2_locus), false)" for x in ("TRA", "TRB", "TRG", "TRD", "IGH", "IGK", "IGL")}
_W1 = "w1 as (select *, " + ", ".join(
    f"(coalesce(VJ_1_locus,'')='{x}' or coalesce(VJ_2_locus,'')='{x}' or coalesce(VDJ_1_locus,'')='{x}' or coalesce(VDJ_2_locus,'')='{x}') as h_{x}"
    for x in ("TRA", "TRB", "TRG", "TRD", "IGH", "IGK", "IGL")) + " from w0)"
_W2 = """w2 as (select *, h_TRA or h_TRB or h_TRG or h_TRD as tr, h_IGH or h_IGK or h_IGL as ig from w1)"""
_W3 = """w3 as (select *,
  case when multichain and has_ir then 'multichain' when ig and not tr then 'BCR' when tr and not ig then 'TCR' when not has_ir then 'no IR' else 'ambiguous' end as receptor_type,
  case when multichain and has_ir then 'multichain' when h_IGK and h_IGL and h_IGH and not tr then 'IGH+IGK/L' when h_IGK and not h_IGL and not tr then 'IGH+IGK'
    when h_IGL and not h_IGK and not tr then 'IGH+IGL' when h_IGH and not h_IGK and not h_IGL and not tr then 'IGH'
    when (h_TRG or h_TRD) and not h_TRA and not h_TRB and not ig then 'TRG+TRD' when (h_TRA or h_TRB) and not h_TRG and not h_TRD and not ig then 'TRA+TRB'
    when not has_ir then 'no IR' else 'ambiguous' end as receptor_subtype from w2)"""
_WIDE = """wide as (select *,
  case when multichain and has_ir then 'multichain' when receptor_subtype='ambiguous' then 'ambiguous'
    when VJ_1_junction_aa is not null and VDJ_1_junction_aa is not null then
      case when VJ_2_junction_aa is not null and VDJ_2_junction_aa is not null then 'two full chains' when VDJ_2_junction_aa is not null then 'extra VDJ'
        when VJ_2_junction_aa is not null then 'extra VJ' else 'single pair' end
    when VDJ_1_junction_aa is not null then 'orphan VDJ' when VJ_1_junction_aa is not null then 'orphan VJ' else 'no IR' end as chain_pairing,
  case when coalesce(VJ_1_junction_aa, VDJ_1_junction_aa) is not null then coalesce(VJ_1_junction_aa,'-')||'/'||coalesce(VDJ_1_junction_aa,'-') end as clone
  from w3)"""


def on_chains(sql: str) -> str:
    return f"with {_CHAINS} {sql}"


def on_wide(sql: str) -> str:
    """``sql`` starts with further common tables (", x as (...) select ...") or with select."""
    return "with recursive " + ",\n".join([_CHAINS, _CELLS, _RANKED, _W0, _W1, _W2, _W3, _WIDE]) + "\n" + sql


_Q: dict = {}
_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- chains and expressions ------------------------------------------------------------------------------------------


@query(on_chains("select * from chains"))
def chain_view(spark, sf):
    return receptors.chains(spark, sf)


@query(on_chains("select locus, case when locus in ('TRA','TRG','IGK','IGL') then 'VJ' else 'VDJ' end as arm, count(*) as n from chains group by locus"))
def locus_to_arm(spark, sf):
    return receptors.chains(spark, sf).groupBy("locus", seq.arm_of(F.col("locus")).alias("arm")).agg(F.count("*").alias("n"))


@query(on_chains("""select cell_id, chain_idx, case when v_call like locus||'%' and (d_call is null or d_call like locus||'%') and j_call like locus||'%' then locus end as inferred from chains"""))
def infer_locus(spark, sf):
    c = receptors.chains(spark, sf)
    return c.select("cell_id", "chain_idx", seq.infer_locus(F.col("v_call"), F.col("d_call"), F.col("j_call"), F.lit(None).cast("string")).alias("inferred"))


@query(on_chains("select distinct v_call||'*0'||chain_idx as gene, v_call as stripped from chains"))
def allele_strip(spark, sf):
    gene = F.concat("v_call", F.lit("*0"), F.col("chain_idx").cast("string"))
    return receptors.chains(spark, sf).select(gene.alias("gene"), seq.without_allele(gene).alias("stripped")).distinct()


@query(on_chains("""select cell_id, chain_idx, case when regexp_matches(junction_aa,'^C.*[WF]$') then substr(junction_aa,2,length(junction_aa)-2) end as cdr3_aa,
  case when junction is not null then substr(junction,4,length(junction)-6) end as cdr3_nt from chains"""))
def cdr3_from_junction(spark, sf):
    return receptors.chains(spark, sf).select("cell_id", "chain_idx", seq.cdr3_aa(F.col("junction_aa")).alias("cdr3_aa"), seq.cdr3_nt(F.col("junction")).alias("cdr3_nt"))


_TEXTS = "(values ('nan'),('NaN'),('None'),('N/A'),(''),('False'),('false'),('FALSE'),('0'),('True'),('TRUE'),('foobar'),('42'),(null)) t(x)"
_NA = "x is null or x in ('NaN','nan','None','N/A','')"


@query(f"select x, case when not ({_NA}) then x end as y, count(*) as n from {_TEXTS}, region group by x")
def na_normalise(spark, sf):
    t = spark.sql(f"select x from values ('nan'),('NaN'),('None'),('N/A'),(''),('False'),('false'),('FALSE'),('0'),('True'),('TRUE'),('foobar'),('42'),(null) t(x)")
    n = spark.read.parquet(f"{sf}/region.parquet").select(F.lit(1))
    return t.crossJoin(n).groupBy("x").agg(F.count("*").alias("n")).select("x", values.nullify(F.col("x")).alias("y"), "n")


@query(f"select x, not ({_NA}) and x not in ('False','false','0') as is_true, coalesce(not ({_NA}) and x in ('False','false','0'), false) as is_false from {_TEXTS}")
def truthiness(spark, sf):
    t = spark.sql("select x from values ('nan'),('NaN'),('None'),('N/A'),(''),('False'),('false'),('FALSE'),('0'),('True'),('TRUE'),('foobar'),('42'),(null) t(x)")
    return t.select("x", values.is_true(F.col("x")).alias("is_true"), values.is_false(F.col("x")).alias("is_false"))


_CODES = ",".join(f"('{a}{b}{c}','{seq.AMINO_ACIDS[16 * i + 4 * j + k]}')" for i, a in enumerate(seq.BASES) for j, b in enumerate(seq.BASES) for k, c in enumerate(seq.BASES))


@query(on_chains(f""", d as (select distinct junction from chains where junction is not null), p as (select junction, unnest(range(0, length(junction)//3)) as i from d)
select junction, string_agg(aa, '' order by i) as protein from p join (values {_CODES}) c(codon, aa) on codon = substr(junction, cast(3*i+1 as int), 3) group by junction"""))
def translate_dna(spark, sf):
    d = receptors.chains(spark, sf).where("junction is not null").select("junction").distinct()
    return d.select("junction", seq.translate(F.col("junction")).alias("protein"))


# ---- indexing and quality control ------------------------------------------------------------------------------------


@query(on_wide("select cell_id, VJ_1_chain_idx as vj1, VJ_2_chain_idx as vj2, VDJ_1_chain_idx as vdj1, VDJ_2_chain_idx as vdj2, multichain from wide"))
def index_chains(spark, sf):
    df = indexing.index_chains(receptors.receptor_cells(spark, sf, CHAIN_FIELDS))
    return df.select("cell_id", *[F.get(f"chain_indices.{a}", n - 1).alias(f"{a.lower()}{n}") for a in ("VJ", "VDJ") for n in (1, 2)], F.col("chain_indices.multichain").alias("multichain"))


@query(on_wide("select multichain, count(*) as n from wide group by multichain"))
def multichain_flag(spark, sf):
    return base(spark, sf).groupBy(F.col("chain_indices.multichain").alias("multichain")).agg(F.count("*").alias("n"))


@query(on_wide("select cell_id, VJ_1_junction_aa, VJ_1_locus, VJ_2_junction_aa, VJ_2_locus, VDJ_1_junction_aa, VDJ_1_locus, VDJ_2_junction_aa, VDJ_2_locus from wide"))
def get_airr_wide(spark, sf):
    return indexing.get_airr(base(spark, sf), ("junction_aa", "locus"))


@query(on_wide("select cell_id, has_ir from wide"))
def has_ir(spark, sf):
    return base(spark, sf).select("cell_id", indexing.has_ir().alias("has_ir"))


@query(f"""with {_CHAINS}, {_CELLS}, r as (select *, row_number() over (partition by cell_id order by coalesce(consensus_count,0) desc, chain_idx) as rn from chains
  where productive and junction_aa is not null and locus in ('TRA','TRG','IGK','IGL')) select cells.cell_id, chain_idx as vj1 from cells left join r on cells.cell_id = r.cell_id and rn = 1""")
def chain_sort_custom_keys(spark, sf):
    df = indexing.index_chains(receptors.receptor_cells(spark, sf, CHAIN_FIELDS), sort_keys={"consensus_count": 0})
    return df.select("cell_id", F.get("chain_indices.VJ", 0).alias("vj1"))


@query(on_wide("select receptor_type, count(*) as n from wide group by receptor_type"))
def chain_qc_types(spark, sf):
    return base(spark, sf).groupBy("receptor_type").agg(F.count("*").alias("n"))


@query(on_wide("select cell_id, receptor_subtype from wide"))
def chain_qc_subtype(spark, sf):
    return base(spark, sf).select("cell_id", "receptor_subtype")


@query(on_wide("select cell_id, chain_pairing from wide"))
def chain_pairing(spark, sf):
    return base(spark, sf).select("cell_id", "chain_pairing")


# ---- counting --------------------------------------------------------------------------------------------------------

_EXP = "case when clone is null then 'nan' when n <= 1 then '<= 1' when n <= 2 then '<= 2' else '> 2' end"


@query(on_wide(f"select cell_id, {_EXP} as clonal_expansion from (select *, count(*) over (partition by clone) as n from wide)"))
def clonal_expansion(spark, sf):
    return counting.clonal_expansion(held(spark, sf, "cell_id", "clone"), "clone").select("cell_id", "clonal_expansion")


@query(on_wide(f"select cell_id, {_EXP} as clonal_expansion from (select *, count(*) over (partition by sample, clone) as n from wide)"))
def clonal_expansion_in_group(spark, sf):
    return counting.clonal_expansion(held(spark, sf, "cell_id", "sample", "clone"), "clone", "sample").select("cell_id", "clonal_expansion")


def _summary(rows: str, value: str) -> str:
    return on_wide(f""", e as (select *, {_EXP} as label from (select *, count(*) over (partition by clone) as n from wide) where clone is not null),
r as ({rows}), c as (select sample, label, count(*) as n from r group by sample, label),
spine as (select * from (select distinct sample from r), (values ('<= 1'),('<= 2'),('> 2')) l(label))
select spine.sample, spine.label as clonal_expansion, round({value}, 6) as value from spine left join c using (sample, label)""")


@query(_summary("select sample, label from e", "coalesce(n,0) / sum(n) over (partition by spine.sample)"))
def summarize_expansion_cell(spark, sf):
    return _rounded(counting.summarize_clonal_expansion(held(spark, sf, "sample", "clone"), "sample", "clone"), "value")


@query(_summary("select distinct sample, clone, label from e", "coalesce(n,0) * 1.0"))
def summarize_expansion_clone(spark, sf):
    return counting.summarize_clonal_expansion(held(spark, sf, "sample", "clone"), "sample", "clone", "clone_id", normalize=False)


@query(on_wide(""", c as (select sample, receptor_type, count(*) as n from wide where sample in ('MACHINERY', 'BUILDING') group by all),
t as (select receptor_type, row_number() over (order by sum(n) desc, receptor_type) as target_rank from c group by receptor_type)
select sample, receptor_type, n * 1.0 as value, case sample when 'MACHINERY' then 1 else 2 end as group_rank, target_rank from c join t using (receptor_type)"""))
def group_abundance_listed(spark, sf):
    return counting.group_abundance(base(spark, sf), "sample", "receptor_type", sort=["MACHINERY", "BUILDING"])


def _abundance(value: str) -> str:
    return on_wide(f""", c as (select sample, receptor_type, count(*) as n from wide group by all), g as (select sample, row_number() over (order by sum(n) desc, sample) as group_rank from c group by sample),
t as (select receptor_type, row_number() over (order by sum(n) desc, receptor_type) as target_rank from c group by receptor_type)
select sample, receptor_type, round({value}, 6) as value, group_rank, target_rank from c join g using (sample) join t using (receptor_type)""")


@query(_abundance("n * 1.0"))
def group_abundance_count(spark, sf):
    return _rounded(counting.group_abundance(base(spark, sf), "sample", "receptor_type"), "value")


@query(_abundance("n / sum(n) over (partition by sample)"))
def group_abundance_fraction(spark, sf):
    return _rounded(counting.group_abundance(base(spark, sf), "sample", "receptor_type", fraction=True), "value")


def _spectratype(value: str) -> str:
    return on_wide(f""", c as (select length(VJ_1_junction_aa) as length, sample, count(*) as n from wide where VJ_1_junction_aa is not null group by all)
select l.length, s.sample, round(coalesce({value}, 0), 6) as value from (select unnest(range(0, (select max(length) + 1 from c))) as length) l
cross join (select distinct sample from c) s left join (select *, sum(n) over (partition by sample) as t from c) c on c.length = l.length and c.sample = s.sample""")


@query(_spectratype("n * 1.0"))
def spectratype(spark, sf):
    return _rounded(counting.spectratype(wide(spark, sf), "sample"), "value")


@query(_spectratype("n / t"))
def spectratype_fraction(spark, sf):
    return _rounded(counting.spectratype(wide(spark, sf), "sample", fraction=True), "value")


_GENES = ("VJ_1_v_call", "VJ_1_j_call", "VDJ_1_v_call", "VDJ_1_d_call", "VDJ_1_j_call")


@query(on_wide(", l as (" + " union all ".join(f"select '{g}' as col, coalesce({g}, 'none') as segment from wide" for g in _GENES) + """), c as (select col, segment, count(*) as n from l group by all),
r as (select *, row_number() over (partition by col order by n desc, segment) as rn from c)
select col, case when rn <= 10 then segment else 'other' end as segment, sum(n) * 1.0 as value from r group by 1, 2"""))
def vdj_usage_segments(spark, sf):
    return counting.vdj_segments(wide(spark, sf), _GENES, 10)


@query(on_wide("select " + ", ".join(f"coalesce({g}, 'none') as {g}" for g in _GENES) + ", count(*) * 1.0 as value from wide group by 1,2,3,4,5 order by 6 desc, 1, 2, 3, 4, 5 limit 20"))
def vdj_usage_ribbons(spark, sf):
    return counting.vdj_ribbons(wide(spark, sf), _GENES, 20)


@query(on_wide(""", m as (select VJ_1_junction_aa as s, unnest(range(0, 14)) as pos from wide where length(VJ_1_junction_aa) = 14)
select cast(pos as int) as pos, substr(s, cast(pos + 1 as int), 1) as letter, count(*) * 1.0 as value from m group by 1, 2"""))
def motif_counts(spark, sf):
    return counting.motif(wide(spark, sf).where("length(VJ_1_junction_aa) = 14"), "VJ_1_junction_aa")


@query(on_wide(""", m as (select VJ_1_junction_aa as s, unnest(range(0, 14)) as pos from wide where length(VJ_1_junction_aa) = 14),
c as (select pos, substr(s, cast(pos + 1 as int), 1) as letter, count(*) as n from m group by 1, 2), p as (select *, n / sum(n) over (partition by pos) as p from c)
select cast(pos as int) as pos, letter, round(p * (log2(20.0) + sum(p * log2(p)) over (partition by pos)), 6) as value from p"""))
def motif_information(spark, sf):
    return _rounded(counting.motif(wide(spark, sf).where("length(VJ_1_junction_aa) = 14"), "VJ_1_junction_aa", "information"), "value")


_ALPHA = """, c as (select sample, clone, count(*) as n from wide where clone is not null and sample is not null group by all), p as (select *, n / sum(n) over (partition by sample) as p,
  row_number() over (partition by sample order by n, clone) as up, row_number() over (partition by sample order by n desc, clone) as i, sum(n) over (partition by sample order by n desc, clone rows unbounded preceding) as upto,
  sum(n) over (partition by sample) as total, count(*) over (partition by sample) as k from c) """


def _alpha(metric: str, value: str, where: str = "true", **options):
    def f(spark, sf):
        return _rounded(diversity.alpha_diversity(wide(spark, sf), "sample", "clone", metric, **options), "value")

    f.__name__ = "alpha_" + {"normalized_shannon_entropy": "shannon"}.get(metric, metric.lower())
    query(on_wide(f"{_ALPHA} select sample, round({value}, 6) as value from p where {where} group by sample"))(f)


_alpha("normalized_shannon_entropy", "case when count(*) = 1 then 0 else sum(-p*ln(p))/ln(count(*)) end")
_alpha("D50", "min(i) / max(k) * 100", "upto >= total * 0.5")
_alpha("DXX", "min(i) / max(k) * 100", "upto >= total * 0.8", percentage=80)
_alpha("observed_otus", "count(*) * 1.0")
_alpha("simpson", "1 - sum(p*p)")
_alpha("berger_parker_d", "max(p)")
_alpha("chao1", "count(*) + count(*) filter (n=1) * (count(*) filter (n=1) - 1) / (2.0 * (count(*) filter (n=2) + 1))")
_alpha("gini_index", "2 * sum(up * p) / count(*) - (count(*) + 1) / count(*)")


@query(on_wide("select sample, count(*) * 1.0 as value from (select distinct sample, clone from wide where clone is not null) group by sample"))
def alpha_callable(spark, sf):
    return diversity.alpha_diversity(wide(spark, sf), "sample", "clone", len)


@query(on_wide(""", x as (select *, VJ_1_junction_aa as coarse, VJ_1_junction||VJ_1_v_call as fine from wide), g as (select coarse, count(distinct fine) as k from x where coarse is not null and fine is not null group by coarse)
select cell_id, case when coarse is not null then case when k > 1 then 'convergent' else 'not convergent' end end as is_convergent from x left join g using (coarse)"""))
def convergence(spark, sf):
    rows = wide(spark, sf).withColumn("fine", F.concat("VJ_1_junction", "VJ_1_v_call"))
    return counting.convergence(rows, "VJ_1_junction_aa", "fine").select("cell_id", "is_convergent")


@query(on_wide(""", c as (select clone, count(*) filter (status='F') as f, count(*) filter (status='O') as o from wide where clone is not null group by clone)
select f, o, count(*) as n from c where f > 0 or o > 0 group by f, o"""))
def overlap_pair_table(spark, sf):
    c = wide(spark, sf).where("clone is not null").groupBy("clone").agg(F.count_if(F.col("status") == "F").alias("f"), F.count_if(F.col("status") == "O").alias("o"))
    return counting.overlap_pairs(c, "f", "o")


# ---- distances -------------------------------------------------------------------------------------------------------

_SEQS = """, s as (select distinct 'VJ' as arm, VJ_1_junction_aa as seq from wide where VJ_1_junction_aa is not null union select 'VJ', VJ_2_junction_aa from wide where VJ_2_junction_aa is not null
  union select 'VDJ', VDJ_1_junction_aa from wide where VDJ_1_junction_aa is not null union select 'VDJ', VDJ_2_junction_aa from wide where VDJ_2_junction_aa is not null)"""


def seqs(spark, sf) -> DataFrame:
    """arm, seq of the cells' first two chains of each arm; of a cell only its key is read, and no chain is put into columns."""
    rows = ranked(spark, sf).where("rank <= 2").join(receptors.cell_keys(spark, sf), "cell_ord", "left_semi")
    return written(rows.select("arm", F.upper("junction_aa").alias("seq")).distinct(), "sequences")  # a join of pairs reads them several times


def _distance(name: str, metric: str, sql: str, **options):
    def f(spark, sf):
        return distances.ir_dist(seqs(spark, sf), None, metric, **options)

    f.__name__ = name
    query(on_wide(_SEQS + sql))(f)


_distance("dist_identity", "identity", " select arm, seq as seq1, seq as seq2, 0 as dist from s")
_distance("dist_hamming", "hamming", " select a.arm, a.seq as seq1, b.seq as seq2, cast(hamming(a.seq, b.seq) as int) as dist from s a join s b on a.arm = b.arm and length(a.seq) = length(b.seq) where hamming(a.seq, b.seq) <= 2")
_distance("dist_gpu_hamming", "gpu_hamming", " select a.arm, a.seq as seq1, b.seq as seq2, cast(hamming(a.seq, b.seq) as int) as dist from s a join s b on a.arm = b.arm and length(a.seq) = length(b.seq) where hamming(a.seq, b.seq) <= 1", cutoff=1)
_distance("dist_norm_hamming", "normalized_hamming", " select a.arm, a.seq as seq1, b.seq as seq2, cast(floor(100.0 * hamming(a.seq, b.seq) / length(a.seq) + 0.5) as int) as dist from s a join s b on a.arm = b.arm and length(a.seq) = length(b.seq) where floor(100.0 * hamming(a.seq, b.seq) / length(a.seq) + 0.5) <= 14", cutoff=14)
_distance("dist_levenshtein", "levenshtein", " select a.arm, a.seq as seq1, b.seq as seq2, cast(levenshtein(a.seq, b.seq) as int) as dist from s a join s b on a.arm = b.arm and abs(length(a.seq) - length(b.seq)) <= 2 where levenshtein(a.seq, b.seq) <= 2")
_M = distances.substitution_matrix()
_MATRIX = ", mat as (select * from (values " + ",".join(f"('{a}{b}',{_M[i, j]})" for i, a in enumerate(distances.LETTERS) for j, b in enumerate(distances.LETTERS)) + ") m(pair, v))"
def _scored(name: str, metric: str, sql: str):
    def f(spark, sf):
        return distances.ir_dist(seqs(spark, sf), None, metric)

    f.__name__ = name
    query(sql and on_wide(sql))(f)


_LETTERWISE = """, u as (select arm, length(seq) as n, seq, unnest(range(1, length(seq) + 1)) as i, unnest(string_split(seq, '')) as c from s)"""
_ALIGNED = _SEQS + _MATRIX + _LETTERWISE + """, self as (select arm, seq, sum(v) as v from u join mat on pair = c||c group by arm, seq),
d as (select a.arm, a.seq as seq1, b.seq as seq2, sum(v) as v from u a join u b on a.arm = b.arm and a.n = b.n and a.i = b.i join mat on pair = a.c||b.c group by 1, 2, 3)
select d.arm, seq1, seq2, cast(least(x.v, y.v) - d.v as int) as dist from d join self x on x.arm = d.arm and x.seq = seq1 join self y on y.arm = d.arm and y.seq = seq2 where least(x.v, y.v) - d.v <= 10"""
_scored("dist_alignment", "alignment", _ALIGNED)
# letters of one sequence that the other lacks cost 4 each
_scored("dist_fastalignment", "fastalignment", _ALIGNED + f"""
  and 4 * list_sum(list_transform(string_split('{distances.LETTERS}', ''), lambda l: greatest(length(replace(seq2, l, '')) - length(replace(seq1, l, '')), 0))) <= 10""")
class _Halves(distances.DistanceCalculator):
    """An own metric: mismatches of sequences of one length, at most one; a pair shares its first or its second half."""

    def kernel(self, x, y):
        (a, n), (b, m) = distances.encode(x), distances.encode(y)
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(v, ((0, 0), (0, width - v.shape[1])), constant_values=len(distances.LETTERS)) for v in (a, b))
        return np.where(n[:, None] == m[None], (a[:, None] != b[None]).sum(axis=2), 255)

    def keys(self):
        half = F.floor(F.length("seq") / 2).cast("int")
        first, second = F.substring("seq", F.lit(1), half), F.substring("seq", half + 1, F.length("seq"))
        return F.transform(F.array(F.concat(F.lit("1 "), first), F.concat(F.lit("2 "), second)), lambda k: F.concat(k, F.lit(" "), F.length("seq")))


@query(on_wide(_SEQS + " select a.arm, a.seq as seq1, b.seq as seq2, cast(hamming(a.seq, b.seq) as int) as dist from s a join s b on a.arm = b.arm and length(a.seq) = length(b.seq) where hamming(a.seq, b.seq) <= 1"))
def dist_own_calculator(spark, sf):
    return distances.ir_dist(seqs(spark, sf), None, _Halves(1, 0))


_scored("dist_tcrdist", "tcrdist", _SEQS + """, mat as (select pair, case when substr(pair,1,1) = substr(pair,2,1) then 0 else 3 * least(4, 4 - v) end as w from (values """ + ",".join(
    f"('{a}{b}',{_M[i, j]})" for i, a in enumerate(distances.LETTERS) for j, b in enumerate(distances.LETTERS)) + """) m(pair, v)),
p as (select a.arm, a.seq as seq1, b.seq as seq2, length(a.seq) as n, length(b.seq) as m, least(length(a.seq), length(b.seq)) as short,
  case when length(a.seq) = length(b.seq) then length(a.seq) - 2 else least(6, 3 + (least(length(a.seq), length(b.seq)) - 5) // 2) end as g from s a join s b on a.arm = b.arm and abs(length(a.seq) - length(b.seq)) <= 5),
x as (select *, list_transform(range(3, g), lambda k: substr(seq1, cast(k + 1 as int), 1) || substr(seq2, cast(k + 1 as int), 1)) as l,
  case when n = m then [] else list_transform(range(2, short - g), lambda k: substr(seq1, cast(n - k as int), 1) || substr(seq2, cast(m - k as int), 1)) end as r from p),
y as (select arm, seq1, seq2, n, m, unnest(list_concat(l, r)) as pair from x)
select y.arm, seq1, seq2, cast(sum(w) + 4 * abs(n - m) as int) as dist from y join mat using (pair) group by y.arm, seq1, seq2, n, m having sum(w) + 4 * abs(n - m) <= 20""")


@query(on_wide(_SEQS + ", r as (select distinct 'VJ' as arm, junction_aa as seq from chains where productive and locus = 'TRA' and umi_count > 25 and junction_aa is not null) select s.arm, s.seq as seq1, s.seq as seq2, 0 as dist from s join r using (arm, seq)"))
def dist_identity_ref(spark, sf):
    ref = receptors.chains(spark, sf).where("productive and locus = 'TRA' and umi_count > 25 and junction_aa is not null").select(F.lit("VJ").alias("arm"), F.upper("junction_aa").alias("seq")).distinct()
    return distances.ir_dist(seqs(spark, sf), ref, "identity")


@query(on_wide(_SEQS + ", d as (select a.arm, a.seq, min(hamming(a.seq, b.seq)) as d from s a join s b on a.arm = b.arm and length(a.seq) = length(b.seq) and a.seq <> b.seq group by 1, 2) select arm, nearest, count(*) as n from (select s.arm, cast(coalesce(d, length(s.seq)) as int) as nearest from s left join d using (arm, seq)) group by 1, 2"))
def nn_histogram(spark, sf):
    return distances.nearest_neighbours(seqs(spark, sf)).groupBy("arm", "nearest").agg(F.count("*").alias("n"))


@query(on_wide(", v as (select distinct VJ_1_junction_aa as seq from wide where VJ_1_junction_aa is not null), p as (select row_number() over (order by seq) as pos, seq from v) select a.pos as pos1, b.pos as pos2, cast(levenshtein(a.seq, b.seq) as int) as dist from p a join p b on abs(length(a.seq) - length(b.seq)) <= 1 where levenshtein(a.seq, b.seq) <= 1"))
def sequence_dist(spark, sf):
    v = wide(spark, sf).where("VJ_1_junction_aa is not null").select(F.col("VJ_1_junction_aa").alias("seq")).distinct()
    return distances.sequence_dist(numbered(v, "seq", "n").select("seq", (F.col("n") + 1).alias("pos")), "levenshtein", 1)


# ---- clonotypes ------------------------------------------------------------------------------------------------------

def _components(nodes: str) -> str:
    """``nodes``: SQL giving (ord, hub) pairs; label of a cell: least cell_ord reachable through shared hubs, spread until nothing changes."""
    return f""", inc as materialized ({nodes}),
spread(ord, low) using key (ord) as (
  select distinct ord, ord as low from inc
  union
  select t.ord, min(h.low) as low from inc join (select hub, min(c.low) as low from inc join recurring.spread c using (ord) group by hub) h using (hub)
    join recurring.spread t on t.ord = inc.ord where h.low < t.low group by t.ord)
select 'cell_'||ord as cell_id, cast(dense_rank() over (order by low) - 1 as varchar) as cluster_id, count(*) over (partition by low) as cluster_size from spread"""


def _clusters(name: str, nodes: str | None, **options):
    def f(spark, sf):
        return ct.define_clonotype_clusters(wide(spark, sf), **options)

    f.__name__ = name
    query(nodes and on_wide(_components(nodes)))(f)


def _hubs(field: str, arms=("VJ", "VDJ"), chains=(1, 2), gene: str = "", group: str = "receptor_type") -> str:
    out = []
    for a in arms:
        for n in chains:
            seq_ = f"{a}_{n}_{field}"
            ok = f"{seq_} is not null" + (f" and {a}_{n}_{gene} is not null" if gene else "")
            hub = f"'{a}|'||{seq_}||'|'||{group}" + (f"||'|'||{a}_{n}_{gene}" if gene else "")
            out.append(f"select cell_ord as ord, {hub} as hub from wide where {ok}")
            # every cell with a configuration takes part, and equal configurations are one clonotype
    own = "||'|'||".join(f"coalesce({a}_{n}_{k}, '~')" for a in arms for n in chains for k in (field, *([gene] if gene else [])))
    some = "coalesce(" + ", ".join(f"{a}_{n}_{k}" for a in arms for n in chains for k in (field, *([gene] if gene else []))) + ")"
    out.append(f"select cell_ord, 'own|'||{own}||'|'||{group} from wide where has_ir and {some} is not null")
    return " union all ".join(out)


_clusters("clusters_any_any", _hubs("junction_aa"), receptor_arms="any", dual_ir="any")
_clusters("clusters_vj_any", _hubs("junction_aa", ("VJ",)), receptor_arms="VJ", dual_ir="any")
_clusters("clusters_any_primary", _hubs("junction_aa", chains=(1,)), receptor_arms="any", dual_ir="primary_only")
_clusters("clusters_same_v", _hubs("junction_aa", ("VDJ",), gene="v_call"), receptor_arms="VDJ", dual_ir="any", same_v_gene=True)
_clusters("clusters_same_j", _hubs("junction_aa", ("VDJ",), gene="j_call"), receptor_arms="VDJ", dual_ir="any", same_j_gene=True)
_clusters("clusters_within_group", _hubs("junction_aa", ("VJ",), group="receptor_type||'|'||sample"), receptor_arms="VJ", dual_ir="any", match=("receptor_type", "sample"))
_PRIMARY = "select cell_ord as ord, coalesce(VJ_1_{0},'~')||'|'||coalesce(VDJ_1_{0},'~')||'|'||receptor_type as hub from wide where coalesce(VJ_1_{0}, VDJ_1_{0}) is not null"
_clusters("clusters_all_primary", _PRIMARY.format("junction_aa"), receptor_arms="all", dual_ir="primary_only")
_PAIRS = """, g as (select min(cell_ord) as ct, VJ_1_{f} as a1, VJ_2_{f} as a2, VDJ_1_{f} as b1, VDJ_2_{f} as b2, receptor_type as t from wide where coalesce(VJ_1_{f}, VDJ_1_{f}) is not null group by 2,3,4,5,6),
c as (select ct, 'A' as arm, 1 as slot, a1 as seq, t from g where a1 is not null union all select ct, 'A', 2, a2, t from g where a2 is not null union all select ct, 'B', 1, b1, t from g where b1 is not null union all select ct, 'B', 2, b2, t from g where b2 is not null),
m as (select x.ct as i, y.ct as j, x.arm, bool_or(x.slot=1 and y.slot=1) as s11, bool_or(x.slot=2 and y.slot=2) as s22, bool_or(x.slot=1 and y.slot=2) as s12, bool_or(x.slot=2 and y.slot=1) as s21
  from c x join c y on x.arm = y.arm and x.seq = y.seq and x.t = y.t and x.ct < y.ct group by 1, 2, 3),
k as (select i, j, max(case when arm='A' then {arm_a} end) as da, max(case when arm='B' then {arm_b} end) as db, any_value(g1.a1 is not null) as ia, any_value(g1.b1 is not null) as ib, any_value(g2.a1 is not null) as ja, any_value(g2.b1 is not null) as jb
  from m join g g1 on g1.ct = i join g g2 on g2.ct = j group by i, j),
e as materialized (select i, j from k where {keep})"""
_TWO = "case when (case when g1.{0}2 is null then 1 else 2 end) = (case when g2.{0}2 is null then 1 else 2 end) then case when g1.{0}2 is null then cast(s11 as int) else cast((s11 and s22) or (s12 and s21) as int) end else 0 end"
_BOTH_ARMS = "(cast(ia as int) + cast(ib as int)) = (cast(ja as int) + cast(jb as int)) and case when ia and ib then coalesce(da, 0) = 1 and coalesce(db, 0) = 1 else coalesce(da, 0) = 1 or coalesce(db, 0) = 1 end"


def _pair_clusters(name: str, field: str, arm: str, keep: str, **options):
    body = _PAIRS.replace("{f}", field).replace("{arm_a}", arm.format("a")).replace("{arm_b}", arm.format("b")).replace("{keep}", keep)
    hubs = """select ord, hub from (select cell_ord as ord, g.ct||'' as hub from wide join g on VJ_1_{f} is not distinct from a1 and VJ_2_{f} is not distinct from a2 and VDJ_1_{f} is not distinct from b1 and VDJ_2_{f} is not distinct from b2 and receptor_type = t
  where coalesce(VJ_1_{f}, VDJ_1_{f}) is not null) union all select i, i||'-'||j from e union all select j, i||'-'||j from e""".replace("{f}", field)

    def f(spark, sf):
        return ct.define_clonotype_clusters(wide(spark, sf), sequence="nt" if field == "junction" else "aa", **options)

    f.__name__ = name
    query(on_wide(body + _components(hubs)))(f)


_pair_clusters("clonotypes_nt", "junction", "1", _BOTH_ARMS, receptor_arms="all", dual_ir="any")
_pair_clusters("clusters_all_any", "junction_aa", "1", _BOTH_ARMS, receptor_arms="all", dual_ir="any")
_pair_clusters("clusters_all_all", "junction_aa", _TWO, _BOTH_ARMS, receptor_arms="all", dual_ir="all")
_pair_clusters("clusters_any_all", "junction_aa", _TWO, "coalesce(da, 0) = 1 or coalesce(db, 0) = 1", receptor_arms="any", dual_ir="all")


_NEAR = """, g as (select min(cell_ord) as ct, VJ_1_junction_aa as a, VDJ_1_junction_aa as b, receptor_type as t from wide where has_ir and coalesce(VJ_1_junction_aa, VDJ_1_junction_aa) is not null group by 2, 3, 4),
p as (select x.ct as i, y.ct as j, x.a as xa, y.a as ya, x.b as xb, y.b as yb from g x join g y on x.t = y.t and coalesce(length(x.a), 0) = coalesce(length(y.a), 0) and coalesce(length(x.b), 0) = coalesce(length(y.b), 0) and x.ct < y.ct),
e as materialized (select i, j from p where (xa is null or hamming(xa, ya) <= 1) and (xb is null or hamming(xb, yb) <= 1))"""
_NEAR_HUBS = """select cell_ord as ord, g.ct||'' as hub from wide join g on VJ_1_junction_aa is not distinct from a and VDJ_1_junction_aa is not distinct from b and receptor_type = t
  where has_ir and coalesce(VJ_1_junction_aa, VDJ_1_junction_aa) is not null union all select i, i||'-'||j from e union all select j, i||'-'||j from e"""


@query(on_wide(_NEAR + _components(_NEAR_HUBS)))
def clusters_hamming(spark, sf):
    return ct.define_clonotype_clusters(wide(spark, sf), metric="hamming", cutoff=1, receptor_arms="all", dual_ir="primary_only")


@query()
def clusters_leiden(spark, sf):
    return ct.define_clonotype_clusters(wide(spark, sf), metric="hamming", cutoff=1, receptor_arms="all", dual_ir="primary_only", partitions="leiden")


@query()
def clusters_fastgreedy(spark, sf):
    return ct.define_clonotype_clusters(wide(spark, sf), metric="hamming", cutoff=1, receptor_arms="all", dual_ir="primary_only", partitions="fastgreedy")


def _network(spark, sf):
    s = ct.Setup(metric="identity", receptor_arms="all", dual_ir="any")
    table, members = ct.configurations(wide(spark, sf), s)
    return table, members, s


@query()
def clonotype_network(spark, sf):
    table, members, s = _network(spark, sf)
    nodes = ct.network_nodes(members, ct.links(table, s), min_cells=3, min_nodes=2)
    return layouts.layout(nodes, None, cliques=ct.cliques(table, s)).join(nodes, "ct")


@query()
def network_tables(spark, sf):
    table, members, s = _network(spark, sf)
    cells = held(spark, sf, "cell_id", "status", "sample")
    nodes = ct.network_nodes(members, ct.links(table, s), min_cells=3, min_nodes=2, mask=cells.where("status = 'F'"))
    places = layouts.layout(nodes, None, cliques=ct.cliques(table, s))
    return figures.network_tables(places, members, cells.withColumn("label", F.col("sample")), ct.linked_pairs(table, s))[0]


_NODES = """, own as (select *, min(cell_ord) over (partition by VJ_1_junction_aa, VDJ_1_junction_aa, receptor_type) as ct from wide where has_ir and coalesce(VJ_1_junction_aa, VDJ_1_junction_aa) is not null)"""


def _members(spark, sf):
    cells = held(spark, sf, "cell_id", "cell_ord", "has_ir", "receptor_type", "VJ_1_junction_aa", "VDJ_1_junction_aa", "VJ_1_umi_count", "VJ_1_v_call")
    return cells, ct.configurations(cells, ct.Setup(receptor_arms="all", dual_ir="primary_only"))[1]


@query(on_wide(_NODES + " select ct, round(avg(VJ_1_umi_count), 6) as value from own group by ct"))
def node_means(spark, sf):
    cells, members = _members(spark, sf)
    return _rounded(figures.node_means(members, cells, "VJ_1_umi_count"), "value")


@query(on_wide(_NODES + " select ct, coalesce(VJ_1_v_call, 'nan') as category, round(count(*) / sum(count(*)) over (partition by ct), 6) as share from own group by 1, 2"))
def node_shares(spark, sf):
    cells, members = _members(spark, sf)
    return _rounded(figures.node_shares(members, cells, "VJ_1_v_call"), "share")


@query(on_chains("select distinct v_call, regexp_replace(v_call, 'TRA|TRB|TRD|TRG|IGH|IGK|IGL', '', 'g') as label from chains"))
def gene_labels(spark, sf):
    return receptors.chains(spark, sf).select("v_call", figures.gene_label(F.col("v_call")).alias("label")).distinct()


# ---- reference queries -----------------------------------------------------------------------------------------------


def reference(cells: DataFrame) -> DataFrame:
    """A reference table: cells of one status, annotated with their sample as ``epitope``."""
    return cells.where("status = 'P'").withColumn("epitope", F.col("sample"))


def _queried(spark, sf, *sequences: str) -> tuple[DataFrame, DataFrame]:
    """(cells, those that serve as the reference)."""
    cells = held(spark, sf, "cell_id", "cell_ord", "has_ir", "receptor_type", "status", "sample", *sequences)
    return cells, reference(cells)


_REF = """, q as (select cell_id, cell_ord, VJ_1_junction_aa as a, VDJ_1_junction_aa as b, receptor_type as t from wide where coalesce(VJ_1_junction_aa, VDJ_1_junction_aa) is not null),
r as (select cell_id as ref_id, VJ_1_junction_aa as a, VDJ_1_junction_aa as b, receptor_type as t, sample as epitope, patient from wide where status = 'P' and coalesce(VJ_1_junction_aa, VDJ_1_junction_aa) is not null),
h as (select q.cell_id, r.ref_id, epitope from q join r on q.t = r.t and q.a is not distinct from r.a and q.b is not distinct from r.b)"""
_OPTIONS = {"receptor_arms": "all", "dual_ir": "primary_only"}


@query(on_wide(_REF + " select cell_id, ref_id, epitope from h"))
def query_annotate_df(spark, sf):
    cells, ref = _queried(spark, sf, "VJ_1_junction_aa", "VDJ_1_junction_aa")
    return ct.annotate_df(ct.ir_query(cells, ref, **_OPTIONS), ref, ["epitope"])


@query(on_wide(_REF + ", x as (select min(cell_ord) as i, a, b, t from q group by a, b, t), y as (select min(cast(substr(ref_id, 6) as bigint)) as j, a, b, t from r group by a, b, t) select i, j, 0 as dist from x join y on x.t = y.t and x.a is not distinct from y.a and x.b is not distinct from y.b"))
def query_pairs(spark, sf):
    return ct.ir_query(*_queried(spark, sf, "VJ_1_junction_aa", "VDJ_1_junction_aa"), **_OPTIONS)[0]


@query(on_wide(""", q as (select min(cell_ord) as i, VJ_1_junction_aa as a, VJ_2_junction_aa as b, receptor_type as t from wide where has_ir and coalesce(VJ_1_junction_aa, VJ_2_junction_aa) is not null group by 2, 3, 4),
r as (select min(cell_ord) as j, VJ_1_junction_aa as a, VJ_2_junction_aa as b, receptor_type as t from wide where status = 'P' and has_ir and coalesce(VJ_1_junction_aa, VJ_2_junction_aa) is not null group by 2, 3, 4),
x as (select i, t, unnest([a, b]) as s from q), y as (select j, t, unnest([a, b]) as s from r)
select i, j, cast(min(hamming(x.s, y.s)) as int) as dist from x join y on x.t = y.t and length(x.s) = length(y.s) where hamming(x.s, y.s) <= 1 group by 1, 2"""))
def query_pairs_any_hamming(spark, sf):
    return ct.ir_query(*_queried(spark, sf, "VJ_1_junction_aa", "VJ_2_junction_aa"), receptor_arms="VJ", dual_ir="any", metric="hamming", cutoff=1)[0]


def _annotated(name: str, strategy: str, sql: str):
    def f(spark, sf):
        cells, ref = _queried(spark, sf, "VJ_1_junction_aa", "VDJ_1_junction_aa")
        return ct.annotate_query(cells, ct.ir_query(cells, ref, **_OPTIONS), ref, "epitope", strategy)

    f.__name__ = name
    query(on_wide(_REF + ", n as (select cell_id, epitope, count(*) as n from h where epitope is not null group by 1, 2), z as (" + sql + ") select wide.cell_id, z.epitope from wide left join z using (cell_id)"))(f)


_annotated("annotate_unique", "unique-only", "select cell_id, case when count(*) = 1 then min(epitope) else 'ambiguous' end as epitope from n group by cell_id")
_annotated("annotate_frequent", "most-frequent", "select cell_id, case when count(*) filter (n = m) > 1 then 'ambiguous' else max(case when n = m then epitope end) end as epitope from (select *, max(n) over (partition by cell_id) as m from n) group by cell_id")
_annotated("annotate_json", "json", "select cell_id, '{'||string_agg('\"'||epitope||'\":'||n, ',' order by epitope)||'}' as epitope from n group by cell_id")


# ---- groups ----------------------------------------------------------------------------------------------------------


@query(on_wide("select patient, clone, count(*) * 1.0 as value from wide where clone is not null and patient is not null group by 1, 2"))
def overlap_matrix(spark, sf):
    return groups.presence(wide(spark, sf), "patient", "clone")


@query(on_wide(", p as (select distinct patient as g, clone from wide where clone is not null and patient is not null), n as (select g, count(*) as n from p group by g), i as (select x.g as a, y.g as b, count(*) as k from p x join p y on x.clone = y.clone and x.g < y.g group by 1, 2) select x.g as a, y.g as b, round(1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) as distance from n x join n y on x.g < y.g left join i on i.a = x.g and i.b = y.g"))
def overlap_jaccard(spark, sf):
    return _rounded(groups.jaccard(wide(spark, sf), "patient", "clone"), "distance")


@query()
def overlap_linkage(spark, sf):
    return groups.repertoire_overlap(wide(spark, sf), "patient", "clone")[2]


_SIDES = """, sides as (select case when status = 'F' then 'case' else 'control' end as side, patient, count(*) as n from wide
  where patient is not null and status in ('F', 'O') group by 1, 2),
pres as (select patient, clone, count(*) * 1.0::double as v from wide where patient is not null and clone is not null group by 1, 2),
tot as (select sum(n) filter (side = 'case') as case_total, sum(n) filter (side = 'control') as control_total,
  count(*) filter (side = 'case') as case_rows, count(*) filter (side = 'control') as control_rows from sides),
per as (select clone, sum(case when side = 'case' then v else 0 end) as case_n, sum(case when side = 'control' then v else 0 end) as control_n,
  sum(case when side = 'case' then v / n else 0 end) as case_sum, sum(case when side = 'control' then v / n else 0 end) as control_sum from sides join pres using (patient) group by clone),
imb as (select clone, case_n, case_sum / case_rows as case_mean, cast(case_total as bigint) as case_total, control_n, control_sum / control_rows as control_mean,
  cast(control_total as bigint) as control_total from per, tot where case_n > 0 or control_n > 0)"""


@query(on_wide(_SIDES + " select 'All' as hue, clone, case_n, round(case_mean, 6) as case_mean, case_total, control_n, round(control_mean, 6) as control_mean, control_total from imb"))
def imbalance_counts(spark, sf):
    return _rounded(groups.imbalance_counts(held(spark, sf, "patient", "status", "clone"), "patient", "status", "clone", "F", "O"), "case_mean", "control_mean")


_LN = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_TABLE = _LN.format(n="n1", k="x") + " + " + _LN.format(n="n2", k="(k - x)") + " - " + _LN.format(n="(n1 + n2)", k="k")
_FISHER = _SIDES + f""", tab as (select *, case_n + greatest(case_total - case_n, 0) as n1, control_n + greatest(control_total - control_n, 0) as n2, case_n + control_n as k, case_n as own from imb),
prob as (select *, list_transform(range(cast(greatest(0, k - n2) as bigint), cast(least(k, n1) as bigint) + 1), lambda x: {_TABLE}) as lnp, {_TABLE.replace("x", "own")} as ln_own from tab),
pv as (select *, least(1.0::double, list_sum(list_transform(list_filter(lnp, lambda y: y <= ln_own + 1e-7), lambda y: exp(y)))) as p from prob),
eps as (select case when count(*) = count(distinct patient) * count(distinct clone) then 0.01 * min(v) / count(distinct patient) else 0 end as e from pres)"""


@query(on_wide(_FISHER + """ select 'All' as hue, clone, round(p, 6) as p_value, round(-log10(p), 4) as log_p, round(case when case_mean + e > 0 and control_mean + e > 0 then log2((case_mean + e) / (control_mean + e))
  when case_mean + e > 0 then 'infinity'::double else '-infinity'::double end, 6) as log2_fc from pv, eps"""))
def clonotype_imbalance(spark, sf):
    found = groups.clonotype_imbalance(held(spark, sf, "patient", "status", "clone"), "patient", "status", "clone", "F", "O")
    return _rounded(found.withColumn("log_p", F.round("log_p", 4)), "p_value", "log2_fc")


@query(on_wide(_SIDES + """, t as (select distinct clone from imb) select t.clone, 'All' as hue, side, sides.patient as replicate, round(coalesce(v, 0) / n, 6) as abundance
from t cross join sides left join pres on pres.patient = sides.patient and pres.clone = t.clone"""))
def imbalance_abundance(spark, sf):
    return _rounded(groups.imbalance_abundance(held(spark, sf, "patient", "status", "clone"), "patient", "status", "clone", "F", "O"), "abundance")


@query(on_wide(_FISHER + """, b as (select clone from pv order by round(p, 6), clone limit 8) select 'All' as hue, side, sides.patient as replicate, b.clone, round(coalesce(v, 0) / n, 6) as abundance
from b cross join sides left join pres on pres.patient = sides.patient and pres.clone = b.clone"""))
def imbalance_top(spark, sf):
    cells = held(spark, sf, "patient", "status", "clone")
    stats = groups.clonotype_imbalance(cells, "patient", "status", "clone", "F", "O").withColumn("p_value", F.round("p_value", 6))
    return _rounded(figures.top_imbalance(stats, groups.imbalance_abundance(cells, "patient", "status", "clone", "F", "O"), "clone", 8), "abundance")


def _labelled(spark, sf) -> DataFrame:
    """node (cell_ord) and label of the cells that have a clone."""
    cells = held(spark, sf, "cell_ord", "VJ_1_v_call", "clone").where("clone is not null")
    return cells.select(F.col("cell_ord").alias("node"), F.col("VJ_1_v_call").alias("label"))


def nearby(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(labels, edges) of cells whose cell_ord differ by at most 5."""
    cells = _labelled(spark, sf)
    edges = cells.select(F.col("node").alias("src"), F.explode(F.sequence(F.col("node") + 1, F.col("node") + 5)).alias("dst")).join(cells.select(F.col("node").alias("dst")), "dst", "left_semi")
    return cells, edges.select("src", "dst")


def ring(cells: DataFrame, k: int = 5) -> DataFrame:
    """src, dst: each node's next ``k`` by rank, whatever numbers are missing between them; the last ones go on with the first."""
    ranked = written(numbered(cells.select("node"), "node", "no"), "ranks")
    n = ranked.count()
    ahead = ranked.select(F.col("node").alias("src"), F.explode(F.sequence(F.col("no") + 1, F.col("no") + k)).alias("no"))
    ahead = ahead.select("src", F.pmod("no", F.lit(max(n, 1))).alias("no"))
    return ahead.join(ranked.select("no", F.col("node").alias("dst")), "no").where("src <> dst").select("src", "dst")


def neighbours(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(labels, edges) of a ring of cells: each one's next five by rank of cell_ord."""
    cells = _labelled(spark, sf)
    return cells, ring(cells)


@query(on_wide(", c as (select cell_ord as node, VJ_1_v_call as label from wide where clone is not null), e as (select x.label from c x join c y on y.node between x.node + 1 and x.node + 5 where x.label = y.label), s as (select label, count(*) as size from c where label is not null group by label) select s.label, size, (select count(*) from e where e.label = s.label) as n_edges from s"))
def modularity_observed_edges(spark, sf):
    return groups.observed_edges(*nearby(spark, sf))


@query()
def modularity_score(spark, sf):
    return groups.clonotype_modularity(*neighbours(spark, sf))


@query()
def modularity_table(spark, sf):
    return figures.modularity_table(groups.clonotype_modularity(*neighbours(spark, sf)))


# ---- mutations -------------------------------------------------------------------------------------------------------

_PLACES = {"v": "i <= 312", "fwr1": "i <= 78", "cdr1": "i > 78 and i <= 114", "fwr2": "i > 114 and i <= 165", "cdr2": "i > 165 and i <= 195", "fwr3": "i > 195 and i <= 312",
           "cdr3": "i > 312 and i <= 312 + j - 6", "fwr4": "i > 312 + j - 6", "full": "true"}


def _mutations(r: str):
    def f(spark, sf):
        rows = receptors.chains(spark, sf).select("sequence_alignment", "germline_alignment_d_mask", "junction").distinct()
        return _rounded(mutation.mutational_load(rows, (r,)), f"{r}_mutation_freq").select(
            "sequence_alignment", "junction", F.col(f"{r}_mutation_count").alias("mutation_count"), F.col(f"{r}_mutation_freq").alias("mutation_freq"))

    f.__name__ = f"mutation_load_{r}"
    need = " and junction is not null" if r in ("cdr3", "fwr4") else ""
    query(on_chains(f""", a as (select distinct sequence_alignment as s, germline_alignment_d_mask as g, junction from chains),
u as (select s, g, unnest(range(1, length(s) + 1)) as i from (select distinct s, g from a)), v as (select s, i, substr(s, cast(i as int), 1) as x, substr(g, cast(i as int), 1) as y from u),
d as (select s, i, cast(x <> y and x not in ('.', 'N') and y not in ('.', 'N') as int) as m, cast(x not in ('.', 'N') and y not in ('.', 'N') as int) as k from v),
b as (select distinct s, junction, length(junction) as j from a where true{need}), z as (select b.s, b.junction, sum(m) as m, sum(k) as k, count(*) as n from b join d on d.s = b.s and {_PLACES[r]} group by 1, 2)
select a.s as sequence_alignment, a.junction, cast(case when k > 0 then m end as int) as mutation_count, round(case when k > 0 then m end / n, 6) as mutation_freq from a left join z on z.s = a.s and z.junction is not distinct from a.junction"""))(f)


for _r in _PLACES:
    _mutations(_r)


# ---- tables ----------------------------------------------------------------------------------------------------------


_ONE = "concat_ws('|', locus, coalesce(junction_aa, '-'), coalesce(junction, '-'), v_call, coalesce(d_call, '-'), j_call, cast(umi_count as {S}), cast(consensus_count as {S}), cast(productive as {S}))"


@query(f"""with {_CHAINS}, {_CELLS}, o as (select distinct cell_id, {_ONE.replace('{S}', 'varchar')} as x from chains),
h as (select cell_id, count(*) as n, sha256(string_agg(x, ',' order by x)) as chains_sha256 from o group by cell_id)
select cells.cell_id, coalesce(n, 0) as n, coalesce(chains_sha256, sha256('')) as chains_sha256 from cells left join h using (cell_id)""")
def merge_airr(spark, sf):
    rows = receptors.chains(spark, sf).drop("sequence_alignment", "germline_alignment_d_mask")
    cells = receptors.cells(spark, sf)
    a = receptors.nested(cells, rows.where("umi_count > 20"))
    merged = indexing.merge_airr(a, receptors.nested(cells.select("cell_id", "sample"), rows))
    own = receptors.flat(merged).select("cell_id", F.expr(_ONE.replace("{S}", "string")).alias("x")).groupBy("cell_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = F.coalesce(F.array_join("x", ","), F.lit(""))
    return merged.select("cell_id", F.size("airr").cast("long").alias("n")).join(own, "cell_id", "left").select("cell_id", "n", F.sha2(text, 256).alias("chains_sha256"))


@query(on_chains("select cell_id, chain_idx, locus, junction_aa, umi_count from chains"))
def nested_and_flat(spark, sf):
    return receptors.flat(receptors.receptor_cells(spark, sf)).select("cell_id", "chain_idx", "locus", "junction_aa", "umi_count")


@query(on_wide("select cell_id, arm, cast(slot as int) as slot, locus, junction_aa from (" + " union all ".join(
    f"select cell_id, '{a}' as arm, {n} as slot, {a}_{n}_locus as locus, {a}_{n}_junction_aa as junction_aa from wide where {a}_{n}_junction_aa is not null" for a in ("VJ", "VDJ") for n in (1, 2)) + ")"))
def legacy_unpivot(spark, sf):
    flat = wide(spark, sf).select("cell_id", *[F.col(f"{a}_{n}_{v}").alias(f"IR_{a}_{n}_{v}") for a in ("VJ", "VDJ") for n in (1, 2) for v in ("locus", "junction_aa")])
    return legacy.upgrade_schema(flat).select("cell_id", "arm", "slot", "locus", "junction_aa")


@query(on_chains("select cell_id, locus, productive, cast(umi_count as bigint) as umi_count, junction_aa, v_call from chains"))
def write_read_airr(spark, sf):
    path = scratch_path(spark, "airr")
    tables.write_airr(receptors.chains(spark, sf), path, "gzip")
    return tables.read_airr(spark, path, infer=False).select("cell_id", "locus", "productive", F.col("umi_count").cast("long").alias("umi_count"), "junction_aa", "v_call")


@query(on_chains("""select cell_id, cell_id||'_'||chain_idx as sequence_id, locus, v_call, d_call, j_call, junction_aa, productive, cast(umi_count as bigint) as umi_count, consensus_count
  from chains where locus <> 'TRD' and umi_count > 5"""))
def read_10x_csv(spark, sf):
    said = lambda c: F.when(c, "True").otherwise("False")
    rows = receptors.chains(spark, sf).select(
        F.col("cell_id").alias("barcode"), said(F.col("locus") != "TRD").alias("is_cell"), F.concat("cell_id", F.lit("_"), F.col("chain_idx").cast("string")).alias("contig_id"),
        said(F.col("umi_count") > 5).alias("high_confidence"), F.col("locus").alias("chain"), F.col("v_call").alias("v_gene"), F.coalesce("d_call", F.lit("None")).alias("d_gene"),
        F.col("j_call").alias("j_gene"), F.lit("None").alias("c_gene"), said(F.col("productive")).alias("productive"), F.coalesce("junction_aa", F.lit("None")).alias("cdr3"),
        F.coalesce("junction", F.lit("None")).alias("cdr3_nt"), F.col("consensus_count").alias("reads"), F.col("umi_count").alias("umis"))
    path = scratch_path(spark, "tenx.csv")
    rows.write.csv(path, header=True)
    return tables.read_10x_csv(spark, path).select(
        "cell_id", "sequence_id", "locus", "v_call", "d_call", "j_call", "junction_aa", "productive", "umi_count", "consensus_count")


@query(on_chains("select cell_id, locus, v_call, d_call, j_call, junction_aa, productive, cast(umi_count as bigint) as umi_count from chains"))
def read_bd_rhapsody(spark, sf):
    kind = F.create_map(*[F.lit(x) for k, v in tables.BD_LOCI.items() for x in (v, k)])[F.col("locus")]
    rows = receptors.chains(spark, sf).select(
        F.col("cell_id").alias("Cell_Index"), kind.alias("Chain_Type"), F.col("v_call").alias("V_gene_Dominant"), F.col("d_call").alias("D_gene_Dominant"),
        F.col("j_call").alias("J_gene_Dominant"), F.lit(None).cast("string").alias("C_gene_Dominant"), F.col("junction").alias("CDR3_Nucleotide_Dominant"),
        F.col("junction_aa").alias("CDR3_Translation_Dominant"), F.when(F.col("productive"), "True").otherwise("False").alias("Productive"),
        F.col("consensus_count").alias("Read_Count"), F.col("umi_count").alias("Molecule_Count"))
    path = scratch_path(spark, "bd")
    rows.write.csv(path, header=True)
    return tables.read_bd_rhapsody(spark, path).select("cell_id", "locus", "v_call", "d_call", "j_call", "junction_aa", "productive", "umi_count")


@query(on_chains("select cell_id, chain_idx, junction_aa, 'own' as db from chains where locus = 'TRA'"))
def load_reference(spark, sf):
    path = scratch_path(spark, "reference")
    receptors.chains(spark, sf).withColumn("source", F.col("locus")).write.parquet(path)
    return tables.load_reference(spark, path, "own", "TRA").select("cell_id", "chain_idx", "junction_aa", "db")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict:
    return dict(_SQL)
