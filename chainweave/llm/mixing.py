"""Mixing sources to target weights, with DataFrame operations only.

A document's size is its number of words. Sources (by code point, null last)
weigh 1, 2, 3 in turn and share all sizes by weight; a target stops at
``repeat`` times its source's size and the excess is shared again by weight.

Each source's documents form one stream of words (chunks by a hash of text and
doc_id, then doc_id, then that hash), packed into blocks of ``block`` words; a
document lies in the blocks its words fall into. The mix has slots of one block
each, in output shards of ``shard`` slots. Every slot draws its source from the
target shares by a hash of its number, which gives each shard multinomial source
counts; a source's counts are then cut at its quota (its target in blocks,
``repeat`` rounds at most) and what is missing at the end goes to closing shards,
so totals are exact to a block. In round r a source's slot k takes block
perm(k), perm being a pseudorandom permutation of the source's n blocks of its
own for each source and round (a swap-or-not shuffle: a bijection for every n),
so within a round no block comes twice and none more than ``repeat`` times in
all. Joining slots to blocks by index gives each document its words taken.

Determinism: only hashes of row values and slot numbers decide; reruns agree.
Cases: null text or no words: size 0, takes nothing; null source is a source of
its own; repeated rows are separate documents; empty tables give no rows; other
columns are passed through by ``mixed_documents`` and ignored by ``mix``.
Skew: prefix sums run over (source, chunk), never a whole source; equal rows are
counted before they meet, so neither a common id nor a common row is a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.plans.lineage import written
from chainweave.plans.numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
BLOCK, SHARD, CHUNK, REPEAT = 64, 4096, 2048, 3
SWAPS = 48  # rounds of the shuffle


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> also source_no, weight and target, one row per source.

    Uncapped sources share what capped ones leave, in proportion to weight: a
    source is capped when its cap per weight is below the common level, which
    rises with each source that is capped, until no more are.
    """
    place = F.col("source_no") % len(WEIGHTS)
    w = numbered(sizes, F.col("source").asc_nulls_last(), "source_no").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double"))
    w = written(w.withColumn("cap", F.col("source_size") * float(REPEAT)), "mix-weights")
    level, seen = 0.0, None
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        n, total, capped, free = w.agg(F.count_if(over), F.sum("source_size").cast("double"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
                                       F.sum(F.when(~over, F.col("weight")).otherwise(0.0))).first()
        if n == seen or not free:
            break
        seen, level = n, (total - capped) / free
    return w.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without texts, with size and start in their source's stream; the sources with targets and blocks)."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text", "doc_id").alias("tie"))
    rows = written(rows, "mix-sizes")
    chunks = max(1, -(-rows.count() // CHUNK))
    rows = rows.groupBy("source", "doc_id", "tie", "size").agg(F.count(F.lit(1)).alias("copies")).withColumns({
        "chunk": F.pmod("tie", F.lit(chunks).cast("long")), "words": F.col("size") * F.col("copies")})
    rows = written(rows, "mix-rows")
    sums = written(rows.groupBy("source", "chunk").agg(F.sum("words").alias("chunk_size")), "mix-chunks")
    w = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("chunk_size").over(w), F.lit(0).cast("long"))).drop("chunk_size")
    sources = targets(sums.groupBy("source").agg(F.sum("chunk_size").alias("source_size")))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn(
        "quota", F.when(F.col("blocks") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), REPEAT * F.col("blocks"))).otherwise(0))
    sources = written(sources, "mix-sources")
    bases = bases.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = Window.partitionBy("source", "chunk").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("words").over(own), F.lit(0).cast("long")))
    bases = bases.withColumnRenamed("source", "s").withColumnRenamed("chunk", "c")
    rows = rows.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).drop("s", "c")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("begin", F.col("base") + F.col("within") + F.col("copy") * F.col("size"))
    return rows.drop("base", "within", "chunk", "words", "copies", "copy"), sources


def drawn_slots(sources: DataFrame) -> DataFrame:
    """source_no, blocks, first, last: per shard and source the range of the source's slots (last excluded); ``sources`` is a written table."""
    spark = sources.sparkSession
    live = sources.where("quota > 0")
    slots, n_sources = (int(x) for x in live.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first())
    # each slot draws a point below the number of slots; the source whose span holds it is drawn.
    # Spans and points meet by pages of points, of which there are twice as many as sources.
    page = max(1, -(-slots // (2 * n_sources))) if n_sources else 1
    upto = Window.partitionBy("part").orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = live.withColumn("part", F.floor(F.col("source_no") / SHARD))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for SHARD sources
    bases = parted.groupBy("part").agg(F.sum("quota").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    spans = parted.withColumn("end", F.sum("quota").over(upto)).join(bases, "part").select(
        "source_no", (F.col("base") + F.col("end") - F.col("quota")).alias("lo"), (F.col("base") + F.col("end")).alias("hi"))
    spans = spans.withColumn("page", F.explode(F.sequence(F.floor(F.col("lo") / page), F.floor((F.col("hi") - 1) / page))))
    draws = spark.range(slots).withColumn("point", F.pmod(F.xxhash64(F.lit("slot"), "id"), F.lit(max(1, slots)).cast("long")))
    draws = draws.withColumn("page", F.floor(F.col("point") / page)).join(spans, "page").where("point >= lo and point < hi")
    counts = written(draws.groupBy(F.floor(F.col("id") / SHARD).alias("shard"), "source_no").agg(F.count("*").alias("n")), "mix-draws")
    shard = Window.partitionBy("source_no").orderBy("shard")
    run = counts.withColumn("upto", F.sum("n").over(shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.join(live.select("source_no", "blocks", "quota"), "source_no")
    cut = run.select("source_no", "blocks", F.least(F.col("upto") - F.col("n"), "quota").alias("first"), F.least("upto", "quota").alias("last"))
    have = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    closing = live.join(have, "source_no", "left").where("coalesce(got, 0) < quota").select(
        "source_no", "blocks", F.coalesce("got", F.lit(0)).cast("long").alias("lo_slot"), F.col("quota").alias("hi_slot"))
    closing = closing.select("source_no", "blocks", "hi_slot", F.explode(
        F.expr(f"sequence(lo_slot, hi_slot - 1, {SHARD}L)")).alias("first")).select(
        "source_no", "blocks", "first", F.least(F.col("first") + SHARD, "hi_slot").alias("last"))
    return cut.where("first < last").unionByName(closing)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Place of ``index`` in a pseudorandom permutation of 0 .. n - 1 that ``key`` names.

    Swap-or-not: each round pairs x with k - x (mod n), k from the key and round,
    and a hash of the larger of the two tells whether the pair swaps.
    """

    def swap(x, i):
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), i, *key), n) - x, n)
        return F.when(F.xxhash64(i, *key, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), index, swap)


def block_uses(sources: DataFrame) -> DataFrame:
    """source_no, block, uses: how many slots of the mix take each block."""
    width = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a few rows stand for SHARD slots each: dealt out before they are unfolded
    slots = drawn_slots(sources).repartition(width, "source_no", "first").select("source_no", "blocks", F.explode(F.expr("sequence(first, last - 1)")).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("source_no"), turn)
    return slots.groupBy("source_no", block.alias("block")).agg(F.count("*").alias("uses"))


def _mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without their texts, their pieces with uses); source_no and begin name a document that has words."""
    rows, sources = placed(docs)
    rows = written(rows, "mix-places")
    pieces = rows.where("size > 0").select(
        "source_no", "begin", "size", F.explode(F.expr(f"sequence(begin div {BLOCK}, (begin + size - 1) div {BLOCK})")).alias("block"))
    pieces = pieces.join(block_uses(sources), ["source_no", "block"]).select(
        "source_no", "begin", "uses", F.greatest(F.col("block") * BLOCK - F.col("begin"), F.lit(0)).alias("from"),
        (F.least((F.col("block") + 1) * BLOCK, F.col("begin") + F.col("size")) - F.col("begin")).alias("to"))
    return rows, pieces


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    rows, pieces = _mixed(docs)
    took = pieces.groupBy("source_no", "begin").agg(F.sum((F.col("to") - F.col("from")) * F.col("uses")).alias("got"))
    rows = rows.select("doc_id", "size", "source_size", "target", "source_no", "begin").join(took, ["source_no", "begin"], "left")
    return rows.select("doc_id", "size", "source_size", "target",
                       F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one row per document and round in which its blocks are taken.

    A row's text is the document's words in the blocks of that round; where all
    its words are taken it is the document itself, unchanged.
    """
    rows, pieces = _mixed(docs)
    turns = pieces.select("source_no", "begin", "from", "to", F.explode(F.expr("sequence(1, cast(uses as int))")).alias("round"))
    turns = turns.groupBy("source_no", "begin", "round").agg(
        F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"), F.sum(F.col("to") - F.col("from")).alias("got"))
    key = F.coalesce("doc_id", F.lit(-1)).alias("key")
    took = rows.where("size > 0").select(key, "tie", "size", "source_no", "begin").join(turns, ["source_no", "begin"])
    took = took.groupBy("key", "tie", "begin").agg(F.collect_list(F.struct("spans", "got", "size")).alias("rounds"))
    took = took.groupBy("key", "tie").agg(F.array_sort(F.collect_list(F.struct("begin", "rounds"))).alias("of_equal"))
    # one shuffle of the texts, by key and tie; equal rows take their shares in turn. A row travels whole, so no column can clash
    nth = F.row_number().over(Window.partitionBy("key", "tie").orderBy("tie"))
    out = docs.select(F.struct(*docs.columns).alias("row"), key, F.xxhash64("text", "doc_id").alias("tie")).withColumn("nth", nth).join(took, ["key", "tie"])
    out = out.select("row", F.explode(F.get("of_equal", F.col("nth") - 1)["rounds"]).alias("round")).select("row", F.col("row.text").alias("text"), "round.*")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(
        words, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
    out = out.select("row", F.when(F.col("got") == F.col("size"), F.col("text")).otherwise(some).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
