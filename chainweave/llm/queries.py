"""The registered queries of the numbered operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweave.llm import chat, decontaminate, fim, language, mixing, personal, pieces, repeats, runs, simhash, token_files, topk, url_rules
from chainweave.plans.lineage import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.topk(vectors, vectors.where("vec_id % 100 = 0"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_windows(chat.format_windows(turns, tokenizer_file()))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal.find(docs, personal.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_file())
    return token_files.read_token_files(spark, out)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def language_model(docs: DataFrame) -> language.Model:
    """Learned from the labelled documents that are not held out."""
    return language.fit(docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document (by a hash of its id) repeats some of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", tail)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents")))
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"]))
                           .otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    found = found.withColumn("best", F.get(longest, F.lit(0)))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# ---- what SQL can express of a query whose other columns it can't -----------------------------------------------------


def text_turn_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_chat_windows(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def text_hand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def text_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def text_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_personal(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


_TOPK = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""

_TURNS = """with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256 from t group by conv_id"""

_HAND = """with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)
select page_id, host, path, case """ + " ".join(
    f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{h}{p}'" for _, h, p in sorted(url_rules.RULES, key=lambda r: -len(r[1] + r[2]))) + " end as rule from p"

_TARGETS = """with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source),
o as (select *, 3.0::double * source_size / weight as ratio from s),
l as (select *, (cast(sum(source_size) over () as double) - coalesce(sum(3.0::double * source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / cast(sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as double) as level from o),
c as (select max(level) filter (ratio >= level) as level from l)
select d.doc_id, d.size, s.source_size, least(3.0::double * s.source_size, s.weight * coalesce(c.level, 'infinity'::double)) as target
from d join s on d.source is not distinct from s.source, c"""

#: pattern and test of each kind (fixed values of the contract)
_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda o: length(ltrim(o, '0')) > 3 or cast('0'||right(ltrim(o, '0'), 3) as int) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(x.d) between 13 and 19 and list_sum(list_transform(range(1, length(x.d) + 1), lambda i: case when i % 2 = 1 then cast(substr(x.d, i, 1) as int) "
             "else (2 * cast(substr(x.d, i, 1) as int)) // 10 + (2 * cast(substr(x.d, i, 1) as int)) % 10 end)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(x.d) between 9 and 15"),
}


def _base_sql() -> str:
    lists = ", ".join(f"regexp_extract_all(t, '{p}') as {k}_m, string_split_regex(t, '{p}') as {k}_g" for k, (p, _) in _BASE.items())
    placed = ", ".join(f"""list_filter(list_transform(range(1, len({k}_m) + 1), lambda k: {{'m': {k}_m[k], 'd': reverse(regexp_replace({k}_m[k], '[^0-9]', '', 'g')),
      's': coalesce(list_sum(list_transform({k}_g[1:k], lambda y: length(y))), 0) + coalesce(list_sum(list_transform({k}_m[1:k-1], lambda y: length(y))), 0)}}), lambda x: {test}) as {k}"""
                       for k, (_, test) in _BASE.items())
    labels = " || ".join(f"list_transform({k}, lambda x: '{k}:'||cast(x.s as bigint)||':'||cast(x.s + length(x.m) as bigint))" for k in _BASE)
    counts = ", ".join(f"cast(len({k}) as bigint) as n_{k}" for k in _BASE)
    return f"""with t as (select doc_id, coalesce(text, '') as t from documents), m as (select doc_id, {lists} from t), f as (select doc_id, {placed} from m)
select doc_id, {counts}, sha256(array_to_string({labels}, ',')) as base_sha256 from f"""


_DRAW = "cast('0x' || substr(d, {at}, 8) as bigint)"

_FIM = rf"""with t as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
h as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, {", ".join(f"{_DRAW.format(at=8 * k + 1)} as h{k + 1}" for k in range(4))} from t),
f as (select *, len(u) as n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
  least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from h),
p as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from f)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p"""


_CRC_TABLE = "range(256)"
for _ in range(8):  # bit by bit, as DuckDB has no CRC-32
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"

_RUNS = rf"""with tab as (select {_CRC_TABLE} as t),
d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w0,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) as h from documents, tab),
a as (select *, len(w0) as n, case when h % 10 = 0 and len(w0) > 0 then (h // 10) % len(w0) end as a from d),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a),
w as (select doc_id, case when a is null then w0 else list_transform(range(n), lambda i: w0[1 + case when i < a then i else a + (i - a) % p end]) end as w, n from p),
x as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from w),
e as (select x.doc_id, y.i - x.i as p, x.i from x join x y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
g as (select *, i - row_number() over (partition by doc_id, p order by i) as island from e),
s as (select doc_id, p, min(i) as start, count(*) + p as length from g group by doc_id, p, island having count(*) + p >= greatest(12, 2 * p)),
r as (select doc_id, start, length, min(p) as period from s group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
kept as (select x.doc_id, string_agg(x.word, ' ' order by x.i) as t from x left join gone on gone.doc_id = x.doc_id and gone.i = x.i where gone.i is null group by x.doc_id),
l as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
  first({{'s': start, 'l': length, 'p': period}} order by length desc, start, period) as best from r group by doc_id)
select w.doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(best.s as bigint) as start, cast(best.l as bigint) as length, cast(best.p as bigint) as period,
  cast(1000 * best.l // best.p as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from w left join l on w.doc_id = l.doc_id left join kept on w.doc_id = kept.doc_id"""


def queries() -> dict:
    return {
        "op1_topk": op1_topk,
        "op2_decontaminate": op2_decontaminate,
        "op3_simhash": op3_simhash,
        "op4_repeats": op4_repeats,
        "op5_chat_windows": op5_chat_windows,
        "op6_url_rules": op6_url_rules,
        "op7_mix_sources": op7_mix_sources,
        "op8_personal": op8_personal,
        "op9_token_files": op9_token_files,
        "op10_language": op10_language,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_periodic_runs": op13_periodic_runs,
        "text_turn_digests": text_turn_digests,
        "text_hand_rules": text_hand_rules,
        "text_mix_targets": text_mix_targets,
        "text_base_spans": text_base_spans,
    }


def oracle_sql() -> dict:
    return {
        "op1_topk": _TOPK,
        "op11_fill_in_middle": _FIM,
        "op13_periodic_runs": _RUNS,
        "text_turn_digests": _TURNS,
        "text_hand_rules": _HAND,
        "text_mix_targets": _TARGETS,
        "text_base_spans": _base_sql(),
    }
