"""Personal data: base patterns, and spans that boosted trees add; DataFrame operations only.

Base spans (kinds email, ip, card, phone) are the leftmost non-overlapping
matches of fixed patterns that pass their checks. Wide generators then propose
further, possibly overlapping spans (also of kind ``secret``); Spark's gradient
boosted trees score them by format and context features; a threshold per kind,
calibrated on held-out candidates to ``PRECISION``, selects what is added. A
candidate that overlaps a base span of its kind adds nothing.

The trees learn from weak labels that their features don't hold (``weak_label``,
``features``): for card, ip and phone numbers the label is the check (Luhn sum,
octets, a leading + and its digits), features are grouping, length and context;
for email the label is the strict form, features are context and length; for
secrets the label is the context (a credential's name and = or : stand before),
features are the string's own form, so strings of that form are found where no
name stands. They are fitted on the candidates of at most about ``MAX_DOCS``
documents chosen by a hash, thresholds on those of all; scores are computed as
column expressions over the trees, so a document's spans are found in one
projection without a shuffle.

Positions are code points, ends exclusive. Patterns use possessive repeats, so
matching takes linear time and no recursion on long texts; they match exactly
what the plain forms match.

Cases: null text is empty, without spans; null doc_ids are kept; repeated rows
have equal results; without candidates of both classes nothing is added; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.plans.lineage import written

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = (*KINDS, "secret")
#: what the plain patterns match, written so that Java matches them in linear time
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generators: name, kind, pattern, a cheap test of the text
GENERATORS = (
    ("mail", "email", r"[A-Za-z0-9._%+-]{1,64}+\s?+(?:@|\(at\)|\[at\])\s?+[A-Za-z0-9-]{1,63}+(?:\s?+(?:\.|\(dot\)|\[dot\])\s?+[A-Za-z0-9-]{2,63}+){1,8}+", r"@|\(at\)|\[at\]"),
    ("dotted", "ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3,7}+", r"[0-9]\.[0-9]"),
    ("digits", "card", r"[0-9](?:[\x20.-]?+[0-9]){11,}+", r"[0-9]"),
    ("dial", "phone", r"\+?+(?:[0-9]{1,3}+[\x20.-])?+\(?+[0-9]{2,4}+\)?+[\x20.-][0-9]{2,4}+[\x20.-]?+[0-9]{2,4}+(?:[\x20.-][0-9]{2,4}+){0,2}+", r"[0-9][\x20).-]"),
    ("run", "secret", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{8,}+", r"[0-9]"),
)
MAX_DOCS, TREES, DEPTH, BINS = 50_000, 12, 4, 50
#: share of label 1 that a threshold asks for; what no name stands before is not known to be no secret, so that share is a lower bound there
PRECISION = {"email": 0.95, "ip": 0.95, "card": 0.95, "phone": 0.95, "secret": 0.5}
CONTEXT = 24
HINTS = r"(?i)(mail|contact|tel|phone|call|fax|card|visa|account|addr|host|server|ip)"
NAMED = r"(?i)(?:token|secret|password|passwd|api[_-]?key|credential)\s{0,3}[:=]\s{0,3}[\"']?$"


def _spans(text: Column, pattern: str, test: str | None) -> Column:
    """array<struct<s, e, m, before, after>> of a pattern's matches; s, e: code points."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the text is gap, match, gap, match, ..., gap
    parts = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
                       F.slice(gaps, 2, 2**31 - 1), lambda a, b: F.struct(
                           F.length(a["g"]).alias("gap"), F.coalesce(F.right(a["g"], F.lit(CONTEXT)), F.lit("")).alias("before"), a["m"].alias("m"),
                           F.coalesce(F.left(b, F.lit(1)), F.lit("")).alias("after")))
    kind = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
    out = F.aggregate(F.filter(parts, lambda p: p["m"].isNotNull()),
                      F.struct(F.lit(0).alias("at"), F.lit(None).cast(kind).alias("out")),
                      lambda acc, p: F.struct(
                          (acc["at"] + p["gap"] + F.length(p["m"])).alias("at"),
                          F.concat(F.coalesce(acc["out"], F.array().cast(kind)), F.array(F.struct(
                              (acc["at"] + p["gap"]).alias("s"), (acc["at"] + p["gap"] + F.length(p["m"])).alias("e"),
                              p["m"].alias("m"), p["before"].alias("before"), p["after"].alias("after")))).alias("out")),
                      lambda acc: acc["out"])
    has = F.rlike(text, F.lit(test or pattern))
    return F.when(has, F.coalesce(out, F.array().cast(kind))).otherwise(F.array().cast(kind))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of 10."""
    d = F.reverse(digits_of(m))
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 1, F.ascii(F.substr(d, i, F.lit(1))) - 48).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.ascii(F.substr(d, i, F.lit(1))) - 47)))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.rlike(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    test = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9\\x20-]", "phone": r"\+[0-9]"}[kind]
    return F.filter(_spans(text, BASE[kind], test), lambda x: passes(kind, x["m"]))


def features(x: Column, kind: str) -> list[Column]:
    """Numbers of a candidate; 0 where the label of its kind would show."""
    m, before, after = x["m"], x["before"], x["after"]
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    unless = lambda c, *kinds: F.lit(0.0) if kind in kinds else c
    n = F.length(m).cast("double")
    return [
        n, unless(F.length(digits_of(m)).cast("double"), "phone", "email"), unless(count("[A-Za-z]"), "email"), unless(count(r"[\x20.-]"), "email", "ip"),
        unless(count(r"[()\[\]]"), "email"), unless(count("[a-f]"), "email"), unless(F.size(F.array_distinct(F.split(m, ""))).cast("double") / F.greatest(n, F.lit(1.0)), "card"),
        unless(F.rlike(before, F.lit(r"[0-9A-Za-z]$")).cast("double"), "secret"), unless(F.rlike(after, F.lit("[0-9A-Za-z]")).cast("double"), "secret"),
        unless(F.rlike(before, F.lit(HINTS)).cast("double"), "secret"), F.lit(float(MORE_KINDS.index(kind))),
    ]


N_FEATURES = 11


def weak_label(kind: str, x: Column) -> Column:
    """What a check, or for secrets the context, says of a candidate; what it looks at is not among the kind's features."""
    if kind == "email":
        return F.rlike(x["m"], F.lit(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))
    if kind == "phone":
        return F.startswith(x["m"], F.lit("+")) & passes("phone", x["m"])
    if kind == "secret":
        return F.rlike(x["before"], F.lit(NAMED))
    return passes(kind, x["m"])


@dataclass
class Selector:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, their weights, and thresholds per kind."""

    trees: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)

    def margin(self, f: list[Column]) -> Column:
        def expr(t):
            return F.lit(t) if isinstance(t, float) else F.when(f[t[0]] <= t[1], expr(t[2])).otherwise(expr(t[3]))

        total = F.lit(0.0)
        for t, w in zip(self.trees, self.weights):
            total = total + expr(t) * w
        return total


def _labelled(rows: DataFrame, folds: Column) -> DataFrame:
    """kind, f (features), label of all candidates in ``rows`` whose fold is among ``folds``."""
    parts = None
    for _, kind, pattern, test in GENERATORS:
        x = F.col("x")
        one = rows.select(F.explode(_spans(F.col("text"), pattern, test)).alias("x")).withColumn(
            "fold", F.pmod(F.xxhash64(x["m"]), F.lit(3))).where(folds).select(
            F.lit(kind).alias("kind"), F.array(*features(x, kind)).alias("f"), weak_label(kind, x).cast("double").alias("label"))
        parts = one if parts is None else parts.union(one)
    return parts


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Selector:
    """Fit the trees on docs(doc_id, text), or a sample of about ``max_docs``, and calibrate thresholds on all of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    n = docs.select("doc_id").count()
    rows = docs.where("text is not null")
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30))) if n > max_docs else rows
    learn = written(_labelled(sample, F.col("fold") < 2), "pii-candidates")
    classes = [r.label for r in learn.select("label").distinct().collect()]
    if len(classes) < 2:
        return Selector()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="v", minInstancesPerNode=5).fit(
        learn.select(array_to_vector("f").alias("v"), "label").coalesce(4))

    def read(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return int(node.split().featureIndex()), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild())

    found = Selector([read(t._call_java("rootNode")) for t in model.trees], [float(w) for w in model.treeWeights])
    margin = found.margin([F.get("f", i) for i in range(N_FEATURES)])
    bins = _labelled(rows, F.col("fold") == 2).select("kind", "label", F.floor(F.least(F.greatest((margin + 2) * (BINS / 4), F.lit(0.0)), F.lit(BINS - 1.0))).alias("bin"))
    table = bins.groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # kinds x BINS rows at most
    for kind in MORE_KINDS:
        good = n = 0
        for r in sorted((r for r in table if r.kind == kind), key=lambda r: -r.bin):
            good, n = good + r.good, n + r.n
            if good >= PRECISION[kind] * n:
                found.thresholds[kind] = r.bin * 4 / BINS - 2
    return found


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """doc_id, n_<kind> and base (base spans), spans (base and added): strings kind:start:end, by kind, then start; n_spans: their number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    rows = rows.withColumn("secret", F.array().cast(rows.schema["email"].dataType))
    added = {k: [] for k in MORE_KINDS}
    for _, kind, pattern, test in GENERATORS:
        if kind in selector.thresholds:
            score = lambda x, kind=kind: selector.margin(features(x, kind))
            own = F.col(kind)
            more = F.filter(_spans(F.col("text"), pattern, test), lambda x: ~F.exists(
                own, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) & (score(x) >= selector.thresholds[kind]))
            added[kind].append(F.transform(more, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    plain = lambda k: F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    label = lambda k, spans: F.transform(spans, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.array_join(F.concat(*(label(k, plain(k)) for k in KINDS)), ",")
    everything = F.concat(*(label(k, F.array_sort(F.array_distinct(F.concat(plain(k), *added[k])))) for k in MORE_KINDS))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), F.array_join(everything, ",").alias("spans"),
                       F.size(everything).cast("long").alias("n_spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span of ``spans`` (as in ``find``) replaced by [KIND]; overlapping spans are joined under the first one's kind."""
    kind = "array<struct<s:int,e:int,k:string>>"
    parsed = F.array_sort(F.transform(F.filter(F.split(spans, ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"), F.split(x, ":")[0].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(parsed.cast(kind), start, lambda acc, x: F.when(x["s"] < acc["at"], F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            x["e"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["k"]), F.lit("]")).alias("out"))))
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
