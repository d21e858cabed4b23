"""Fill-in-middle transformation through an index of the distinct texts.

A text's cuts stand at the ends of its units (white space with the word behind
it, or white space at the end). The index holds each distinct text once, with
the code point offsets of these ends as an Elias-Fano list; documents are
joined back to it and each selects the two cuts its own seed names.

* Texts are grouped by SHA-256 and the text itself, so different texts are
  never taken for one; a document takes an entry only where length and a second
  hash agree as well. Each distinct text crosses the network once.
* A text with more than a quarter of a partition's share of all rows (at most
  four times as many texts as partitions, so their list may be broadcast) is
  indexed once per part of its copies, and its copies are dealt over the parts.

Cases: a null text is empty; empty texts and texts that hold a marker stay as
they are (``plain``); a null doc_id counts as no digits in the seed; rows that
repeat give equal rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BATCH_BYTES = 4 << 20  # of output handed on at a time
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Code point offsets of the ends of a text's units; ``raw``: its UTF-8 bytes."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(~space & np.r_[space[1:], True])
    if space[-1]:
        ends = np.r_[ends, len(raw) - 1]
    return np.cumsum((raw & 0xC0) != 0x80)[ends]


class EliasFano:
    """An ascending list of n numbers: ``width`` low bits of each side by side, the high parts in unary."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // self.n).bit_length() - 1) if self.n else 0
        low = (values[:, None] >> np.arange(self.width)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        high = np.zeros((top >> self.width) + self.n, dtype=np.uint8)
        high[(values >> self.width) + np.arange(self.n)] = 1
        self.high = np.packbits(high, bitorder="little")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64)]

    def select(self, i: int) -> int:
        """The i-th number (from 0)."""
        byte = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.high[byte:byte + 1], bitorder="little"))
        high = 8 * byte + int(bits[i - int(self.before[byte])]) - i
        a = i * self.width
        span = np.unpackbits(self.low[a // 8:(a + self.width + 7) // 8], bitorder="little")[a % 8:a % 8 + self.width]
        return (high << self.width) | int(span @ (1 << np.arange(self.width))) if self.width else high

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes


def cut(text: str, ends: EliasFano, draws: tuple[int, int], form: str) -> tuple[int | None, int | None, str]:
    """(prefix_chars, middle_chars, output) of a text cut at two of its units."""
    if form == "plain":
        return None, None, text
    a, b = sorted(d % (ends.n + 1) for d in draws)
    i, j = (ends.select(k - 1) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if form == "psm":
        return i, j - i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return i, j - i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form: a cut text holds no marker, so each stands once in its output."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def halves(second: str) -> tuple[Column, Column]:
        first = F.substring_index(head, second, 1)
        return F.substring(first, len(PREFIX) + 1, F.length(first)), F.substring_index(head, second, -1)

    (prefix, suffix), (tail, start) = halves(SUFFIX), halves(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(start, middle, tail))


def _seeds(seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text).

    ``rate`` per cent of the documents are cut, ``spm`` per cent of these put the suffix first.
    """
    spark = docs.sparkSession
    h1, h2, h3, h4 = _seeds(seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.sha2("text", 256))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")

    # texts with more than a quarter of a partition's share of the rows: at most 4 x width of them
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, rows.count() // (4 * width))
    hot = rows.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > share)
    hot = F.broadcast(hot.select("text_id", F.ceil(F.col("copies") / share).cast("int").alias("parts")))

    rows = rows.join(hot, "text_id", "left")
    copy = F.struct("doc_id", h1.alias("h1"), h2.alias("h2"), form.alias("form"), F.length("text").alias("chars"), F.xxhash64("text").alias("check"))
    part = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")), F.lit(0)).cast("int")
    copies = rows.select("text_id", part.alias("part"), copy.alias("copy")).groupBy("text_id", "part").agg(F.collect_list("copy").alias("copies"))

    many = rows.where("parts is not null").select("text_id", "parts", "text").dropDuplicates()
    many = many.select("text_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
    few = rows.where("parts is null").select("text_id", F.lit(0).alias("part"), "text")
    index = few.union(many).repartition("text_id", "part").select("text_id", "part", "text", F.xxhash64("text").alias("check")).dropDuplicates()
    return index.join(copies, ["text_id", "part"]).select("text", "check", "copies").mapInArrow(_cut_copies, SCHEMA)


def _cut_copies(batches):
    """Each distinct text's boundary list is built once; its documents select their cuts from it."""
    out, size = [], 0
    for batch in batches:
        texts, checks, copies = (batch.column(c) for c in ("text", "check", "copies"))
        for k in range(batch.num_rows):
            text, check = texts[k].as_py(), checks[k].as_py()
            ends = EliasFano(unit_ends(np.frombuffer(text.encode(), dtype=np.uint8)))
            for c in copies[k].as_py():
                if c["chars"] != len(text) or c["check"] != check:
                    continue
                cuts = cut(text, ends, (c["h1"], c["h2"]), c["form"])
                out.append((c["doc_id"], ends.n, c["form"], *cuts))
                size += len(cuts[2])
                if size > BATCH_BYTES:
                    yield _rows(out)
                    out, size = [], 0
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))
