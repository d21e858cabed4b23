"""Token-ID / binary output: flat unsigned files with 64-bit document offsets.

Layout of one part (``part-000012.bin`` / ``.idx``), all little-endian:

* ``.bin``: the ids of the part's documents, end id after each, as uint16 where
  the vocabulary fits and uint32 elsewhere;
* ``.idx``: magic ``CWTOKIDX``, int64 version, int64 bytes per id, int64 number
  of documents n; then n int64 doc_ids, n uint8 flags (0: the doc_id is null)
  and n + 1 int64 offsets, counted in ids from the start of the part.

``manifest`` (Parquet) names the parts with their sizes and bases; a part's base
is the prefix sum of the sizes before it, so the parts form one flat array and
``base + offset`` is a document's place in it. Files are written under a name of
the attempt and renamed, so a retried or speculative task leaves one whole file.

Parts are ranges of doc_id (then of the text's hash, so that a common id or a
missing one is no hot part), as many as shuffle partitions or as ``part_bytes`` of
text ask for. Files are written and read as streams.

Nulls and ties: a null text is empty (the end id alone), null doc_ids come
first, rows with equal doc_id are ordered by their text's hash; an empty table
gives no parts and an empty manifest. Extra columns of ``docs`` are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"CWTOKIDX"
CACHE_PIECES = 600_000  # pieces remembered per Python worker
PART_BYTES = 256 << 20  # of text
READ_DOCS, READ_IDS = 20_000, 1 << 22  # read at a time
PART_SCHEMA = "part int, n_docs long, n_ids long, bin string, idx string"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a local path or URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


_encoders: dict = {}


class Encoder:
    """Ids of a text as bytes, remembering the ids of pieces between single spaces.

    The byte-level pre-tokeniser always starts a piece at a space that stands
    between two non-space characters, so a text cut there has the ids of its
    cuts. A text with any other arrangement of spaces is encoded whole, as is
    every text where the file names another pre-tokeniser or a normaliser.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import json

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        how = spec.get("pre_tokenizer") or {}
        self.cuts = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and not spec.get("normalizer")
        if not self.cuts:
            self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
            return
        self.tok = self.without_cache(path)  # the only one kept: a vocabulary and its merges take 25 MB of a worker
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        space = self.tok.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]  # how a space is written in the vocabulary
        self.starts = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.starts[[i for t, i in self.tok.get_vocab().items() if t.startswith(space)]] = True
        self.first: dict = {}  # cuts with no space before them
        self.rest: dict = {}
        self.older: dict = {}  # ``rest`` before it was full
        self.marks = dict(zip(".,\n", self.whole([".", ",", "\n"])))

    @staticmethod
    def without_cache(path: str):
        """The same tokeniser without its own memory of words: every word given to it is new."""
        import json

        from tokenizers import Tokenizer, models

        tok, spec = Tokenizer.from_file(path), json.loads(Path(path).read_text())["model"]
        if spec.get("merges") and not any(spec.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
            tok.model = models.BPE(vocab=spec["vocab"], merges=pairs, cache_capacity=0)
        return tok

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_words(self, words: list[str]) -> None:
        """Runs of letters are one piece each, whose first id alone starts with the space: encode them as one text."""
        if not words:
            return
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) == len(words):
            raw, ends = ids.tobytes(), (np.r_[cuts[1:], len(ids)] * self.dtype.itemsize).tolist()
            self.rest.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def learn(self, cuts: set[str]) -> None:
        """Fill ``rest``. A mark at a cut's end and a line feed inside are pieces of their own, what follows one has no space."""
        rest, lines, marked, words, odd = self.rest, [], [], set(), []
        for c in cuts:
            if c.isalpha():
                words.add(c)
            elif c[-1:] in (".", ",") and c[:-1].isalpha():
                marked.append(c)
                words.add(c[:-1])
            elif c != c.strip() or not c or "<|" in c:
                rest[c] = None  # not a cut that can be encoded alone
            elif c.count("\n") == 1 and len(c.split()) == 2:
                lines.append(c)
            else:
                odd.append(c)
        halves = [c.split("\n") for c in lines]
        if not all(a and b and not a[-1].isspace() and not b[0].isspace() for a, b in halves):
            odd += lines
            halves = lines = []
        for a, _ in halves:
            if a.isalpha():
                words.add(a)
            elif a[-1] in ".," and a[:-1].isalpha():
                marked.append(a)
                words.add(a[:-1])
            else:
                odd.append(a)
        self.learn_words([w for w in words if w not in rest])
        left = []
        for c in marked:
            stem = rest.get(c[:-1])
            if stem is None:
                left.append(c)
            else:
                rest[c] = stem + self.marks[c[-1]]
        left += odd + [w for w in words if w not in rest]
        rest.update(zip(left, self.whole([" " + c for c in left])))
        heads = list({b for _, b in halves}.difference(self.first))
        self.first.update(zip(heads, self.whole(heads)))
        for c, (a, b) in zip(lines, halves):
            rest[c] = rest[a] + self.marks["\n"] + self.first[b]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.whole(texts)
        out = [None] * len(texts)
        split = [t.split(" ") for t in texts]
        for lo in range(0, len(split), 64):
            new = set().union(*split[lo:lo + 64]).difference(self.rest)
            if len(self.rest) + len(self.first) + len(new) > CACHE_PIECES // 2:  # what was not met since the last time goes
                self.older, self.rest = self.rest, {}
                self.first.clear()
                new = set().union(*split[lo:lo + 64])
            if self.older:
                again = [c for c in new if c in self.older]
                self.rest.update(zip(again, map(self.older.get, again)))
                new.difference_update(again)
            if new:
                self.learn(new)
            get = self.rest.get
            for i in range(lo, min(lo + 64, len(split))):
                head = split[i][0]
                ids = self.first.get(head)
                if ids is None:
                    ids = b"" if not head and len(split[i]) == 1 else None if get(head, b"") is None else self.whole([head])[0]
                    self.first[head] = ids
                ids = [ids, *map(get, split[i][1:])]
                out[i] = None if None in ids else b"".join(ids)
        left = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(left, self.whole([texts[i] for i in left])):
            out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, parts: int | None = None,
                      part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into ``out_dir``; return the manifest.

    ``tokenizer``: file for the tokenizers library, at the same path on every machine.
    """
    spark = docs.sparkSession
    if not parts:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))

    def encode(batches):
        enc, ctx = encoder(tokenizer), TaskContext.get()
        part, fs_, base = ctx.partitionId(), *filesystem(out_dir)
        name = f"{base}/part-{part:06d}"
        tmp = f"{name}.{ctx.taskAttemptId()}"
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        keys, offsets, sink = array("q"), array("q", [0]), None
        null = bytearray()
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs_.create_dir(base, recursive=True)
                sink = fs_.open_output_stream(f"{tmp}.bin")
            own = batch.column("doc_id")
            keys.extend(own.fill_null(0).to_pylist())
            null.extend(own.is_null().to_pylist())
            for lo in range(0, batch.num_rows, 512):
                for ids in enc.batch([t or "" for t in batch.column("text").slice(lo, 512).to_pylist()]):
                    sink.write(ids)
                    sink.write(end)
                    offsets.append(offsets[-1] + len(ids) // enc.dtype.itemsize + 1)
        if sink is None:
            return
        sink.close()
        with fs_.open_output_stream(f"{tmp}.idx") as f:
            f.write(MAGIC + np.array([1, enc.dtype.itemsize, len(keys)], dtype="<i8").tobytes())
            f.write(np.array(keys, dtype="<i8").tobytes())
            f.write((1 - np.frombuffer(null, dtype="u1")).tobytes())
            f.write(np.array(offsets, dtype="<i8").tobytes())
        for kind in ("bin", "idx"):
            fs_.move(f"{tmp}.{kind}", f"{name}.{kind}")
        root = out_dir.rstrip("/")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "n_docs": [len(keys)], "n_ids": [offsets[-1]],
            "bin": [f"{root}/part-{part:06d}.bin"], "idx": [f"{root}/part-{part:06d}.idx"]})

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
            .mapInArrow(encode, PART_SCHEMA))
    root = out_dir.rstrip("/")
    rows.write.parquet(f"{root}/parts")
    # one row per written part: the prefix sum over parts is small at any size
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(f"{root}/parts").withColumns({
        "base_doc": F.coalesce(F.sum("n_docs").over(w), F.lit(0).cast("long")),
        "base_id": F.coalesce(F.sum("n_ids").over(w), F.lit(0).cast("long"))})
    manifest.write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


class Part:
    """One part of the files: keys (None for a null doc_id) and offsets in memory, ids by range: a memory map where the file is local, else ranged reads."""

    def __init__(self, bin_path: str, idx_path: str):
        fs_, path = filesystem(idx_path)
        with fs_.open_input_file(path) as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{idx_path} is no token index")
        _, self.width, n = (int(x) for x in np.frombuffer(raw, "<i8", 3, 8))
        self.keys, self.valid = np.frombuffer(raw, "<i8", n, 32), np.frombuffer(raw, "u1", n, 32 + 8 * n).astype(bool)
        self.offsets = np.frombuffer(raw, "<i8", n + 1, 32 + 9 * n)
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        fs_, path = filesystem(bin_path)
        local = fs_.type_name == "local"
        self.map = np.memmap(path, dtype=self.dtype, mode="r") if local else None
        self.file = None if local else fs_.open_input_file(path)

    def ids(self, a: int, b: int) -> np.ndarray:
        if self.map is not None:
            return self.map[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), self.dtype)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32 (of uint32 little-endian ids)."""
    manifest = spark.read.parquet(f"{out_dir.rstrip('/')}/manifest").select("part", "bin", "idx", "base_id")

    def crc_of(part, a, b):
        crc = 0
        for lo in range(a, b, READ_IDS):
            crc = zlib.crc32(part.ids(lo, min(b, lo + READ_IDS)).astype("<u4").tobytes(), crc)
        return crc

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row["bin"], row["idx"])
                for lo in range(0, len(part.keys), READ_DOCS):
                    hi = min(len(part.keys), lo + READ_DOCS)
                    offsets = part.offsets[lo:hi + 1]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(part.keys[lo:hi], pa.int64(), mask=~part.valid[lo:hi]),
                        "start": pa.array(offsets[:-1] + row["base_id"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                        "ids_crc32": pa.array([crc_of(part, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(width, "part").mapInArrow(read, READ_SCHEMA)
