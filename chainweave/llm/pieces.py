"""SentencePiece encoding and decoding of merge-type vocabularies.

A text is normalised by the model's own rules and its symbols (at first single
characters) are merged along a score-ordered agenda: of all adjacent pairs that
form a piece of the vocabulary the one with the highest score is merged first,
the leftmost of equals; each merge puts the two pairs beside it on the agenda.
What is left and no piece is written as its bytes.

No piece of such a vocabulary spans the place where a word's white-space mark
follows another character, so a text is cut there and each cut's ids are
remembered (``CACHE_CUTS`` of them in a task). Agendas of up to ``SHORT``
symbols are rows of a table that are served side by side; a longer one is a
heap. Every newly encoded cut is checked against the sentencepiece library,
once per Arrow batch; a difference is an error.

Cases: a null text is empty and has the end id alone; texts of any length are
encoded whole; control and byte pieces spelled out in a text are plain text;
rows that repeat give equal rows, null doc_ids are kept, an empty table gives
none; extra columns are ignored. Models with user-defined pieces, without byte
fallback or without a leading mark are refused.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space (fixed value of the format)
CACHE_CUTS = 300_000
SHORT = 48
CELLS = 1 << 18  # of a table of agendas
BATCH_CHARS = 2 << 20  # of text at a time
SCHEMA = "doc_id long, ids array<int>, decoded string"
_NONE = np.iinfo(np.int32).max
_CUTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_encoders: dict = {}


class Encoder:
    """Ids of texts by the model in a file of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = model.SentencePiece.Type
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not model.normalizer_spec.add_dummy_prefix \
                or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: only merge-type vocabularies with byte fallback, a leading mark and no pieces of the user")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = self.library.eos_id()
        self.bytes = np.zeros(256, dtype=np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {i: model.pieces[i].score for i in self.pieces.values()}
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)  # pieces over several words: no cuts
        self._tabulate(len(model.pieces))
        self.known: dict[str, bytes] = {}

    def _tabulate(self, n: int) -> None:
        """Numbers of symbols, and every pair of symbols that forms a piece with its place in the order of scores."""
        symbol = dict(self.pieces)
        for ch in sorted(set("".join(self.pieces))):
            symbol.setdefault(ch, n + len(symbol))
        self.n_pieces, self.n_symbols = n, n + len(symbol) + 1
        self.char = np.full(0x110000, self.n_symbols - 1, dtype=np.int64)  # the last number: in no piece
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = [(symbol[p[:k]] * self.n_symbols + symbol[p[k:]], rank[self.score[i]], i)
                 for p, i in self.pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].copy()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols."""
        key = a * self.n_symbols + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.made[at]

    def merge_long(self, cut: str) -> list[int]:
        """One cut with its agenda in a heap."""
        text, n = list(cut), len(cut)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple] = []

        def add(i: int) -> None:
            j = right[i]
            if j < n:
                piece = text[i] + text[j]
                made = self.pieces.get(piece)
                if made is not None:
                    heapq.heappush(agenda, (-self.score[made], i, j, piece))

        for i in range(n):
            add(i)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if text[i] is None or text[j] is None or right[i] != j or text[i] + text[j] != piece:
                continue  # one of the two has been merged since
            text[i], text[j], right[i] = piece, None, right[j]
            if right[i] < n:
                left[right[i]] = i
            add(i)
            if left[i] >= 0:
                add(left[i])
        out = []
        for s in text:
            if s is not None:
                i = self.pieces.get(s)
                out += [i] if i is not None else self.bytes[list(s.encode())].tolist()
        return out

    def merge_short(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many cuts at once: a row per cut, whose agenda is the row's ranks. All ids in a row, and how many each cut has."""
        size = np.array([len(c) for c in cuts])
        n, width = len(cuts), int(size.max())
        inside = np.arange(width + 1) < size[:, None]
        symbol = np.full((n, width + 1), self.n_symbols - 1, dtype=np.int64)
        code = np.zeros((n, width + 1), dtype="<u4")
        code[inside] = np.frombuffer("".join(cuts).encode("utf-32-le"), dtype="<u4")
        symbol[inside] = self.char[code[inside]]
        rank, made = np.full((n, width + 1), _NONE, dtype=np.int32), np.zeros((n, width + 1), dtype=np.int64)
        rank[:, :-1], made[:, :-1] = self._pair(symbol[:, :-1], symbol[:, 1:])
        right, left = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(axis=1)  # the first of equals
            open_ = rank[rows, i] < _NONE
            rows, i = rows[open_], i[open_]
            j = right[rows, i]
            symbol[rows, i] = made[rows, i]
            inside[rows, j], rank[rows, j] = False, _NONE
            after, before = np.minimum(right[rows, j], width), left[rows, i]
            right[rows, i], left[rows, after] = after, i
            rank[rows, i], made[rows, i] = self._pair(symbol[rows, i], symbol[rows, after])
            r, b = rows[before >= 0], before[before >= 0]
            rank[r, b], made[r, b] = self._pair(symbol[r, b], symbol[r, right[r, b]])
        row, flat = np.nonzero(inside)[0], symbol[inside]
        odd = flat >= self.n_pieces  # characters that are no pieces, written as their bytes
        if odd.any():
            chars = code[inside][odd]
            count = np.ones(len(flat), dtype=np.int64)
            count[odd] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            row, flat, odd = np.repeat(row, count), np.repeat(flat, count), np.repeat(odd, count)
            flat[odd] = self.bytes[np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)]
        return flat, np.bincount(row, minlength=n)

    def learn(self, cuts: list[str]) -> None:
        """Encode new cuts, check them against the library and remember them."""
        cuts = sorted(cuts, key=len)
        short = [c for c in cuts if len(c) <= SHORT]
        found = [self.merge_short(short[lo:lo + CELLS // SHORT]) for lo in range(0, len(short), CELLS // SHORT)]
        for c in cuts[len(short):]:
            ids = self.merge_long(c)
            found.append((np.array(ids), np.array([len(ids)])))
        ids, sizes = np.concatenate([f for f, _ in found]).astype(np.int32), np.concatenate([n for _, n in found]).tolist()
        # the library puts a cut's leading mark itself; a mark alone is one piece, for which it has no text
        told = self.library.encode([c[1:].replace(MARK, " ") for c in cuts], num_threads=1)
        told = [t if c != MARK else [self.pieces[MARK]] for c, t in zip(cuts, told)]
        if sizes != list(map(len, told)) or ids.tolist() != list(chain.from_iterable(told)):
            ends = np.cumsum(sizes).tolist()
            wrong = next((c, ids[e - n:e].tolist(), t) for c, n, e, t in zip(cuts, sizes, ends, told) if ids[e - n:e].tolist() != t)
            raise RuntimeError("the merges of %r give %s, the library gives %s" % wrong)
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.known.update(zip(cuts, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, end id last."""
        end = np.array([self.end_id], dtype=np.int32).tobytes()
        cuts = [([s] if self.whole else _CUTS.findall(s)) if s else [] for s in self.library.normalize(texts)]
        new = set().union(*cuts).difference(self.known)
        if len(self.known) + len(new) > CACHE_CUTS:
            self.known.clear()
            new = set().union(*cuts)
        if new:
            self.learn(list(new))
        get = self.known.get
        return [np.frombuffer(b"".join([*map(get, c), end]), dtype=np.int32) for c in cuts]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _groups(texts: list[str]):
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > BATCH_CHARS:
            yield texts[lo:k + 1], lo
            lo, size = k + 1, 0
    if lo < len(texts):
        yield texts[lo:], lo


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (end id last), decoded (the library's decoding of the ids) of every row of ``docs`` (doc_id, text).

    ``model``: file for the sentencepiece library, at the same path on every machine.
    """

    def run(batches):
        enc = encoder(model)
        for batch in batches:
            keys = batch.column("doc_id")
            for texts, lo in _groups([t or "" for t in batch.column("text").to_pylist()]):
                ids = enc.encode(texts)
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                decoded = enc.library.decode([x.tolist() for x in ids], num_threads=1)
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(texts)), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
