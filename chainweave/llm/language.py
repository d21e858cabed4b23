"""Language identification of mixed texts.

Learning (Spark job): counts of letter n-grams (1 to 4, with word ends) per
language, over at most about ``max_docs`` labelled documents chosen by a hash of
doc_id (which bounds the fitted model, not what is predicted). All n-grams that
come twice are kept, filed under 64-bit hashes of their letters that are compared
in full, so an unknown one says nothing. It also learns which scripts each
language uses.

Prediction: scripts, given as code point ranges, narrow a word's candidates to
the languages that use its script; each remaining language scores the word by
its n-grams; a Viterbi pass over the words, where each change of language costs
``SWITCH``, labels spans. ``lang_pred`` is the language whose spans hold most
letters (ties: the first by code point), ``score`` its share of the letters.

Cases: null text or no letters: ``und`` and score 0, as for everything where
nothing was learned; null doc_ids are kept; repeated rows get equal results; an
empty table gives no rows; labels, sources and ids are never inputs of a
prediction; extra columns are ignored. Whole texts are used, whatever length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.plans.lineage import written

MAX_DOCS = 10_000
SWITCH = 12.0
SLICE_CHARS = 3_000_000  # texts handled at a time in a task
CACHE_WORDS = 400_000
LONGEST = 4  # of the n-grams
#: starts of script ranges by code point (fixed values of the Unicode standard, blocks of one script merged)
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
]
_STARTS = [s for s, _ in SCRIPTS]
_RUN = re.compile(r"[^\W\d_]+")


def script_of(ch: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(ch)) - 1][1]


def features(run: str) -> list[str]:
    """n-grams of a letter run with its ends marked."""
    s = f"_{run}_"
    return [s[i:i + n] for n in range(1, LONGEST + 1) for i in range(len(s) - n + 1) if s[i:i + n] != "_"]


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n-gram of code points."""
    h = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ codes[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


_alpha = None


def is_letter(codes: np.ndarray) -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.uint8).astype(bool)
    return _alpha[codes]


class Model:
    """Row 0 of ``table`` is what an unknown n-gram says: nothing."""

    def __init__(self, langs: list[str], grams: dict, scripts: dict):
        """grams: n-gram -> log-probabilities by language; scripts: script -> allowed languages as a mask."""
        self.langs = langs
        hashes = np.array([gram_hashes(np.array([ord(c) for c in g], dtype=np.uint64), len(g))[0] for g in grams], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.table = np.zeros((len(grams) + 1, len(langs)), dtype=np.float32)
        if len(grams):
            self.table[1:] = np.array(list(grams.values()), dtype=np.float32)[order]
        refused = np.zeros((len(SCRIPTS), len(langs)), dtype=np.float32)
        for i, (_, name) in enumerate(SCRIPTS):
            if name in scripts:
                refused[i] = -50.0 * ~scripts[name]
        self.refused = refused
        self.reset()

    def __getstate__(self):
        return self.langs, self.hashes, self.table, self.refused

    def __setstate__(self, state):
        self.langs, self.hashes, self.table, self.refused = state
        self.reset()

    def reset(self):
        # hashes are in order: those with the same first bits stand together from ``first`` on, ``most`` at most
        self.bits = max(1, (4 * len(self.hashes)).bit_length())
        own = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(own, np.arange((1 << self.bits) + 1))
        self.most = int(np.diff(self.first).max(initial=0))
        self.index: dict = {}
        self.scores = np.zeros((0, len(self.langs)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the table of each hash, 0 where it is unknown."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = self.first[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        row = np.zeros(len(hashes), dtype=np.int64)
        for k in range(self.most):
            there = np.minimum(at + k, len(self.hashes) - 1)
            row = np.where(self.hashes[there] == hashes, there + 1, row)
        return row

    def learn_words(self, words: list[str]) -> None:
        """Scores of new words, all at once: sums over their n-grams, less what their scripts refuse."""
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            codes = np.frombuffer(("_" + "_".join(part) + "_").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = is_letter(codes)
            codes = np.where(letter, codes, 0x5F).astype(np.uint64)
            lens = np.array([len(w) for w in part], dtype=np.int64) + 1  # a word and the mark before it
            starts = np.cumsum(lens) - lens
            total = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
            for n in range(1, LONGEST + 1):
                slot = gram_hashes(codes, n)
                ok = letter[:len(slot)].copy() if n == 1 else np.ones(len(slot), dtype=bool)
                for k in range(1, n - 1):  # ends of words stand at the ends of an n-gram only
                    ok &= letter[k:k + len(slot)]
                if n == 2:
                    ok &= letter[:-1] | letter[1:]
                total[:len(slot)] += self.table[np.where(ok, self.rows_of(slot), 0)] / 3
            script = np.searchsorted(_STARTS, codes, side="right") - 1
            total += self.refused[script] * letter[:, None]
            new = np.add.reduceat(total, starts, axis=0)
            self.scores = np.vstack([self.scores, new - new.max(axis=1, keepdims=True)])
            self.letters = np.append(self.letters, np.add.reduceat(letter.astype(np.int64), starts))
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text."""
        split = [t.lower().split() for t in texts]
        new = set().union(*split).difference(self.index)
        if new:
            if len(self.index) + len(new) > CACHE_WORDS:
                self.reset()
                new = set().union(*split)
            self.learn_words(list(new))
        get = self.index.__getitem__
        return [np.fromiter(map(get, s), dtype=np.int64, count=len(s)) for s in split]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """docs(doc_id, text, lang): learn from rows with text and lang, at most about ``max_docs`` of them."""
    rows = docs.where("lang is not null and text is not null")
    n = rows.select("lang").count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))

    def count(batches):
        counts: dict = {}
        for b in batches:
            words: dict = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                words.setdefault(lang, Counter()).update(_RUN.findall(text.as_py().lower()))
            for lang, c in words.items():
                own = counts.setdefault(lang, Counter())
                for w, k in c.items():
                    for f in features(w):
                        own[f] += k
                    own["#" + script_of(w[0])] += k * len(w)
        for lang, own in counts.items():
            items = list(own.items())
            for lo in range(0, len(items), 50_000):
                part = items[lo:lo + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "f": [f for f, _ in part], "n": [k for _, k in part]})

    # one row per n-gram and language, whatever the number of tasks that counted
    counts = written(rows.select("lang", "text").mapInArrow(count, "lang string, f string, n long").groupBy("f", "lang").agg(F.sum("n").alias("n")), "language-counts")
    chosen = counts.groupBy("f").agg(F.sum("n").alias("total")).where((F.col("total") > 1) | F.startswith(F.col("f"), F.lit("#"))).select("f")
    top = counts.join(chosen, "f", "left_semi").select("f", "lang", "n").toArrow()  # the n-grams of max_docs documents at most
    table, scripts, langs, by_feature = {}, {}, sorted(set(top["lang"].to_pylist())), {}
    at = {x: i for i, x in enumerate(langs)}
    for f, lang, n in zip(*(top[c].to_pylist() for c in ("f", "lang", "n"))):
        by_feature.setdefault(f, np.zeros(len(langs)))[at[lang]] += n
    letters = sum((v for f, v in by_feature.items() if f[0] == "#"), np.zeros(len(langs)))
    kinds = {}  # log-probabilities within n-grams of each length
    for f, v in by_feature.items():
        if f[0] == "#":
            if len(f) > 1:
                scripts[f[1:]] = v >= 0.01 * np.maximum(letters, 1)
            continue
        kinds.setdefault(len(f), []).append(f)
    for names in kinds.values():
        m = np.array([by_feature[f] for f in names])
        p = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(names)))
        table.update(zip(names, p))
    return Model(langs, table, {s: a for s, a in scripts.items() if a.any()})


def label_spans(scores: np.ndarray, docs: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Viterbi over each document's words, all documents at once; docs sorted by length, longest first."""
    lens = np.array([len(d) for d in docs])
    n, T, L = len(docs), int(lens[0]), scores.shape[1]
    live = np.searchsorted(-lens, -np.arange(T), side="left")  # documents longer than t
    words = np.zeros((T, n), dtype=np.int64)
    for j, d in enumerate(docs):
        words[:len(d), j] = d
    stay, best, v = np.ones((T, n, L), dtype=bool), np.zeros((T, n), dtype=np.uint16), np.zeros((n, L))
    for t in range(T):
        k = live[t]
        x = v[:k]
        if t:
            b = x.argmax(axis=1)
            m = (x[np.arange(k), b] - switch)[:, None]
            stay[t, :k], best[t, :k] = x >= m, b
            x = np.maximum(x, m)
        v[:k] = x + scores[words[t, :k]]
    state, out = v.argmax(axis=1), np.zeros((T, n), dtype=np.uint16)
    for t in range(T - 1, -1, -1):
        k = live[t]
        out[t, :k] = state[:k]
        state[:k] = np.where(stay[t, np.arange(k), state[:k]], state[:k], best[t, :k])
    return [out[:len(d), j] for j, d in enumerate(docs)]


def predict_texts(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple]:
    """(lang, score, spans as (from word, to word, lang)) of each text."""
    out = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    words = model.words([t or "" for t in texts])
    order = sorted((i for i, w in enumerate(words) if model.letters[w].sum()), key=lambda i: -len(words[i]))
    at = 0
    while at < len(order):
        size = max(1, min(512, 1_000_000 // len(words[order[at]])))
        some = order[at:at + size]
        at += size
        for i, states in zip(some, label_spans(model.scores, [words[i] for i in some], switch)):
            share = np.bincount(states, weights=model.letters[words[i]], minlength=len(model.langs))
            top = int(share.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(states)) + 1).tolist(), len(states)]
            out[i] = (model.langs[top], float(share[top] / share.sum()),
                      [(a, b, model.langs[states[a]]) for a, b in zip(cuts, cuts[1:])])
    return out


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Parts of a batch with about SLICE_CHARS of text each."""
    import pyarrow.compute as pc

    lens = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(lens, (lens[lo - 1] if lo else 0) + SLICE_CHARS, side="right"))
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans (word ranges) for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of MAX_DOCS documents at most, one number per language

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                found = predict_texts(held.value, b.column("text").to_pylist(), switch)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                    pa.array([[{"from": a, "to": z, "lang": g} for a, z, g in x[2]] for x in found],
                             pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())])))],
                    names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, spans array<struct<from:int,to:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least the score ``least``; columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                found = predict_texts(held.value, b.column("text").to_pylist(), switch)
                yield b.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
