"""Periodic runs of words.

A run is a stretch of words that are equal ``period`` words apart, with its
smallest period, at least ``least`` words and two periods long, and extended by
no neighbour. Each document is searched in its task:

* a run of period p holds two equal words at some jp and (j + 1)p, so only the
  points of the harmonic grid are probed: n/1 + n/2 + ... in all;
* a hit must have enough equal pairs around it, first tried side by side for all
  hits, then by comparing chunks of doubling length;
* a hit inside a found run whose period divides p lies in that same run and is
  skipped, as is one inside the stretch just found for the same p.

Periods go up, so a stretch is met first under its smallest one; grid points are
made ``GRID`` at a time, which bounds the memory whatever the text's length.

Cases: a null text has no words; a text without words has no run and an empty
``collapsed``; rows that repeat give equal rows, null doc_ids are kept, an empty
table gives none; extra columns are ignored. Words are whatever lies between
the white space of ASCII, compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words of a run
GRID = 1 << 16  # grid points at a time
NEAR = 8  # neighbours of all hits that are compared side by side
CHUNK = 64  # first chunk of an extension
BATCH_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _equal_ahead(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    done, size = 0, CHUNK
    while j + done < len(w):
        b = w[j + done:j + done + size]
        same = w[i + done:i + done + len(b)] == b
        if not same.all():
            return done + int(same.argmin())
        done += len(b)
        size *= 2
    return done


def _equal_behind(w: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j)."""
    done, size = 0, CHUNK
    while done < i:
        k = min(size, i - done)
        same = w[i - done - k:i - done] == w[j - done - k:j - done]
        if not same.all():
            return done + int(same[::-1].argmin())
        done += k
        size *= 2
    return done


def _promising(w: np.ndarray, at: np.ndarray, period: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which equal pairs may lie in ``need`` equal pairs in a row, judged by ``NEAR`` neighbours on each side."""
    total, open_ = np.ones(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
    for step in (1, -1):
        left = np.arange(len(at))
        for k in range(1, NEAR + 1):
            a = at[left] + step * k
            b = a + period[left]
            inside = (a >= 0) & (b < len(w))
            left, a, b = left[inside], a[inside], b[inside]
            left = left[w[a] == w[b]]
            total[left] += 1
        open_[left] = True
    return open_ | (total >= need)


def find_runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, p, found = len(w), 1, {}
    until, of = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)  # the farthest found run over each word: its end, its period
    while 2 * p <= n and n >= least:
        periods, points = [], 0
        while 2 * p <= n and (not periods or points + (n - 1) // p <= GRID):
            periods.append(p)
            points += (n - 1) // p
            p += 1
        periods = np.array(periods)
        counts = (n - 1) // periods
        period = np.repeat(periods, counts)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        hit = w[at] == w[at + period]
        at, period = at[hit], period[hit]
        known = (at + period < until[at]) & (period % of[at] == 0)
        at, period = at[~known], period[~known]
        keep = _promising(w, at, period, np.maximum(least - period, period))
        last, end = 0, 0
        for i, q in zip(at[keep].tolist(), period[keep].tolist()):
            if (q == last and i < end) or (i + q < until[i] and q % of[i] == 0):
                continue
            start = i - _equal_behind(w, i, i + q)
            last, end = q, i + 1 + _equal_ahead(w, i + 1, i + 1 + q)
            length = end - start + q
            if length >= max(least, 2 * q) and (start, length) not in found:
                found[start, length] = q
                span = slice(start, start + length)
                farther = until[span] < start + length
                until[span][farther] = start + length
                of[span][farther] = q
    return sorted((s, m, q) for (s, m), q in found.items())


def _search(batches, least: int):
    out, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = (text.as_py() or "").encode().split()  # bytes: ASCII white space only
            number: dict = {}
            w = np.array([number.setdefault(x, len(number)) for x in words], dtype=np.int64)
            runs = find_runs(w, least)
            if runs:
                gone = np.zeros(len(w) + 1, dtype=np.int64)
                for s, m, q in runs:
                    gone[s + q] += 1
                    gone[s + m] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
            kept = b" ".join(words).decode()
            out.append((doc_id, len(w), [{"start": s, "length": m, "period": q} for s, m, q in runs], kept))
            size += len(kept) + 64 * len(runs) + 64
            if size > BATCH_BYTES:
                yield _rows(out)
                out, size = [], 0
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    types = (pa.int64(), pa.int64(), pa.list_(run), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and ``collapsed`` (the words that no run repeats, one space between) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _search(batches, least), SCHEMA)
