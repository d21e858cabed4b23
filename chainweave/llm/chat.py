"""Chat formatting in token-budgeted windows.

1. Each turn is formatted and its tokens are counted with the tokenizer file:
   those of its text and of the template before and after it.
2. Prefix sums: a turn's ``start`` is the number of tokens of its conversation
   before it (ordered by turn, then role and text). Sums run over runs of ``RUN``
   turn numbers, then over these runs' totals, so no conversation goes through one
   task.
3. A conversation is cut into segments of ``SEGMENT`` budgets by ``start``; the
   turns before a segment that its first window may repeat, and the system turn,
   are sent along. Inside a segment windows are laid over the prefix sums: a
   window starts with the system turn (where the conversation opens with one) and
   as many of the whole turns just before it as fit ``history`` tokens, then takes
   as many whole turns as the budget allows, both by search in the sums.

A turn longer than the budget stands alone in an over-long window: turns are
never cut. The loss mask covers the text of assistant turns in the window where
they are new; repeated turns are masked.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per turn. A run of
backslashes between ``<`` and ``|`` gains one backslash, so no control string
can occur inside a text and unescaping is exact; in roles, backslashes and line
feeds are escaped too.

Cases: null text or role is empty; null conv_id forms one conversation of its
own, null turn comes first; equal rows are kept, each a turn; an empty table
gives no windows; extra columns are ignored. A task holds one segment: a bounded
number of tokens and at most one longer turn. Turns of one conversation that
share a turn number (or have none) are sorted in one task, on disk where needed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.language import slices
from chainweave.llm.token_files import encoder
from chainweave.plans.lineage import written

BUDGET, HISTORY = 2048, 256
SEGMENT, RUN = 64, 4096
START, END = "<|im_start|>", "<|im_end|>"
WINDOW_SCHEMA = ("conv_id long, window long, n_repeated int, n_new int, n_tokens long, formatted string, "
                 "loss array<struct<start:int,end:int>>")
DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long, n_windows long")
_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def formatted_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text as it is written, what stands after it."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def counted(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text and n_tokens of the formatted turn, its three parts counted one by one."""

    def run(batches):
        enc, marks = encoder(tokenizer), {}
        size = lambda texts: [len(ids) // enc.dtype.itemsize for ids in enc.batch(texts)]
        for batch in batches:
            for b in slices(batch):
                turns = [formatted_turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
                if len(marks) > 10_000:
                    marks.clear()
                for head, _, tail in turns:
                    if head not in marks:
                        marks[head] = sum(size([head, tail]))
                n = [marks[t[0]] + k for t, k in zip(turns, size([t[1] for t in turns]))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n_tokens"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, n_tokens long")


def placed(turns: DataFrame) -> DataFrame:
    """Turns with ``start`` (tokens before them) and ``nth`` in their conversation, and the conversation's ``total``; ``turns`` is a written table."""
    turns = turns.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))))
    own = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({"upto": F.sum("n_tokens").over(own), "place": F.count(F.lit(1)).over(own)})
    runs = turns.groupBy(F.col("conv_id").alias("c"), F.col("run").alias("r")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("c", "r", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
                       F.sum("tokens").over(Window.partitionBy("c")).alias("total"))
    placed_ = turns.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return placed_.select("conv_id", "role", "text", "n_tokens", "total", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"),
                          (F.col("base_n") + F.col("place") - 1).alias("nth"))


def segmented(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """What each segment needs: kind 0: the system turn, 1: turns that its first window may repeat, 2: its own turns."""
    size = SEGMENT * budget
    seg = F.floor(F.col("start") / size)
    opens = (F.col("nth") == 0) & (F.col("role") == "system")
    at = lambda s, kind: F.struct(s.cast("long").alias("segment"), F.lit(kind).alias("kind"))
    own = F.array(at(seg, 2))
    lead = F.when(F.col("start") >= (seg + 1) * size - history, F.array(at(seg + 1, 1)))
    last = F.floor((F.col("total") - 1) / size)
    system = F.when(opens & (last > 0), F.transform(F.sequence(F.lit(1).cast("long"), last.cast("long")), lambda s: at(s, 0)))
    none = F.array().cast("array<struct<segment:bigint,kind:int>>")
    rows = turns.withColumn("at", F.explode(F.concat(own, F.coalesce(F.when(~opens, lead), none), F.coalesce(system, none))))
    return rows.select("conv_id", "at.segment", "at.kind", "nth", "role", "text", "n_tokens")


def windows_of(tokens: np.ndarray, lead: int, system: int | None, opening: bool, budget: int, history: int):
    """(first repeated, first new, end) of the windows over the turns ``lead`` and on.

    tokens: of the turns in order, the first ``lead`` of which may only be repeated;
    system: tokens of the system turn, if the conversation has one; ``opening``: it is the first of these turns itself.
    """
    sums = np.r_[0, np.cumsum(tokens)]
    first, n, low = lead, len(tokens), 1 if opening else 0
    while first < n:
        at_start = opening and first == 0
        fixed = 0 if system is None or at_start else system
        room = min(history, budget - fixed - int(tokens[first]))
        head = first if at_start or room <= 0 else max(low, int(np.searchsorted(sums, sums[first] - room, side="left")))
        head = min(head, first)
        end = int(np.searchsorted(sums, sums[head] + budget - fixed, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield head, first, end
        first = end


def _segment_windows(conv, segment, rows, budget, history):
    """Rows of WINDOW_SCHEMA of one segment; rows: (kind, nth, role, text, n_tokens), ordered."""
    system = next((r for r in rows if r[0] == 0), None)
    turns = [r for r in rows if r[0] > 0]
    lead = sum(r[0] == 1 for r in turns)
    opening = segment == 0 and bool(turns) and turns[0][1] == 0 and turns[0][2] == "system"
    system = turns[0] if opening else system
    tokens = np.array([r[4] for r in turns], dtype=np.int64)
    for head, first, end in windows_of(tokens, lead, system and system[4], opening, budget, history):
        repeated = ([system] if system and not (opening and first == 0) else []) + turns[head:first]
        new, at, parts, loss = turns[first:end], 0, [], []
        for k, (_, _, role, text, _) in enumerate(repeated + new):
            a, b, c = formatted_turn(role, text)
            parts += [a, b, c]
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + len(a), "end": at + len(a) + len(b)})
            at += len(a) + len(b) + len(c)
        yield conv, new[0][1], len(repeated), len(new), sum(r[4] for r in repeated + new), "".join(parts), loss


def _runs(batches, columns, n_keys: int):
    """(key, iterator of its rows) for each run of equal keys, the first ``n_keys`` columns; rows are streamed."""
    from itertools import groupby

    def rows():
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield from zip(*(part.column(c).to_pylist() for c in columns))

    return groupby(rows(), key=lambda r: r[:n_keys])


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text): see WINDOW_SCHEMA.

    ``window`` is the number of turns before the window's first new one; loss spans are code points of ``formatted``;
    ``tokenizer``: file for the tokenizers library, at the same path on every machine.
    """

    def run(batches):
        out, size = [], 0
        for (conv, segment), rows in _runs(batches, ("conv_id", "segment", "kind", "nth", "role", "text", "n_tokens"), 2):
            for w in _segment_windows(conv, segment, [r[2:] for r in rows], budget, history):
                out.append(w)
                size += len(w[5])
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segmented(placed(written(counted(conversations, tokenizer), "chat-turns")), budget, history)
    return rows.repartition(width, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "nth").mapInArrow(run, WINDOW_SCHEMA)


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    names = ("conv_id", "window", "n_repeated", "n_new", "n_tokens", "formatted", "loss")
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=list(names))


def read_windows(windows: DataFrame) -> DataFrame:
    """Digests per conversation, read back from formatted windows: see DIGEST_SCHEMA.

    A digest of a whole conversation takes its windows one after the other; they are streamed, one at a time in memory.
    """

    def run(batches):
        out = []
        for (conv,), rows in _runs(batches, ("conv_id", "n_repeated", "formatted", "loss"), 1):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = n_loss = n_formatted = n_windows = 0
            for _, repeated, text, spans in rows:
                for role, body in _TURN.findall(text)[repeated:]:
                    turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    piece = unescape(text[s["start"]:s["end"]])
                    loss.update(piece.encode("utf-8", "surrogatepass"))
                    n_loss += len(piece)
                n_formatted += len(text)
                n_windows += 1
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_formatted, n_windows))
            if len(out) >= 5000:
                yield _digests(out)
                out = []
        yield _digests(out)

    width = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return windows.repartition(width, "conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST_SCHEMA)


def _digests(rows):
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    cols = zip(*rows) if rows else [[]] * len(names)
    kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)
