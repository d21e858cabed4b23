"""Pickled assemblies of single cells (one file per cell), read inside tasks.

Pickles are programs, so they are read by an unpickler that knows no code: plain
containers are built, every other class or function a file names becomes an
inert record with the attributes the file gives it. Nothing is imported or called.
"""

from __future__ import annotations

import io
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("cell_id string, locus string, v_call string, d_call string, j_call string, np1_length int, np2_length int, "
          "consensus_count double, productive boolean, junction string, junction_aa string")
_PLAIN = {("builtins", n) for n in ("set", "frozenset", "list", "dict", "tuple", "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object")}
_PLAIN |= {("__builtin__", n) for _, n in set(_PLAIN)} | {("__builtin__", "unicode"), ("__builtin__", "long")}


class Record:
    """What stands for an object of a class that isn't known."""

    def __init__(self, *args, **named):
        pass

    def __setstate__(self, state):
        for part in state if isinstance(state, tuple) else (state,):
            if isinstance(part, dict):
                self.__dict__.update(part)

    def __call__(self, *args):
        return Record()

    def append(self, item):
        pass

    def __setitem__(self, key, value):
        pass


def _rebuilt(cls, base, state):
    """What old protocols call to make an object."""
    return Record() if base is object else base(state)


class Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) in _PLAIN:
            return {"unicode": str, "long": int}.get(name) or getattr(__import__("builtins"), name)
        if (module, name) in (("collections", "OrderedDict"), ("collections", "defaultdict")):
            return (lambda *a: dict(a[-1]) if a and name == "OrderedDict" else {})
        if module in ("copyreg", "copy_reg") and name == "_reconstructor":
            return _rebuilt
        return Record

    def persistent_load(self, pid):
        return None


def _given(value):
    return None if value == "N/A" else value


def chains_of(data: bytes) -> list[dict]:
    """The chains of one cell's file: those that have a sequence, arms A, B, G, D in turn."""
    cell, out = Reader(io.BytesIO(data), encoding="latin1").load(), []
    kinds = cell.recombinants["TCR"]
    for arm in "ABGD":
        for c in kinds.get(arm) or ():
            if c.cdr3 == "N/A" or c.cdr3nt == "N/A":
                continue
            genes, parts = c.summary, c.junction_details
            with_d = bool(c.has_D_segment)
            if with_d != (arm in "BD") or len(parts) != (5 if with_d else 3) or len(genes) != (8 if with_d else 7):
                raise ValueError(f"a chain of arm {arm} doesn't have the parts of its kind")
            calls = {"v": genes[0], "d": genes[1] if with_d else None, "j": genes[2 if with_d else 1]}
            calls = {g: _given(x and x.split("*")[0]) for g, x in calls.items()}
            if any(x and x[3:4] != g.upper() for g, x in calls.items()):
                raise ValueError(f"genes of another kind: {calls}")
            size = lambda k: None if len(parts) <= k or _given(parts[k]) is None else len(parts[k])
            number = c.TPM if isinstance(c.TPM, (int, float)) else None
            out.append({"locus": f"TR{arm}", "v_call": calls["v"], "d_call": calls["d"], "j_call": calls["j"], "np1_length": size(1), "np2_length": size(3),
                        "consensus_count": number, "productive": c.productive if isinstance(c.productive, bool) else None, "junction": c.cdr3nt, "junction_aa": c.cdr3})
    return out


def read_tracer(spark: SparkSession, path: str) -> DataFrame:
    """Chains of all ``<cell>/filtered_TCR_seqs/*.pkl`` below a folder, a row per chain; cells without a chain have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pkl").load(path)
    files = files.where(F.contains("path", F.lit("/filtered_TCR_seqs/"))).select(F.element_at(F.split("path", "/"), -3).alias("cell_id"), "path", "content")

    def run(batches):
        types = {"np1_length": pa.int32(), "np2_length": pa.int32(), "consensus_count": pa.float64(), "productive": pa.bool_()}
        for batch in batches:
            for cell, path_, data in zip(*(batch.column(c).to_pylist() for c in ("cell_id", "path", "content"))):
                try:
                    rows = chains_of(data)
                except Exception as e:
                    raise ValueError(f"{path_} is no assembly of a cell") from e
                if rows:
                    names = list(rows[0])
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * len(rows), pa.string()), *(pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names)], names=["cell_id", *names])

    return files.mapInArrow(run, SCHEMA)
