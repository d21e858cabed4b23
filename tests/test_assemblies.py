import pickle
import sys
import types

import pytest

from chainweave.sources import assemblies


def saved(tmp_path, monkeypatch, protocol, cells):
    """Files as another program's classes write them; the classes are gone when they are read."""
    module = types.ModuleType("tracerlib.core")
    for name in ("Cell", "Recombinant"):
        setattr(module, name, type(name, (), {"__module__": "tracerlib.core"}))
    monkeypatch.setitem(sys.modules, "tracerlib", types.ModuleType("tracerlib"))
    monkeypatch.setitem(sys.modules, "tracerlib.core", module)
    for name, kinds in cells.items():
        cell = module.Cell()
        cell.name, cell.recombinants = name, {"TCR": {k: v and [] for k, v in kinds.items()}}
        for k, chains in kinds.items():
            for c in chains or ():
                r = module.Recombinant()
                r.__dict__.update(c)
                cell.recombinants["TCR"][k].append(r)
        folder = tmp_path / name / "filtered_TCR_seqs"
        folder.mkdir(parents=True)
        (folder / f"{name}.pkl").write_bytes(pickle.dumps(cell, protocol))
    monkeypatch.delitem(sys.modules, "tracerlib.core")


def chain(arm, **own):
    with_d = arm in "BD"
    genes = [f"TR{arm}V1*01", f"TR{arm}D2*01", f"TR{arm}J3*02"] if with_d else [f"TR{arm}V1*01", f"TR{arm}J3*02"]
    return {"cdr3": "CAF", "cdr3nt": "TGTGCATTC", "has_D_segment": with_d, "summary": genes + ["x"] * 5, "TPM": 4.5, "productive": True,
            "junction_details": ["aa", "ccc", "d", "N/A", "g"] if with_d else ["aa", "N/A", "g"], **own}


@pytest.mark.parametrize("protocol", [0, 2, 5])
def test_assemblies(spark, tmp_path, monkeypatch, protocol):
    cells = {"c1": {"A": [chain("A"), chain("A", cdr3="N/A")], "B": [chain("B", summary=["TRBV1*01", "N/A", "TRBJ3*02", *"xxxxx"])], "G": None}, "c2": {"A": []}}
    saved(tmp_path, monkeypatch, protocol, cells)
    (tmp_path / "other.pkl").write_bytes(b"not read")
    got = sorted((r.cell_id, r.locus, r.v_call, r.d_call, r.j_call, r.np1_length, r.np2_length, r.consensus_count, r.productive, r.junction, r.junction_aa)
                 for r in assemblies.read_tracer(spark, str(tmp_path)).collect())
    assert got == [("c1", "TRA", "TRAV1", None, "TRAJ3", None, None, 4.5, True, "TGTGCATTC", "CAF"),
                   ("c1", "TRB", "TRBV1", None, "TRBJ3", 3, None, 4.5, True, "TGTGCATTC", "CAF")]


def test_nothing_is_called(spark, tmp_path):
    class Harm:
        def __reduce__(self):
            return open, (str(tmp_path / "made"), "w")

    assert isinstance(assemblies.Reader(__import__("io").BytesIO(pickle.dumps(Harm()))).load(), assemblies.Record)
    assert not (tmp_path / "made").exists()
    folder = tmp_path / "c" / "filtered_TCR_seqs"
    folder.mkdir(parents=True)
    (folder / "c.pkl").write_bytes(pickle.dumps(Harm()))
    with pytest.raises(Exception, match="is no assembly of a cell"):
        assemblies.read_tracer(spark, str(tmp_path)).collect()
