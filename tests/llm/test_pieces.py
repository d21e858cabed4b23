import random
from itertools import chain

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainweave.llm import pieces
from tests.llm.fixtures import documents, table

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "▁", " ▁ a▁", "\x00a", "</s><s> <unk> <0x0A>", "é" * 450, "x" * 5000, "-" * 130, "中文" * 200, "a\r\nb c　d 🤗", "x" * 48, "x" * 49, "ab" * 600 + " of"]


def by_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [library.encode(t or "", add_eos=True) for t in texts]
    return [(i, library.decode(i)) for i in ids]


def test_rows_are_the_librarys(spark):
    rows = documents() + [(300 + i, t, "en", "a", 0, 0, "") for i, t in enumerate(ODD)]
    want = sorted((str(r[0]), i, d) for r, (i, d) in zip(rows, by_library([r[1] for r in rows])))
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in pieces.encode_and_decode(table(spark, rows), MODEL).collect())
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeinorst ▁\n\tÉßABZ.,<>/09ｆ🤗中'-_"), max_size=120), max_size=6))
def test_any_text(texts):
    enc = pieces.encoder(MODEL)
    assert [x.tolist() for x in enc.encode(texts)] == [i for i, _ in by_library(texts)]


def test_both_agendas_agree():
    enc, r = pieces.encoder(MODEL), random.Random(5)
    parts = "the of relationship pro fess ion al ---- ** ing tion er ßé 中 🤗".split()
    cuts = ["▁" * r.randrange(4) + "".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(400)]
    flat, sizes = enc.merge_short(cuts)
    alone = [enc.merge_long(c) for c in cuts]
    assert flat.tolist() == list(chain.from_iterable(alone)) and sizes.tolist() == list(map(len, alone))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CUTS", 5)
    enc = pieces.Encoder(MODEL)
    for texts in (["a b c d"], ["e f g h i j k"], ["a b"]):
        assert [x.tolist() for x in enc.encode(texts)] == [i for i, _ in by_library(texts)]
    assert len(enc.known) <= 7


def test_a_difference_is_an_error():
    enc = pieces.Encoder(MODEL)
    enc.ranks = enc.ranks[::-1].copy()
    with pytest.raises(RuntimeError, match="the library gives"):
        enc.encode(["international relationship"])


def test_empty(spark):
    assert pieces.encode_and_decode(table(spark, []), MODEL).count() == 0
