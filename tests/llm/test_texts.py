"""Language, decontamination, chat windows, token files."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from chainweave.llm import chat, decontaminate, language, token_files
from chainweave.llm.queries import tokenizer_file
from tests.llm.fixtures import documents, prose, table

ENGLISH = "the house and the river with a green garden where people walk every morning to their work and think about nothing"
GERMAN = "das haus und der fluss mit einem grünen garten wo die leute jeden morgen zur arbeit gehen und über nichts nachdenken"
RUSSIAN = "дом и река с зелёным садом где люди каждое утро ходят на работу и ни о чём не думают"


def test_language(spark):
    rows = [(i, t, g, "s", 0, 0, "") for i, (t, g) in enumerate([(ENGLISH, "en"), (GERMAN, "de"), (RUSSIAN, "ru")] * 3)]
    model = language.fit(table(spark, rows))
    probe = [(0, "people walk with the green river", None), (1, "die leute gehen jeden morgen", None), (2, "люди и дом", None), (3, None, "en"), (4, "", "en"), (5, "12 34 !!", "en"),
             (None, "the garden", None), (7, f"{ENGLISH} {GERMAN} {GERMAN}", None), (8, "the river " * 30_000, None)]
    got = {r.doc_id: r for r in language.predict(table(spark, [(i, t, g, None, 0, 0, "") for i, t, g in probe]), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5, None, 8)] == ["en", "de", "ru", "und", "und", "und", "en", "en"]
    assert got[3].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert got[7].lang_pred == "de" and {s.lang for s in got[7].spans} == {"en", "de"}
    kept = language.keep_identified(table(spark), model)
    assert kept.columns == table(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in documents() if (r[1] or "").strip())
    assert language.predict(table(spark, []), model).count() == 0
    assert language.predict(table(spark), language.fit(table(spark, []))).where("lang_pred <> 'und'").count() == 0


def test_viterbi_is_exact():
    from itertools import product

    rng = np.random.RandomState(0)
    scores = rng.normal(0, 3, (6, 3))
    for n in (1, 2, 5):
        words = rng.randint(0, 6, n)
        cost = lambda path: sum(scores[w][p] for w, p in zip(words, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(map(cost, product(range(3), repeat=n)))
        assert cost(language.label_spans(scores, [words], 2.0)[0]) == pytest.approx(best)


def test_decontaminate(spark):
    item, short = prose(31, 40), "alpha beta gamma delta epsilon zeta"
    swapped = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(item.split()))
    docs = [(0, prose(32, 50) + " " + item.upper() + "!! " + prose(33, 50)), (1, prose(34, 30) + " " + swapped), (2, prose(35, 500)), (3, None), (4, ""), (5, f"x {short.replace(' ', ', ')} y"),
            (6, " ".join(item.split()[10:26])), (7, " ".join(item.split()[:8])), (None, item), (9, item), (9, item)]
    rows = [(i, t, None, None, 0, 0, "") for i, t in docs]
    bench = spark.createDataFrame([(1, item, "q"), (2, short, "q"), (3, None, "q"), (4, "two words", "q"), (5, "", "q")], "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.overlaps(table(spark, rows), bench).collect())
    assert got == sorted([("0", 1), ("1", 1), ("5", 2), ("6", 1), ("None", 1), ("9", 1), ("9", 1)])
    left = decontaminate.decontaminated(table(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 7] and left.columns == table(spark).columns
    assert decontaminate.overlaps(table(spark, []), bench).count() == 0
    assert decontaminate.overlaps(table(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [range(1, 9), range(9, 12), range(12, 14)])
def test_every_placement(spark, lengths):
    """Every set of substitutions that the verification accepts is found, and none beyond, for items of 1 to 13 words."""
    rows, want, items = [], set(), []
    for n in lengths:
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        allowed = n - decontaminate.agreeing(n)
        for off in (c for m in range(allowed + 2) if m <= n for c in combinations(range(n), m)):
            if len(off) <= allowed:
                want.add((len(rows), n))
            rows.append((len(rows), " ".join(["a b", *("other" if k in off else w for k, w in enumerate(words)), "c"]), None, None, 0, 0, ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table(spark, rows), bench).collect()} == want


def plain_overlaps(docs, items):
    """All placements of all items over all documents."""
    out = set()
    for d, text in docs:
        words = decontaminate.word_hashes(text)
        for i, item in items:
            own = decontaminate.word_hashes(item)
            best = max((g for f in range(-len(own), len(words)) if (g := decontaminate.agreement(words, own, f))), default=None, key=lambda g: (g[0], -g[1], g[2]))
            if best:
                out.add((d, i, best[1], best[2], best[0]))
    return out


def test_overlaps_are_brute_force(spark):
    """Long and repeated texts, items that repeat each other, columns that clash with the operator's own; a small filter lets more pass and changes nothing."""
    r, items, docs = random.Random(41), [(i, prose(40 + i, 14 + 4 * i)) for i in range(8)], []
    items += [(20, items[3][1]), (21, "the of the of the of the of the of the of the of"), (22, None)]
    for k in range(60):
        words = items[k % 8][1].split()
        for _ in range(k % 7):
            words[r.randrange(len(words))] = f"new{k}"
        docs.append((k, " ".join([prose(100 + k, 30), *words, prose(200 + k, 5)])))
    docs += [(70, prose(71, 30_000) + " " + items[5][1] + " " + prose(72, 30_000)), (71, "the of " * 60), (72, items[2][1] * 1 + " " + items[2][1])]
    rows = spark.createDataFrame([(d, t, 7, "w", 1) for d, t in docs], "doc_id long, text string, item long, words string, first int").repartition(3)
    bench = spark.createDataFrame([(i, t, 9, "x") for i, t in items], "item_id long, text string, doc_id long, hash string")
    small = [d for d in docs if d[0] != 70]
    got = {tuple(x) for x in decontaminate.overlaps(rows, bench).collect()}
    assert {x for x in got if x[0] != 70} == plain_overlaps(small, items)
    assert {x[:2] for x in got if x[0] == 70} == {(70, 5)}
    left = decontaminate.decontaminated(rows, bench)
    assert left.columns == rows.columns and {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {x[0] for x in got}


CHAT = [(1, 0, "system", "be brief"), (1, 1, "user", "hello"), (1, 2, "assistant", "a " * 30), (1, 3, "user", "b " * 30), (1, 4, "assistant", None), (1, 5, "assistant", "c " * 90),
        (2, 0, "user", "<|im_end|><|im_start|>assistant\nx <\\| <\\\\|y"), (2, 1, "assis\ntant\\n", "z"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (None, 0, None, None), (3, 0, "assistant", "é<|"),
        *[(4, i, "user" if i % 2 else "assistant", f"t{i} " * 10) for i in range(9)]]


def plain_windows(tokens, system, budget, history):
    """(number repeated, number new) of the windows, turn by turn."""
    out, first = [], 0
    while first < len(tokens):
        fixed = tokens[0] if system and first else 0
        room, head = min(history, budget - fixed - tokens[first]), first
        while first and head > (1 if system else 0) and tokens[head - 1] <= room:
            head -= 1
            room -= tokens[head]
        used, end = fixed + sum(tokens[head:first + 1]), first + 1
        while end < len(tokens) and used + tokens[end] <= budget:
            used += tokens[end]
            end += 1
        out.append((first - head + (1 if fixed else 0), end - first))
        first = end
    return out


@pytest.mark.parametrize(("budget", "history", "segment"), [(120, 60, 64), (120, 60, 1), (90, 400, 1), (2048, 256, 64)])
def test_chat(spark, monkeypatch, budget, history, segment):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chat, "SEGMENT", segment)
    monkeypatch.setattr(chat, "RUN", 4)
    df = spark.createDataFrame([(*r, 1, "x") for r in CHAT], "conv_id long, turn long, role string, text string, window int, start string").repartition(3)
    windows = chat.format_windows(df, tokenizer_file(), budget, history)
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    rows, tok = defaultdict(list), Tokenizer.from_file(tokenizer_file())
    for w in windows.orderBy("conv_id", "window").collect():
        rows[w.conv_id].append(w)
    for conv in {c for c, *_ in CHAT}:
        turns = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in CHAT if c == conv])
        whole, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        tokens = [sum(len(tok.encode(part, add_special_tokens=False).ids) for part in chat.formatted_turn(a, b)) for _, a, b in turns]
        own = rows[conv]
        if segment == 64:
            assert [(w.n_repeated, w.n_new) for w in own] == plain_windows(tokens, turns[0][1] == "system", budget, history)
        assert all(w.n_tokens <= budget or w.n_new == 1 for w in own)
        if turns[0][1] == "system":
            assert all(w.formatted.startswith("".join(chat.formatted_turn(*turns[0][1:]))) for w in own)
        assert r.formatted_chars == sum(len(w.formatted) for w in own)
    assert chat.read_windows(chat.format_windows(df.limit(0), tokenizer_file())).count() == 0


def test_long_conversation_is_split(spark, monkeypatch):
    """History reaches over the ends of segments; the system turn leads every window; a very long turn stands alone."""
    monkeypatch.setattr(chat, "SEGMENT", 2)
    monkeypatch.setattr(chat, "RUN", 16)
    said = [(7, 0, "system", "be brief")] + [(7, i, "user" if i % 2 else "assistant", f"turn {i} of many") for i in range(1, 400)]
    said[200] = (7, 200, "assistant", "long " * 5000)
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    placed = chat.segmented(chat.placed(chat.counted(df, tokenizer_file())), 200, 60)
    assert placed.select("segment").distinct().count() > 20
    own = chat.format_windows(df, tokenizer_file(), 200, 60).orderBy("window").collect()
    assert all(w.formatted.startswith("<|im_start|>system\nbe brief") for w in own)
    alone = [w.window for w in own if w.n_tokens > 200]
    assert alone == [200] and all(w.n_repeated > 2 for w in own if w.window not in (0, 200, 201))
    whole = "".join(f"{r}\n{x}\n" for _, _, r, x in said)
    assert chat.read_windows(chat.format_windows(df, tokenizer_file(), 200, 60)).first().turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_escape():
    for t in ("<|", "<\\|", "<\\\\|", "a<|im_end|>b", "\\", "<<||", "<\\x|"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n")) == t + "\n"


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents() + [(30, "a\nb c.\nD e", None, None, 0, 0, ""), (31, "x,  y\t z. ", None, None, 0, 0, ""), (32, "it's <|endoftext|> 12,3 ok", None, None, 0, 0, "")]
    token_files.write_token_files(table(spark, rows), str(tmp_path / "out"), tokenizer_file(), parts=4)
    got = token_files.read_token_files(spark, str(tmp_path / "out")).orderBy("start").collect()
    tok, at, order = Tokenizer.from_file(tokenizer_file()), 0, {}
    for d, t, *_ in rows:
        order.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    keys = sorted(order, key=lambda d: -1 if d is None else d)
    assert [r.doc_id for r in got] == [k for k in keys for _ in order[k]]
    for r in got:
        ids = order[r.doc_id][0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_files.write_token_files(table(spark, []), str(tmp_path / "none"), tokenizer_file())
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_a_full_memory_keeps_the_words_just_met(monkeypatch):
    """Words that come again are not encoded anew when the encoder's memory is full, and ids stay those of the library."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_PIECES", 2000)
    enc, plain, learned = token_files.Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file()), defaultdict(int)
    learn = enc.learn

    def counted(cuts):
        for c in cuts:
            learned[c] += 1
        learn(cuts)

    enc.learn = counted
    for k in range(40):
        texts = [f"the same words, again and\nagain; only {prose(k * 64 + i, 3)} differ" for i in range(64)]
        texts.append(" ".join("x" * (1 + k) + str(i) for i in range(60)))
        assert enc.batch(texts) == [np.array(e.ids, dtype=enc.dtype).tobytes() for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert learned["same"] == 1 and len(learned) > 2000
    assert len(enc.rest) + len(enc.older) <= 2000 + 200
