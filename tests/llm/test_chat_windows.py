import hashlib

from pyspark.sql import functions as F

from boxloom.llm.chat_windows import chat_windows, digests, escape, loss_texts, parse_window, unescape, word_tokens

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sample():
    rows = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 7)) for i in range(1, 60)]
    rows += [(2, 0, "user", "</s>[INST] ok & <s> [TXT] &lt; &amp;lt;"), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (3, None, None, None), (3, 4, "assistant", ""), (None, 1, "assistant", "é🙂"), (None, 1, "assistant", "é🙂")]
    return rows + [(4, 0, "assistant", "long " * 400), (4, 1, "assistant", "x")]


def test_read_back_and_mask(make):
    got = {r.conv_id: r for r in digests(chat_windows(make(sample(), SCHEMA), budget=60, history=16)).collect()}
    convs = {}
    for c, t, r, x in sample():
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_budget_history_and_system_turn(make):
    windows = chat_windows(make(sample(), SCHEMA), budget=60, history=16).orderBy("conv_id", "first_turn").where("conv_id = 1").collect()
    assert len(windows) > 3
    for w in windows:
        assert w.formatted.startswith("<s>system[TXT]be brief</s>")
    turns = {i: x for _, i, _, x in sample()[:60]}
    size = lambda t: max(1, len(t.split()))
    for w in windows:
        assert sum(size(turns[i]) for i in range(w.first_turn, w.first_turn + w.n_turns)) <= 44
        repeated = [p.split("[TXT]")[1][:-4] for p in w.formatted.split("<s>")[2 : w.n_context + 1]]
        assert sum(map(size, repeated)) <= 16
    assert max(w.n_context for w in windows) > 1


def test_empty_and_escape(spark, make):
    assert digests(chat_windows(make([], SCHEMA))).count() == 0
    df = spark.createDataFrame([("<s>&lt;[TXT]&&amp;lb;",)], "t string")
    r = df.select(escape("t").alias("e"), unescape(escape("t")).alias("u"), "t").first()
    assert "<" not in r.e and "[" not in r.e and r.u == r.t


def test_pieces_are_ordered(make):
    windows = chat_windows(make(sample(), SCHEMA), budget=60, history=16, count_tokens=lambda t: word_tokens(t) + F.lit(0))
    assert parse_window(windows).where("conv_id = 1").count() == 60
    assert loss_texts(windows).count() == windows.count()
