import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import chat as C

parts = st.lists(st.sampled_from(["\\", "\n", "### User: ", "### Assistant: ", "### @x: ", "</turn>", "\n</turn>\n", "###", " ", "a", "é", "<", "/turn>"]), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "", "User", "tool/é x"]), st.text(max_size=4))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, parts), max_size=4))
def test_round_trip(turns):
    assert all(C.unescape(C.escape(t)) == t for _, t in turns)
    text = "".join(C.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in C.parse(text)] == turns


def test_plain_text_is_not_escaped():
    assert C.render("user", "plain \\ text")[3] == 0 and C.render("user", "a </turn> b")[3] == 1


def test_parser_refuses():
    for bad in ("x", "### User: a", "### User: a </turn>\n</turn>\n", "### Nobody: a\n</turn>\n"):
        with pytest.raises(C.Conflict):
            list(C.parse(bad))


def digest(rows):
    out, by = [], {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, ts in by.items():
        ts.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        out.append((c, len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, None, None, None),
        (2, 0, "tool", "x\n</turn>\n"), (None, 0, "assistant", ""), (None, 3, "system", "\\"), (3, 0, "assistant", "é" * 70_000), (4, 0, "User", "### @x: ")]


def test_query_digests(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, segment string, place int")
    got = C.read_back(C.format_turns(df)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == digest(ROWS)
    whole = {r["conv_id"]: r for r in C.format_conversations(df).collect()}
    for r in got:
        text = whole[r["conv_id"]]["formatted"]
        assert len(text) == r["formatted_chars"]
        loss = "".join(C.unescape(text[m["start"]:m["end"]]) for m in whole[r["conv_id"]]["mask"])
        assert hashlib.sha256(loss.encode()).hexdigest() == r["loss_sha256"]
    assert C.read_back(C.format_turns(df.limit(0))).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    got = C.op3_chat_formatting(spark, sf_dir).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == digest(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_a_million_backslashes():
    import time
    from strataline.llm import chat
    for text in ("\\" * 1_000_000, "\\" * 1_000_000 + "### User: x", ("\\" * 50 + "</turn>") * 5000):
        start = time.perf_counter()
        assert chat.unescape(chat.escape(text)) == text
        assert time.perf_counter() - start < 5
