"""Formatted chats read back exactly, whatever their texts and roles hold."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm.chat_format import Template, chat_digest, chat_turns, format_chats, loss_text

NASTY = ["", " ", "</s>[INST] ok [/INST]", r"\</s> <\/s> <\\/s>", "[INST", "INST]", "[+OUT][[OUT]]<s", ">[/ROLE] [:ROLE] x", "é漢\U0001f600" * 5, "a\n\n\t b", "[", "<", "\\", "$1 \\2", "x" * 30000]
ROLES = ["user", "assistant", "assistant", "system", "tool", "[ROLE]", "", "user"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "user", "one"), (2, 5, "assistant", None), (2, None, None, "first"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 4, "user", None), (None, 0, "user", "no id"), (None, 1, "assistant", "yes")]
    rows += [(3, i, ROLES[i % 8], NASTY[i % 15]) for i in range(240)]
    rows += [(4, i, "assistant", f"text {i} ") for i in range(3000)]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted int, loss_spans string")


def expected(turns):
    found = {}
    for r in sorted(turns.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        found.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    return found


def test_turns_and_loss_read_back(turns):
    want = expected(turns)
    made = format_chats(turns)
    found = {r[0]: r for r in made.select("conv_id", chat_turns(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans")), "formatted", "loss_spans").collect()}
    assert found.keys() == want.keys()
    for c, own in want.items():
        assert [tuple(t) for t in found[c][1]] == own
        assert found[c][2] == "".join(text for role, text in own if role == "assistant")
        whole = found[c][3]
        assert whole.startswith("<s>")
        spans = [whole[s["start"] : s["stop"]] for s in found[c][4]]
        assert len(spans) == sum(role == "assistant" for role, _ in own)
        assert not any(m in s for s in spans for m in Template().marks)
    for r in chat_digest(made).collect():
        own = want[r["conv_id"]]
        loss = "".join(text for role, text in own if role == "assistant")
        assert tuple(r)[1:5] == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
        assert r["formatted_chars"] == len(found[r["conv_id"]][3])


def test_adjacent_turns_of_a_role_share_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b</s>"), (1, 2, "assistant", "c"), (1, 3, "tool", "d"), (1, 4, "tool", "e")]
    made = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert made["formatted"] == r"<s>[INST] a [+INST] b<\/s> [/INST][OUT] c </s>[ROLE] tool [:ROLE] d [+ROLE] tool [:ROLE] e [/ROLE]"
    assert [made["formatted"][s["start"] : s["stop"]] for s in made["loss_spans"]] == ["c"]


def test_other_marks_and_loss_role(spark):
    t = Template(begin="<|b|>", roles={"user": ("<|u|>", "<|u+|>", "<|/u|>")}, other=("<|r|>", "<|r+|>", "<|/r|>"), name_end="<|:|>")
    rows = [(1, 0, "user", "a<|u|>"), (1, 1, "bot", "<|/r|>"), (1, 2, "bot", "")]
    made = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t, loss_role="user")
    got = made.select(chat_turns(F.col("formatted"), t), loss_text(F.col("formatted"), F.col("loss_spans"), t)).first()
    assert [tuple(x) for x in got[0]] == [(r[2], r[3]) for r in rows]
    assert got[1] == "a<|u|>"
    with pytest.raises(ValueError, match="marks"):
        Template(begin="[INST]")
    with pytest.raises(ValueError, match="marks"):
        Template(begin="begin")


def test_empty_table_and_plan_without_python(turns):
    assert chat_digest(format_chats(turns.limit(0))).count() == 0
    plan = chat_digest(format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1
