import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from hearsay.llm import chat
from hearsay.llm.queries import QUERIES

PIECES = st.lists(
    st.sampled_from([*chat.MARKS, *chat.CONTROL_STRINGS, "<", "|", "\\", "<\\|turn|>", "turn", "a",
                     "\n", "🙂", "<\\\\/s>"]), max_size=8,
).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a<|says|>"]), PIECES), max_size=4))
def test_round_trip(turns):
    output = "".join(chat.render_turn(role, text) for role, text in turns)
    assert chat.parse(output) == turns
    spans = chat.loss_spans(output)
    assert len(spans) == sum(role == "assistant" for role, _ in turns)


def test_control_strings_do_not_stand_in_the_output():
    for control in chat.CONTROL_STRINGS:
        assert control not in chat.render_turn("user", f"x {control} y")
    assert chat.render_turn("user", "plain") == "<|turn|>00user<|says|>plain<|done|>"


def test_parser_refuses_what_breaks_the_grammar():
    for broken in ("x", "<|turn|>", "<|turn|>00user<|done|>", "<|says|>a<|done|>",
                   "<|turn|>00user<|says|>a", "<|turn|>user<|says|>a<|done|>"):
        assert chat.parse(broken) is None


def expected(turns):
    every, loss = hashlib.sha256(), ""
    for role, text in turns:
        every.update(f"{role}\n{text}\n".encode())
        loss += text if role == "assistant" else ""
    return len(turns), every.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 0, None, "hi"), (2, None, "user", ""),
            (None, 0, "assistant", "</s>"), (1, 2, "assistant", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: tuple(r)[1:5] for r in chat.digests(frame).collect()}
    assert found == {
        1: expected([("", "hi"), ("", "hi"), ("assistant", ""), ("assistant", "x" * 100_000)]),
        2: expected([("user", "")]),
        None: expected([("assistant", "</s>")]),
    }
    assert chat.digests(frame.limit(0)).count() == 0
    whole = {r.conv_id: r.formatted for r in chat.format_conversations(frame).collect()}
    assert chat.parse(whole[2]) == [("user", "")]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    said = "</s>[INST] ok [/INST]"
    turns = {-7: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    found = {r.conv_id: r for r in QUERIES["op2_chat"](spark, folder).collect()}
    assert {k: tuple(v)[1:5] for k, v in found.items()} == {k: expected(v) for k, v in turns.items()}
    assert all(r.formatted_chars > r.loss_chars for r in found.values())
