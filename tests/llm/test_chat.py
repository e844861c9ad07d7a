import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<|end|>\n", "<|turn|>assistant\nno", "&lt;&amp;lt;", "&#91;[&", "", "a\nb", "\\Q\\E", "&#10;"]


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hard_texts(spark):
    rows, want = [], {}
    for c, (a, b) in enumerate(zip(HARD, HARD[::-1], strict=True)):
        turns = [("user", a), ("assistant", b), ("us\ner<", a + b), ("assistant", a)]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        want[c] = digests(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(chat.canonical(df))
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == 4 and "</s>" not in r.formatted and "[INST]" not in r.formatted
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(formatted).collect()}
    assert got == want


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, None, "x"), (1, 0, "assistant", "a"), (None, 0, "user", "u")]
    df = spark.createDataFrame([(*r, "extra", [1]) for r in rows], "conv_id long, turn long, role string, text string, segments string, turns array<int>")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(chat.canonical(df))).collect()}
    assert got[1].turns_sha256 == digests([("", "x"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b"), ("user", "")])[1]
    assert got[1].n_turns == 5 and got[None].n_turns == 1
    assert chat.chat_digests(chat.format_chats(chat.canonical(df.limit(0)))).count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="&<[;ampltg#910/|enduS \n>]", max_size=20), min_size=20, max_size=20))
def test_escape_is_reversible(spark, found):
    df = spark.createDataFrame([(t,) for t in found], "t string")
    assert df.where(chat.unescape(chat.escape(F.col("t"))) != F.col("t")).count() == 0
    assert df.where(chat.escape(F.col("t")).rlike(r"<|\[")).count() == 0


LAYOUTS = {
    "messages": ([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "messages array<struct<role:string,content:string>>"),
    "from_value": ([{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "conversations array<struct<`from`:string,value:string>>"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_list_layouts(spark, name):
    value, schema = LAYOUTS[name]
    df = spark.createDataFrame([(1, value, "x")], f"id long, {schema}, junk string")
    assert chat.layout(df.schema) == name
    assert [tuple(r) for r in chat.canonical(df, "id").orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]


@pytest.mark.parametrize(("columns", "name", "want"), [
    ({"instruction": "do", "input": "this", "output": "a"}, "instruction", [("user", "do\n\nthis"), ("assistant", "a")]),
    ({"instruction": "do", "input": None, "output": "a"}, "instruction", [("user", "do"), ("assistant", "a")]),
    ({"instruction": "do", "output": "a"}, "instruction_only", [("user", "do"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, "completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": None}, "response", [("user", "q"), ("assistant", "")]),
    ({"system": "s", "prompt": "q", "completion": "a"}, "system_prompt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
])
def test_field_layouts(spark, columns, name, want):
    df = spark.createDataFrame([(1, *columns.values())], "id long, " + ", ".join(f"{c} string" for c in columns))
    assert chat.layout(df.schema) == name
    assert [(r.role, r.text) for r in chat.canonical(df, "id").orderBy("turn").collect()] == want


def test_unknown_layout(spark):
    with pytest.raises(ValueError, match="no single mapping"):
        chat.layout(spark.createDataFrame([("x",)], "other string").schema)


def test_records_of_mixed_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"prompt": "q", "completion": "a", "other": 1},
        {"instruction": "do", "input": "x", "output": "a"}, {"conversations": [{"from": "human", "value": "q"}]}, {"strange": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "no json")], "id long, j string")
    got = {}
    for r in chat.canonical_records(df, "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {0: qa, 1: qa, 2: [("user", "do\n\nx"), ("assistant", "a")], 3: [("user", "q")], 4: [("unknown", '{"strange": 1}')], 9: [("unknown", "no json")]}


def test_empty_table_and_very_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.chat_digests(chat.format_chats(chat.canonical(spark.createDataFrame([], schema)))).count() == 0
    turns = [("user", "<|turn|> & [x] " * 100_000), ("assistant", "é&<[" * 200_000)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], schema)
    got = chat.chat_digests(chat.format_chats(chat.canonical(df))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == digests(turns)
