import hashlib
import json

import pytest
from pyspark.sql import functions as F

from memspan.llm import chat


def back(turns):
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted) for r in chat.read_back(chat.format_chats(turns)).collect()}


def test_round_trip_of_awkward_texts(spark):
    texts = ["", None, "\\", "\\\\|", "<|im_end|>", "<\\|im_end|>", "</s>[INST] ok [/INST]", "<<s>", "<|im_sep|><|im_start|>x", "é😀\n<|im_end|", "$1\\$1", "a" * 5000]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    found = back(spark.createDataFrame(rows, "conv_id long, pos long, role string, text string"))
    for i, t in enumerate(texts):
        turns, loss, formatted = found[i]
        assert turns == [("user", t or ""), ("assistant", t or "")]
        assert loss == (t or "")
        assert formatted.count(chat.TURN_END) == 2 and "[INST]" not in formatted and "</s>" not in formatted


def test_order_ties_nulls_and_repeats(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "a", "y"), (1, None, None, "first"), (1, 1, "a", "y"), (None, 0, "user", "none")]
    found = back(spark.createDataFrame(rows, "conv_id long, pos long, role string, text string"))
    assert found[1][0] == [("", "first"), ("a", "y"), ("a", "y"), ("b", "x")]
    assert found[None][0] == [("user", "none")]
    empty = spark.createDataFrame([], "conv_id long, pos long, role string, text string")
    assert back(empty) == {}


def turns(df):
    return sorted((r.conv_id, r.pos, r.role, r.text) for r in chat.canonical_turns(df).collect())


def test_layouts_of_frames(spark):
    assert turns(spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert turns(spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert turns(spark.createDataFrame([(1, "do", "this", "done"), (2, "do", None, "ok")], "conv_id long, instruction string, input string, output string")) == [(1, 0, "user", "do\n\nthis"), (1, 1, "assistant", "done"), (2, 0, "user", "do"), (2, 1, "assistant", "ok")]
    assert turns(spark.createDataFrame([(1, "p", "r")], "conv_id long, prompt string, response string")) == [(1, 0, "user", "p"), (1, 1, "assistant", "r")]
    extra = spark.createDataFrame([(1, 0, "user", "t", "noise", "p")], "conv_id long, turn int, role string, text string, other string, prompt string")
    assert turns(extra) == [(1, 0, "user", "t")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_fingerprints_do_not_collide_and_ignore_unknown_fields():
    prints = [chat.fingerprint(layout.paths) for layout in chat.LAYOUTS]
    assert len(set(prints)) == len(prints)
    assert chat.fingerprint([*chat.LAYOUTS[0].paths, "unknown"]) == prints[0]


def test_rows_with_fields_of_several_layouts(spark):
    rows = [
        (1, json.dumps({"prompt": "p", "response": "r", "text": "t"})),
        (2, json.dumps({"prompt": "p", "response": "r", "turn": 1})),
        (3, json.dumps({"prompt": "p", "completion": "c", "response": "r"})),
        (4, json.dumps({"instruction": "do", "input": "x", "output": "y", "prompt": "p", "response": "r"})),
        (5, json.dumps({"turn": 1, "role": "user"})),
        (6, json.dumps([1])),
        (7, None),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, payload string, layout int, raw string")
    found = sorted((r.conv_id, r.pos, r.role, r.text) for r in chat.canonical_turns_json(df, "id", "payload").collect())
    assert found == [(1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "user", "p"), (2, 1, "assistant", "r"), (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, 0, "user", "do\n\nx"), (4, 1, "assistant", "y")]
    assert sorted((r.conv_id, r.payload) for r in chat.rows_without_layout(df, "id", "payload").collect()) == [(5, rows[4][1]), (6, "[1]"), (7, None)]
    assert chat.canonical_turns_json(df.where("false"), "id", "payload").count() == 0


def test_very_long_texts(spark):
    said = "<|im_end|> \\ é </s> " * 100_000
    found = back(spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said)], "conv_id long, pos long, role string, text string"))
    assert found[1][0] == [("user", said), ("assistant", said)] and found[1][1] == said


def test_layouts_by_row(spark):
    rows = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, json.dumps({"instruction": "do", "input": "", "output": "done"})),
        (4, json.dumps({"prompt": "p", "completion": "c"})),
        (5, json.dumps({"turn": 3, "role": "system", "text": "s"})),
        (6, json.dumps({"else": 1})),
        (7, "no json"),
        (8, None),
    ]
    found = chat.canonical_turns_json(spark.createDataFrame(rows, "id long, payload string"), "id", "payload")
    assert sorted((r.conv_id, r.pos, r.role, r.text) for r in found.collect()) == [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "a"),
        (3, 0, "user", "do"), (3, 1, "assistant", "done"), (4, 0, "user", "p"), (4, 1, "assistant", "c"), (5, 3, "system", "s"),
    ]


def test_native_plan_and_digest(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    made = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, pos long, role string, text string")))
    assert "Python" not in made._jdf.queryExecution().toString()
    assert made.select(F.sha2("loss_text", 256)).first()[0] == hashlib.sha256(b"a").hexdigest()
