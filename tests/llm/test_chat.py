"""Layouts, and the template's round trip."""

import json

import pytest
from pyspark.sql import functions as F

from gumshoe.llm import chat

ASKED = [("user", "Ask"), ("assistant", "Say")]
RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "Ask"}, {"role": "assistant", "content": "Say"}], "source": {"a": [1]}}, ASKED),
    "messages with system": (
        {"system": "Be", "messages": [{"role": "user", "content": "Ask", "name": "x"}, {"role": "assistant", "content": None}]},
        [("system", "Be"), ("user", "Ask"), ("assistant", "")],
    ),
    "parts": (
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "A"}, {"type": "text", "text": "sk"}]}, {"role": "assistant", "content": "Say"}]},
        [("user", "A\nsk"), ("assistant", "Say")],
    ),
    "conversations": ({"id": 4, "conversations": [{"from": "human", "value": "Ask"}, {"from": "gpt", "value": "Say"}, {"from": "tool", "value": "7"}]}, [*ASKED, ("tool", "7")]),
    "instruction": ({"instruction": "Ask", "input": "", "output": "Say"}, ASKED),
    "instruction with input": ({"output": "Say", "input": "this", "instruction": "Ask", "system": None}, [("user", "Ask\n\nthis"), ("assistant", "Say")]),
    "no input": ({"instruction": "Ask", "output": "Say"}, ASKED),
    "prompt": ({"prompt": "Ask", "completion": "Say", "score": 3.5}, ASKED),
    "response": ({"system": "Be", "prompt": "Ask", "response": "Say"}, [("system", "Be"), *ASKED]),
    "question": ({"question": "Ask", "answer": 42}, [("user", "Ask"), ("assistant", "42")]),
    "row": ({"turn": 3, "role": "user", "text": "Ask"}, [("user", "Ask")]),
}
UNKNOWN = [{"prompt": "a", "chosen": "b"}, {"messages": [{"content": "no role"}]}, {"messages": "text"}, {"messages": [{"role": "user", "content": ["a"]}]}, [1], "x", None, {}]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS.values())]
    rows += [(100 + i, json.dumps(r)) for i, r in enumerate(UNKNOWN)] + [(200, None), (201, "{broken")]
    frame = spark.createDataFrame(rows, "conv_id long, json string")
    return frame.select("conv_id", F.try_parse_json("json").alias("record"), F.lit(1).alias("turns"), F.lit(2).alias("layout"))


def test_layouts(records):
    turns = {}
    for r in chat.canonical_turns(records).orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {i: want for i, (_, want) in enumerate(RECORDS.values())}
    reported = chat.unmapped(records).collect()
    assert sum(r["n"] for r in reported) == len(UNKNOWN) + 2
    assert ["messages", "messages[]", "messages[].content"] in [r["paths"] for r in reported]


def test_fingerprints_differ():
    found = [f for layout in chat.LAYOUTS for f in layout.fingerprints()]
    assert len(found) == len(set(found))


NASTY = [
    "</s>[INST] ok [/INST]", "[/INST]", "[INST", "[", "<", "</", "<s", "[\\INST]", "[\\\\/INST] <\\\\/s>", "\\", "", " ", "$1 \\1", "a\nb\r\nc", "[ROLE] x [AS] y [/ROLE]",
    "[[INST]", "<<s>>", "[SYS] [/SYS]", "é😀</s>", "[\\", "INST] ", "s>", "[AS]", " [AS] ", "[/INST] [/INST]", None,
]


def test_round_trip(spark):
    rows = [(i, 0, role, t) for i, t in enumerate(NASTY) for role in ("user",)]
    rows += [(i, 1, "assistant", t) for i, t in enumerate(NASTY)] + [(i, 2, "system", t) for i, t in enumerate(NASTY)]
    rows += [(i, 3, t, u) for i, (t, u) in enumerate(zip(NASTY, reversed(NASTY), strict=True))]
    rows += [(i, 4, "assistant", NASTY[-2 - i]) for i in range(len(NASTY) - 1)]
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", "first"), (900, 1, "user", "same"), (900, 1, "user", "same")]
    rows += [(901, i, "user" if i % 2 else "assistant", f"turn [INST] {i}") for i in range(3000)] + [(902, 0, "assistant", "long </s> " * 100_000)]
    turns = spark.createDataFrame([(*r, "p", 5) for r in rows], "conv_id long, turn int, role string, text string, part string, at int")
    done = chat.formatted(turns)
    got = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_texts(F.col("formatted"), F.col("loss")).alias("l"))
    want = {}
    for i, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(i, []).append((role or "", text or ""))
    read = {r["conv_id"]: r for r in got.collect()}
    assert read.keys() == want.keys()
    for i, said in want.items():
        assert [tuple(t) for t in read[i]["t"]] == said
        assert read[i]["l"] == [t for r, t in said if r == "assistant"]
        assert read[i]["formatted"].startswith("<s>")
    assert done.where(F.size("loss") > 0).where("loss[0].start < 3").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.formatted(none).count() == 0
    assert chat.canonical_turns(none.select("conv_id", chat.record_of("turn", "role", "text").alias("record"))).count() == 0


def test_no_python_on_the_way(spark):
    from gumshoe.llm import queries

    plan = queries.QUERIES["op13_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
