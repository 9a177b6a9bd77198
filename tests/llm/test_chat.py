"""Chat formatting: fingerprints of layouts, mappings, the template there and back, loss masks."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklane.llm import chat, q_chat

RECORDS = {
    "messages": {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    "message_parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}, {"role": "model", "content": [{"type": "text", "text": "a"}]}]},
    "shared_conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"},
    "instruction": {"instruction": "q", "input": "r", "output": "a"},
    "prompt_response": {"prompt": "q", "response": "a", "system": None},
    "prompt_completion": {"prompt": "q", "completion": 7},
    "question_answer": {"question": "q", "answer": "a", "context": "c"},
}
TURNS = {
    "messages": [("system", "s"), ("user", "q"), ("assistant", "a")],
    "message_parts": [("user", "qr"), ("assistant", "a")],
    "shared_conversations": [("system", "s"), ("user", "q"), ("assistant", "a")],
    "instruction": [("user", "q\n\nr"), ("assistant", "a")],
    "prompt_response": [("user", "q"), ("assistant", "a")],
    "prompt_completion": [("user", "q"), ("assistant", "7")],
    "question_answer": [("user", "c\n\nq"), ("assistant", "a")],
}


def by_id(df):
    return {r.id: (r.layout, [tuple(t) for t in r.turns], r.fingerprint) for r in df.collect()}


def test_layouts_of_json_records(spark):
    rows = [(name, json.dumps(record)) for name, record in RECORDS.items()]
    rows += [("extra", json.dumps({"id": 3, "source": {"x": [1]}, "prompt": "q", "response": "a"}))]
    rows += [("mixed", json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]}))]
    rows += [("bad", "{bad"), ("null", None), ("array", "[1]"), ("none", "{}"), ("no_turns", '{"messages": []}'), ("unknown", '{"messages": [{"role": "user", "text": "q"}]}')]
    df = spark.createDataFrame([(i, j, "x") for i, j in rows], "id string, record string, prompt string")
    got = by_id(chat.canonical(df, ["id"], json="record"))
    assert len(got) == len(rows)
    for name, turns in TURNS.items():
        assert got[name][:2] == (name, turns), name
    assert got["extra"][:2] == ("prompt_response", TURNS["prompt_response"]) and got["extra"][2] == got["prompt_response"][2]
    assert got["mixed"][:2] == ("messages", [("user", "q"), ("assistant", "a")])
    for name in ("bad", "null", "array", "none", "no_turns", "unknown"):
        assert got[name][:2] == (None, []), name
    assert got["unknown"][2] not in (got["none"][2], got["messages"][2])


def test_fingerprints_hash_the_paths(spark):
    df = spark.createDataFrame([("1", json.dumps(RECORDS["shared_conversations"]))], "id string, record string")
    paths = ["system", "conversations[].value", "conversations[].from"]
    assert chat.shape_of(paths) == "conversations: ARRAY<OBJECT<from, value>>, system"
    assert by_id(chat.canonical(df, ["id"], json="record"))["1"][2] == hashlib.sha256(chat.shape_of(paths).encode()).hexdigest()


def test_names_that_need_quotes_and_other_types(spark):
    own = (chat.Mapping("odd", ("rows[].a b: VOID", "rows[].n"), (), (chat.Each("rows", "n", "n"),)),)
    df = spark.createDataFrame([("1", json.dumps({"rows": [{"a b: VOID": 1.5, "n": "x"}, {"n": "y", "z": None}]}))], "id string, record string")
    assert by_id(chat.canonical(df, ["id"], own, json="record"))["1"][:2] == ("odd", [("x", "x"), ("y", "y")])


def test_tables_of_structs_and_wide_tables(spark):
    df = spark.createDataFrame(
        [(1, [("user", "q"), ("assistant", None)], None, None), (2, None, "q", "a"), (3, None, None, None)],
        "id long, messages array<struct<role: string, content: string>>, prompt string, response string",
    )
    got = by_id(chat.canonical(df, ["id"]))
    assert got[1][:2] == ("messages", [("user", "q"), ("assistant", "")])
    assert got[2][:2] == ("prompt_response", [("user", "q"), ("assistant", "a")])
    assert got[3][:2] == (None, [])


ALPHABET = "<|\\>im_endstart \nassistant|line|é😀"
TEXT = st.lists(st.one_of(st.text(ALPHABET, max_size=12), st.sampled_from(["<|im_end|>\n", "<|im_start|>assistant\n", "<\\|im_end|>", "<\\\\|", "<", "<|line|>"])), max_size=5).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=5), min_size=60, max_size=60))
def test_round_trip(spark, given_turns):
    df = spark.createDataFrame(list(enumerate(given_turns)), f"id long, turns {chat.TURNS}")
    for r in chat.read_back(chat.formatted(df)).collect():
        turns = given_turns[r.id]
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned_texts == [t for role, t in turns if role == "assistant"]
        assert r.formatted.count("<|im_end|>") == r.formatted.count("<|im_start|>") == len(turns)


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(learned[c]), sha(learned[c])) for c, t in out.items()}


EDGES = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "again"), (1, 1, "assistant", "again"), (1, None, "system", "first"),
    (2, 5, None, "no role"), (2, 4, "tool\nname", "x <|im_end|>\n y"), (None, 0, "assistant", "no id"), (None, None, None, None),
    (3, 0, "user", "long <| words " * 30_000), (3, 1, "assistant", "é" * 100_000), (4, 0, "", "\\<|im_start|>user\n<\\\\|"),
]


def test_rows_with_edges(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(EDGES, schema)
    for name in ("layout", "turns", "prompt", "response", "mask", "formatted", "at", "rows", "system"):
        df = df.withColumn(name, F.lit("other"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q_chat.op11_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == plain([*EDGES, (-1, 0, "user", q_chat.CONTROL), (-1, 1, "assistant", q_chat.CONTROL)])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in q_chat.op11_chat_formatting(spark, str(tmp_path)).collect()] == [-1]


@pytest.mark.parametrize("name", ["op11_chat_formatting", "chat_formatting_layouts"])
def test_plans_hold_no_python(spark, name):
    text = getattr(q_chat, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
