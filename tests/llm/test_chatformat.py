import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import chatformat, packing, queries

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "<|endoftext|>", "a", "\n", "é", "𝄞", ""]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    safe = chatformat.escaped(text)
    assert chatformat.unescaped(safe) == text
    assert not re.search(r"</?s>|\[/?INST\]|<\|endoftext\|>", safe)
    whole = chatformat.START + safe + chatformat.BODY + safe + chatformat.END
    assert [tuple(map(chatformat.unescaped, m.groups())) for m in chatformat.TURN.finditer(whole)] == [(text, text)]


def want(rows):
    """{conv_id: (n_turns, turns digest, loss_chars, loss digest)} from the table."""
    chats = {}
    for conv_id, turn, role, text in rows:
        chats.setdefault(conv_id, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, turns in chats.items():
        turns.sort(key=lambda t: t[:3])
        told = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv_id] = (len(turns), digest(told), len(loss), digest(loss))
    return out


def found(frame):
    rows = frame.collect()
    out = {r["conv_id"]: tuple(r)[1:5] for r in rows}
    assert len(out) == len(rows)
    return out


def check_sequences(rows, capacity):
    """Positions, intervals and spans of each sequence; gives (tokens, tokens of all conversations unshared)."""
    emitted = unshared = 0
    for r in rows:
        nodes, way = r["nodes"], chatformat.paths([n.asDict(recursive=True) for n in r["nodes"]])
        assert [n["start"] for n in nodes] == [0, *[n["end"] for n in nodes[:-1]]] and nodes[-1]["end"] == len(r["tokens"])
        assert len(nodes) == 1 or len(r["tokens"]) <= capacity or len(r["conversations"]) == 1
        for i, node in enumerate(nodes):
            assert node["parent"] < i
            above = [t for j in way[i][:-1] for t in range(nodes[j]["start"], nodes[j]["end"])]
            assert [t for x in node["intervals"] for t in range(x["start"], x["end"])] == above
            own = r["position_ids"][node["start"] : node["end"]]
            first = r["position_ids"][0] + len(above)
            assert own == list(range(first, first + len(own)))
        # each turn lies once below its parent
        keys = {(n["parent"], tuple(r["tokens"][n["start"] : n["end"]])) for n in nodes}
        assert len(keys) == len(nodes)
        emitted += len(r["tokens"])
        unshared += sum(nodes[j]["end"] - nodes[j]["start"] for c in r["conversations"] for j in way[c["node"]])
    return emitted, unshared


def test_plain_version_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    extra = [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    assert found(queries.QUERIES["op13_chat_format"](spark, sf)) == want(rows + extra)


def branching(seed=5, chats=300):
    rng = random.Random(seed)
    rows = []
    for conv_id in range(chats):
        turns = [("system", "You are one of two helpers." if rng.random() < 0.8 else f"Helper {conv_id}")]
        for i in range(rng.randint(0, 6)):
            turns.append((("user", "assistant")[i % 2], f"turn {i} says {rng.randint(0, 1)} " * rng.randint(1, 2)))
        rows += [(conv_id, n, role, text) for n, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity", [chatformat.CAPACITY, 300, 40])
def test_shared_turns_are_emitted_once(spark, capacity):
    rows = branching()
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chatformat.format_chats(docs, capacity=capacity)
    emitted, unshared = check_sequences(made.collect(), capacity)
    assert found(chatformat.read_back(made)) == want(rows)
    if capacity == chatformat.CAPACITY:
        assert emitted < unshared / 2


def test_every_node_once_in_one_task(spark):
    rows = branching()
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        made = chatformat.format_chats(docs, capacity=1 << 30).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    chats = {}
    for conv_id, turn, role, text in sorted(rows):
        chats.setdefault(conv_id, []).append((role, text))
    distinct = {tuple(turns[:n]) for turns in chats.values() for n in range(1, len(turns) + 1)}
    assert len(made) == 1 and len(made[0]["nodes"]) == len(distinct)


def test_conversations_longer_than_a_sequence(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], f"turn {n} </s> of a long conversation") for n in range(400)]
    rows += [(2, n, "user", f"turn {n} </s> of a long conversation") for n in range(3)] + [(3, 0, "user", "word " * 500)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chatformat.format_chats(docs, capacity=100)
    sequences = made.collect()
    check_sequences(sequences, 100)
    parts = sorted((c["part"], c["last"], r["position_ids"][0], len(r["tokens"])) for r in sequences for c in r["conversations"] if c["conv_id"] == 1)
    assert len(parts) > 40 and [p[1] for p in parts] == [False] * (len(parts) - 1) + [True]
    assert [p[2] for p in parts] == np.cumsum([0, *[p[3] for p in parts[:-1]]]).tolist()
    assert found(chatformat.read_back(made)) == want(rows)
    stored = spark.createDataFrame(sequences, made.schema).repartition(7)
    assert found(chatformat.read_back(chatformat.in_order(stored))) == want(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "no role"), (1, None, "assistant", "last <s>"), (1, 1, "assistant", "same turn"),
        (None, 0, "user", "no id"), (None, None, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", ""),
        (3, 0, "[INST]", "\\ <|endoftext|> \U0001d11e\u0000"), (4, 0, "user", "x" * 200_000), (5, 0, "user", "no id"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    docs = spark.createDataFrame([(*r, 1, b"p", 2) for r in rows], schema + ", hash long, path binary, unnumbered int")
    assert found(chatformat.read_back(chatformat.format_chats(docs))) == want(rows)
    assert chatformat.read_back(chatformat.format_chats(docs.limit(0))).collect() == []


def test_decoder():
    files = packing.tokenizer_files()
    for text in ("plain", "é𝄞 \n\n  x", "<|endoftext|>"):
        assert packing.decoder(*files)(packing.encoder(*files)(text)) == text
