import random

import pytest

from mnemospark.llm.components import connected_components
from mnemospark.llm.conversations import assign_conversations, judge_conversations, message_links, message_rows, rebuild_conversations

SCHEMA = "id string, conversation_id string, role string, content string, metadata string, created_at long"
T0 = 1_700_000_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def reasons(df):
    return {r["conversation_id"]: r["reason"] for r in judge_conversations(df).collect()}


def test_reasons(spark):
    rows = [
        ("a1", "ok", "user", "hi", None, T0), ("a2", "ok", " Assistant", "yo", None, T0 + 1),
        ("b1", "role", "user", "hi", None, T0), ("b2", "role", "robot", "x", None, T0 + 1), ("b3", "role", "ai", "x", None, T0 + 2),
        ("c1", "nullrole", None, "hi", None, T0),
        ("d1", "empty", "system", "hi", None, T0),
        ("e1", "blank", "user", " ​﻿\n", None, T0), ("e2", "blank", "robot", None, None, T0),
        ("f1", "start", "assistant", "hi", None, T0),
        ("g1", "end", "human", "hi", None, T0),
        ("h1", "reply", "user", "hi", None, T0), ("h2", "reply", "user", "hi", None, T0 + 1), ("h3", "reply", "ai", "x", None, T0 + 2),
        ("i1", "tool", "user", "hi", None, T0), ("i2", "tool", "tool", "r", None, T0 + 1), ("i3", "tool", "assistant", "x", None, T0 + 2),
        ("j1", "seconds", "user", "hi", None, T0 // 1000), ("j2", "seconds", "ai", "x", None, T0 + 1),
        ("k2", "tie", "assistant", "x", None, T0), ("k1", "tie", "user", "hi", None, T0),
        ("l1", "late", "user", "hi", None, T0), ("l2", "late", "ai", "x", None, T0 + 5), ("l1", "late", "user", "hi", None, T0 + 9),
        ("m1", None, "robot", "x", None, T0), ("m2", "", "robot", "x", None, T0), (None, "nulls", None, None, None, None),
    ]
    got = reasons(frame(spark, rows))
    assert got == {"ok": None, "role": "role", "nullrole": "role", "empty": "empty", "blank": "empty", "start": "start", "end": "end", "reply": "reply", "tool": None, "seconds": None, "tie": None, "late": None, "nulls": "empty"}


def test_against_plain_loop_over_parts(spark):
    """A conversation that is spread over several parts is judged like one in one piece."""
    rng = random.Random(3)
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 5, 400 if c == 7 else 9])
        for i in range(n):
            role = ("user", "assistant")[i % 2] if rng.random() < 0.99 else "user"
            rows.append((f"{c}-{i:05d}", f"c{c}", role, "x", None, T0 + i // 2))
    rng.shuffle(rows)
    want = {}
    for c in range(40):
        own = [r[2] for r in sorted((r for r in rows if r[1] == f"c{c}"), key=lambda r: (r[5], r[0]))]
        bad = own[0] != "user" or own[-1] != "assistant" or any(a == b == "user" for a, b in zip(own, own[1:]))
        want[f"c{c}"] = bad
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        assert {k: v is not None for k, v in reasons(frame(spark, rows)).items()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_links(spark):
    rows = [
        ("a", None, "user", "hi", None, T0), ("b", None, "ai", "x", '{"reply_to": "a"}', T0 + 1), ("c", None, "user", "y", '{"quote_of": "b"}', T0 + 2), ("d", None, "ai", "z", '{"reply_to": "c"}', T0 + 3),
        ("e", None, "user", "alone", "{broken", T0), ("f", "named", "user", "q", None, T0), ("g", None, "ai", "r", '{"in_reply_to": "f"}', T0 + 1),
    ]
    df = frame(spark, rows)
    got = {r["id"]: r["conversation_id"] for r in assign_conversations(message_rows(df), message_links(df)).collect()}
    assert got == {"a": "link:a", "b": "link:a", "c": "link:a", "d": "link:a", "e": None, "f": "named", "g": "named"}
    turns = rebuild_conversations(df).orderBy("conversation_id", "turn").collect()
    assert [(r["conversation_id"], r["turn"], r["role"], r["content"]) for r in turns] == [("link:a", 1, "user", "hi"), ("link:a", 2, "assistant", "x"), ("link:a", 3, "user", "y"), ("link:a", 4, "assistant", "z"), ("named", 1, "user", "q"), ("named", 2, "assistant", "r")]
    alone = {r["id"]: r["conversation_id"] for r in assign_conversations(message_rows(df), message_links(df), adopt=False).collect()}
    assert alone["g"].startswith("link:")


def test_empty_and_extra_columns(spark):
    assert reasons(frame(spark, [])) == {}
    df = frame(spark, [("a", "c", "user", "x" * 100_000, None, T0)]).selectExpr("*", "1 AS part", "2 AS blank", "3 AS at", "4 AS given")
    assert reasons(df) == {"c": "end"}
    assert rebuild_conversations(df).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):03d}", f"n{rng.randrange(60):03d}") for _ in range(45)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(30)] + [("x", None), ("y", "y")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(parent)}
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
