import random
from collections import defaultdict
from itertools import combinations

import pytest

from mnemospark.llm.spans import SharedSpans

D = "doc_id long, text string"


def brute(docs, least):
    places, texts = defaultdict(set), defaultdict(set)
    for d, t in docs:
        if d is not None and t:
            texts[d].add(t)
            for j in range(len(t) - least + 1):
                places[t[j : j + least]].add(d)
    pairs, shared = set(), {}
    for s in places.values():
        pairs |= set(combinations(sorted(s), 2))
    for d, ts in texts.items():
        n = 0
        for t in ts:
            mark = bytearray(len(t))
            for j in range(len(t) - least + 1):
                if len(places[t[j : j + least]]) > 1:
                    mark[j : j + least] = b"\1" * least
            n += sum(mark)
        if any(len(t) >= least for t in ts):
            shared[d] = n
    return pairs, shared


def check(spark, docs, least, **kw):
    s = SharedSpans(spark.createDataFrame(docs, D).selectExpr("*", "1 AS key", "2 AS h1", "3 AS pos"), least, **kw)
    want, shared = brute(docs, least)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["doc_id"]: r["shared_chars"] for r in s.report().collect()} == shared
    return want


def made(seed, n=60, least=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefghij éß😀\n") for _ in range(k))
    docs = []
    for d in range(n):
        t = text(rng.randint(0, 300))
        if docs and rng.random() < 0.5:
            src = rng.choice(docs)[1]
            a, k = rng.randint(0, max(0, len(src) - least)), rng.choice([least - 1, least, least + 1, 150])
            at = rng.randint(0, len(t))
            t = t[:at] + src[a : a + k] + t[at:]
        docs.append((d, t))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    assert len(check(spark, made(seed), 60)) > 5


def test_hot_passages_dealt_out(spark):
    rng = random.Random(9)
    body = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    brief, short = body(75), body(52)
    docs = [(i, body(40) + (brief if i % 2 else short) + body(40)) for i in range(40)]
    want = check(spark, docs, 60, per_task=3)
    assert len(want) == 20 * 19 // 2


def test_dirty(spark):
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(30_000))
    docs = [(1, None), (2, ""), (None, long), (3, long), (3, long), (4, long), (5, long[100:] + "x"), (6, "a" * 500), (7, "a" * 300), (8, "short")]
    check(spark, docs, 60)
    check(spark, [], 60)


def test_whole_lengths(spark):
    docs = made(11, 30, 400)
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ,.") for _ in range(2000))
    docs += [(100, base), (101, base[:400]), (102, "q" + base[700:1099] + "z"), (103, "zz" + base[1000:1401]), (104, base[1500:1900] + base[:399])]
    assert {(100, 101), (100, 103), (100, 104)} <= check(spark, docs, 400)
