import random
import re

from mnemospark.llm.leakage import find_leaks, tile

D, I = "doc_id long, text string", "item_id long, text string"


def brute(docs, items):
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for d, t in docs:
        w = split(t or "")
        for i, x in items:
            v = split(x or "")
            k = min(13, len(v))
            if d is not None and i is not None and k and {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}:
                out.add((d, i))
    return out


def found(spark, docs, items, **kw):
    r = find_leaks(spark.createDataFrame(docs, D).selectExpr("*", "1 AS item_id", "2 AS longest"), spark.createDataFrame(items, I), **kw)
    return {(x["doc_id"], x["item_id"]) for x in r.collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["Straße", "été", "x_y", "don't"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 13, 14, 40]))) for i in range(30)] + [(90, ""), (91, None), (None, "a b"), (92, "...")]
    docs = []
    for d in range(120):
        t = text(60)
        if d % 3 == 0:
            src = rng.choice(items[:30])[1].split(" ")
            a = rng.randint(0, max(0, len(src) - 13))
            t = f"{t} {' '.join(src[a : a + rng.randint(11, 15)]).upper()}, {text(20)}"
        docs.append((d, t))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[2][1]), (502, items[2][1]), (503, text(40_000) + " " + items[5][1])]
    want = brute(docs, items)
    assert len(want) > 20 and found(spark, docs, items) == want


def test_empty(spark):
    assert found(spark, [], [(1, "a b")]) == set() and found(spark, [(1, "a b")], []) == set()


def test_tiles_are_longest_first_and_do_not_overlap():
    item = list(range(1, 21))
    doc = [*range(11, 21), 99, *range(1, 11), 99, *range(5, 9)]
    tiles = tile(doc, item, 3)
    assert sorted(t[2] for t in tiles) == [10, 10] and tile(doc, item, 11) == []


def test_reordered_passage(spark):
    words = [f"k{i}" for i in range(40)]
    item = " ".join(words)
    moved = " ".join(words[20:] + ["other"] + words[:20])
    r = find_leaks(spark.createDataFrame([(1, moved)], D), spark.createDataFrame([(7, item)], I)).first()
    assert r["longest"] == 20 and r["covered"] == 40 and r["leaked"]


def test_filter_never_drops(spark):
    """A filter that is far too small lets more pass, but the result stays."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randint(0, 50)}" for _ in range(n))
    items = [(i, text(30)) for i in range(40)]
    docs = [(d, text(30) + " " + rng.choice(items)[1][:90] + " " + text(9)) for d in range(60)]
    want = brute(docs, items)
    assert len(want) > 20 and found(spark, docs, items, filter_bits=8) == want
