import json
import random
import sqlite3

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.errors import DimensionMismatch, InvalidArgument
from mnemospark.functions.distance import distance, distances, vector_literal
from mnemospark.operators import fulltext, graph, hybrid, sync, vector
from mnemospark.operators.filters import compile_filter, metadata_variant
from mnemospark.operators.porter import stem

# ---- distances and vector search ----


def test_distance_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = df.select(*[distance(F.col("a"), F.col("b"), m).alias(m) for m in ("cosine", "euclidean", "dot")]).collect()
    assert got[0]["cosine"] == 1.0 and got[0]["euclidean"] == 1.0 and got[0]["dot"] == 0.0
    assert abs(got[1]["cosine"]) < 1e-12 and got[1]["dot"] == -25.0
    assert got[2]["cosine"] is None and got[3]["dot"] is None
    with pytest.raises(InvalidArgument):
        distance(F.col("a"), F.col("b"), "hamming")
    assert distances(np.array([[0.0, 0.0]]), np.array([[1.0, 0.0]]), "cosine")[0, 0] == 1.0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>, metadata string")


def test_dot_and_cosine_orders(spark):
    df = vectors(spark, [("v_long", [4.0, 0.0], None), ("v_short", [0.5, 0.0], None), ("v_perp", [0.0, 1.0], None)])
    dot = vector.vector_search(df, [4.0, 0.0], 3, "dot").collect()
    assert [(r["id"], r["score"]) for r in dot[:2]] == [("v_long", -16.0), ("v_short", -2.0)]
    cos = vector.vector_search(df, [4.0, 0.0], 3).collect()
    assert [r["id"] for r in cos] == ["v_long", "v_short", "v_perp"] and cos[0]["score"] == cos[1]["score"]
    with pytest.raises(DimensionMismatch):
        vector.vector_search(df, [1.0], dim=2)


def test_overfetch_may_return_fewer(spark):
    rows = [(f"n{i:03d}", [1.0, i / 1000], '{"t": 1}') for i in range(60)] + [(f"far{i}", [0.0, 1.0], '{"t": 2}') for i in range(5)]
    df = vectors(spark, rows)
    assert vector.vector_search(df, [1.0, 0.0], 3, filter={"t": 2}).count() == 3
    assert vector.vector_search(df, [1.0, 0.0], 3, filter={"t": 2}, mode="overfetch").count() == 0


def test_knn_join_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((150, 8)).astype("f4")
    df = vectors(spark, [(f"{i:03d}", [float(t) for t in v], None) for i, v in enumerate(x)] + [("none", None, None)])
    for metric in ("cosine", "euclidean", "dot"):
        d = distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        got = vector.knn_join(df, df, 4, metric, block=40).collect()
        assert len(got) == 600
        for q in range(150):
            assert [int(r["id"]) for r in sorted((r for r in got if int(r["query_id"]) == q), key=lambda r: r["rank"])] == d[q].argsort(kind="stable")[:4].tolist()


def test_list_index_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)) + rng.integers(0, 8, (1500, 1)) * 2
    df = vectors(spark, [(f"{i:04d}", [float(t) for t in v], None) for i, v in enumerate(x)])
    index = vector.ListIndex(df, lists=24)
    hit = {p: 0 for p in (1, 12)}
    for q in range(0, 300, 30):
        exact = {r["id"] for r in vector.vector_search(df, x[q].tolist(), 10).collect()}
        for p in hit:
            hit[p] += len(exact & {r["id"] for r in index.search(x[q].tolist(), 10, probes=p).collect()})
    assert hit[12] >= 95 and hit[1] < hit[12]


def test_upsert(spark):
    old = spark.createDataFrame([("a", "m", 1), ("b", "m", 1)], "id string, metadata string, created_at long")
    new = spark.createDataFrame([("a", None, 9), ("c", "x", 8), ("c", "y", 9)], "id string, metadata string, created_at long")
    got = {tuple(r) for r in vector.upsert(old, new, ["id"], F.col("created_at")).collect()}
    assert got == {("a", None, 1), ("b", "m", 1), ("c", "y", 9)}


# ---- filters ----

DOCS = [None, "{bad", "1", "[]", '{"a": 1}', '{"a": 1.0}', '{"a": "1"}', '{"a": null}', '{"a": true}', '{"a": [1, 2]}', '{"a": {"b": 2}}', '{"a": "hello world"}', '{"b": 5}', '{"a": 3, "b": "x"}', '{"a": -2.5}', '{"a": {"b": null}}', '{"a": [{"b": 1}]}']
_MISSING = object()


def get(meta, field):
    for p in field.split("."):
        if not isinstance(meta, dict) or p not in meta:
            return _MISSING
        meta = meta[p]
    return meta


def same(x, v):
    if x is _MISSING or type(x) is not type(v):
        return False
    if isinstance(x, list):
        return len(x) == len(v) and all(map(same, x, v))
    if isinstance(x, dict):
        return x.keys() == v.keys() and all(same(x[k], v[k]) for k in x)
    return x == v


def op(x, o, v):
    import re

    num = lambda t: isinstance(t, (int, float)) and not isinstance(t, bool)
    if o == "$eq":
        return same(x, v)
    if o == "$ne":
        return not same(x, v)
    if o == "$exists":
        return (x is not _MISSING) == (v if isinstance(v, bool) else True)
    if o in ("$gt", "$gte", "$lt", "$lte"):
        return num(x) and num(v) and {"$gt": x > v, "$gte": x >= v, "$lt": x < v, "$lte": x <= v}[o]
    if o == "$in":
        return isinstance(v, list) and any(same(x, t) for t in v)
    if o == "$nin":
        return not (isinstance(v, list) and any(same(x, t) for t in v))
    if o == "$contains":
        return isinstance(x, str) and isinstance(v, str) and v in x
    if o == "$regex":
        try:
            return isinstance(x, str) and isinstance(v, str) and bool(re.search(v, x))
        except re.error:
            return False
    return False


def matches(meta, spec):
    if not isinstance(spec, dict):
        return False
    for k, v in spec.items():
        if k == "$and":
            ok = isinstance(v, list) and all(matches(meta, s) for s in v)
        elif k == "$or":
            ok = isinstance(v, list) and any(matches(meta, s) for s in v)
        elif k == "$not":
            ok = not matches(meta, v)
        elif isinstance(v, dict):
            ok = all(op(get(meta, k), o, t) for o, t in v.items())
        else:
            ok = same(get(meta, k), v)
        if not ok:
            return False
    return True


VALUES = st.sampled_from([1, 1.0, "1", None, True, 3, -2.5, "hello", [1, 2], 2, "x"])
OPS = st.dictionaries(st.sampled_from(["$eq", "$ne", "$exists", "$gt", "$gte", "$lt", "$lte", "$contains", "$regex", "$what"]), st.sampled_from([1, 1.0, "l", None, True, False, 2, "^h.*d$", "("]), max_size=2) | st.dictionaries(st.sampled_from(["$in", "$nin"]), st.lists(VALUES, max_size=3) | VALUES, max_size=2)
SPEC = st.recursive(
    st.dictionaries(st.sampled_from(["a", "b", "a.b", "c"]), VALUES | OPS, max_size=2),
    lambda s: st.fixed_dictionaries({}, optional={"$and": st.lists(s, max_size=2) | VALUES, "$or": st.lists(s, max_size=2), "$not": s | VALUES, "a": VALUES}),
    max_leaves=4,
)


@pytest.fixture(scope="module")
def metas(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "i int, m string").coalesce(1).cache()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spec=SPEC)
def test_filter_against_evaluator(metas, spec):
    want = set()
    for i, d in enumerate(DOCS):
        try:
            meta = json.loads(d) if d is not None else None
        except ValueError:
            continue
        if d is not None and matches(meta, spec):
            want.add(i)
    rows = metas.select("i", compile_filter(spec, metadata_variant(F.col("m"))).alias("ok")).collect()
    assert all(r["ok"] is not None for r in rows)
    assert {r["i"] for r in rows if r["ok"]} == want, spec


# ---- graph ----


def paths(edges, start, depth, least):
    best = {}

    def go(node, d, seen):
        for s, t, w in edges:
            if s == node and w >= least and (d == 0 or t not in seen) and d < depth:
                k = best.setdefault(t, [d + 1, w])
                k[0], k[1] = min(k[0], d + 1), max(k[1], w)
                go(t, d + 1, seen | {t})

    go(start, 0, {start})
    return {k: tuple(v) for k, v in best.items()}


def test_walk_against_enumeration(spark):
    rng = random.Random(0)
    for trial in range(4):
        edges = sorted({(rng.choice("abcdef"), rng.choice("abcdef"), "r", rng.randint(-2, 9) / 10) for _ in range(12)})
        df = spark.createDataFrame(edges, "src string, dst string, relation string, weight double")
        depth = trial + 1
        want = paths([(s, t, w) for s, t, _, w in edges], "a", depth, 0.0)
        got = {r["id"]: (r["depth"], r["weight"]) for r in graph.walk(df, ["a"], depth).collect()}
        assert got == want
        bfs = {r["id"]: r["depth"] for r in graph.walk(df, ["a"], depth, mode="bfs").collect()}
        assert {k: v for k, v in bfs.items() if k != "a"} == {k: v[0] for k, v in want.items() if k != "a"}


def test_walk_rules(spark):
    df = spark.createDataFrame([("s", "s", "r", 0.4), ("s", "x", "r", -0.1), ("s", "y", "q", 0.9), ("y", "s", "r", 1.0), ("y", None, "r", 1.0)], "src string, dst string, relation string, weight double")
    assert {(r["id"], r["depth"]) for r in graph.walk(df, ["s"], 0).collect()} == {("s", 1), ("y", 1)}
    assert {r["id"] for r in graph.walk(df, ["s"], 3, min_weight=-1.0).collect()} == {"s", "x", "y"}
    assert {r["id"] for r in graph.walk(df, ["s"], 3, relation="q").collect()} == {"y"}
    assert graph.walk(df, ["nobody"], 3).count() == 0


# ---- full text ----

TEXTS = {"d1": "The quick brown fox jumps over the lazy dog", "d2": "A fast red car and a cat", "d3": "The runners are running in the race, quick!", "d4": "quick quick fox_trot and re-run d1", "d5": "été ÉTÉ Straße 42", "d6": "", "d7": "the the the fox", "d8": "foxes are relational, hopping happily"}
QUERIES = ["fox", "quick fox", "quick OR car", "quick NOT fox", '"quick fox"', '"brown fox"', "run", "running race", "qui*", "fo* car", "d1", "text : d1", "vec_id : d1", "the", "NEAR(quick dog, 8)", "NEAR(quick dog, 5)", "(fox OR car) NOT lazy", "été", "ÉTÉ", "42", "fox AND quick OR cat", "^the", "quick + brown", '"re-run"', "missing", "relate*", "happy hops", "fox trot"]


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(vec_id, collection_id UNINDEXED, text, tokenize='porter ascii')")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without FTS5")
    db.executemany("INSERT INTO t VALUES (?, 'c', ?)", TEXTS.items())
    return db


@pytest.fixture(scope="module")
def index(spark):
    return fulltext.TextIndex(spark.createDataFrame(list(TEXTS.items()), "id string, text string"))


@pytest.mark.parametrize("query", QUERIES)
def test_search_against_sqlite(fts, index, query):
    want = {r[0]: r[1] for r in fts.execute("SELECT vec_id, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    got = {r["doc_id"]: r["rank"] for r in index.search(query, None).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


@pytest.mark.parametrize("query", ["", "a-b", '"open', "AND", "fox AND", "(fox", "no_such : fox", "fox NOT"])
def test_bad_queries(index, query):
    with pytest.raises(InvalidArgument):
        index.search(query)


def test_stems_against_sqlite():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
        db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without FTS5")
    roots = "relat condit rat valenc digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit triplic electr good reviv allow infer airlin gyroscop adjust defens irrit replac depend adopt commun activ angular homolog effect bowdler prob ceas control rol hop tann fall hiss fizz fail fil happy sky".split()
    ends = "s es ed ing ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize y eed".split()
    words = sorted({r + e for r in roots for e in [*ends, ""]})
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words, 1))
    want = {words[doc - 1]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert {w: stem(w) for w in words} == want


def test_snippets():
    text = "one two three four five six seven eight nine ten eleven quick brown fox twelve"
    terms = [(["quick"], False), (["fox"], False)]
    s = fulltext.snippet(text, terms)
    assert "<b>quick</b> brown <b>fox</b>" in s and s.startswith("...")
    assert fulltext.snippet("quick fox", [(["quick", "fox"], False)]) == "<b>quick fox</b>"
    assert fulltext.snippet("", terms) == ""


def test_saved_index(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = fulltext.TextIndex.open(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.search("quick fox", None).collect())) == sorted(map(tuple, index.search("quick fox", None).collect()))


def test_message_search_keeps_global_statistics(spark):
    m = spark.createDataFrame([("m1", "c1", "user", "alpha beta"), ("m2", "c2", "user", "alpha"), ("m3", "c1", "user", "gamma"), ("m4", "c1", "user", "delta")], "id string, conversation_id string, role string, content string")
    both = {r["id"]: r["rank"] for r in fulltext.search_messages(m, "alpha").collect()}
    one = {r["id"]: r["rank"] for r in fulltext.search_messages(m, "alpha", conversation_id="c1").collect()}
    assert set(both) == {"m1", "m2"} and one == {"m1": both["m1"]} and fulltext.search_messages(m, "m1").count() == 0


# ---- hybrid ----


def bias(i):
    return [0.9 if k == i else 0.1 for k in range(4)]


@pytest.fixture(scope="module")
def modal(spark):
    v = vectors(spark, [(f"d{i + 1}", bias(i), json.dumps({"n": i})) for i in range(4)])
    e = spark.createDataFrame([("anchor", "d1", "r", 0.9), ("anchor", "d3", "r", 0.7), ("d1", "d2", "r", 0.5), ("d1", "ghost", "r", 0.2)], "src string, dst string, relation string, weight double")
    t = spark.createDataFrame([("d1", "rust programming language systems"), ("d2", "python machine learning data science"), ("d3", "rust async tokio runtime"), ("d4", "sql database query optimization")], "id string, text string")
    return v, e, fulltext.TextIndex(t)


def test_bimodal(modal):
    v, e, _ = modal
    got = hybrid.hybrid_query(v, e, bias(0), "anchor", 0.4, 2, 10).collect()
    assert got[0]["id"] == "d1" and got[0]["score"] == pytest.approx(0.4 + 0.6 * 0.9) and "ghost" not in {r["id"] for r in got}


def test_trimodal(modal):
    v, e, t = modal
    got = {r["id"]: r for r in hybrid.tri_modal_query(v, e, t, bias(0), "anchor", "rust", 0.4, 0.3, 0.3).collect()}
    assert "ghost" in got and got["ghost"]["vector_score"] is None and got["ghost"]["graph_score"] == 0.0
    assert got["d1"]["score"] == max(r["score"] for r in got.values())
    assert {r["id"] for r in hybrid.tri_modal_query(v, e, t, bias(0), "anchor", "rust", 0.4, 0.3, 0.3, filter={"n": 3}).collect()} >= {"d1", "d2", "d3", "d4", "ghost"}
    with pytest.raises(InvalidArgument):
        hybrid.tri_modal_query(v, e, t, alpha=0.5, beta=0.5, gamma=0.5)


def test_single_hits(modal):
    v, e, t = modal
    one = hybrid.tri_modal_query(None, None, t, (), "", "tokio", 0.0, 0.0, 1.0).collect()
    assert [(r["id"], r["score"]) for r in one] == [("d3", 0.0)]
    single = hybrid.tri_modal_query(v.filter("id = 'd1'"), None, None, bias(0), alpha=1.0, beta=0.0, gamma=0.0).collect()
    assert [(r["id"], r["score"]) for r in single] == [("d1", 1.0)]
    assert hybrid.tri_modal_query(None, None, t, (), "", '"broken', 0.0, 0.0, 1.0).count() == 0


def test_literal(spark):
    assert spark.range(1).select(vector_literal([1, 2.5]).alias("v")).first()["v"] == [1.0, 2.5]


@pytest.mark.parametrize("seed", range(6))
def test_exact_walk_against_enumeration(spark, seed):
    """On random graphs with loops, parallel edges and a hub, to any depth."""
    rng = random.Random(seed)
    n = 9
    rows = [(str(rng.randrange(n)), str(rng.randrange(n)), rng.choice("xy"), round(rng.uniform(-0.2, 1), 2)) for _ in range(22)] + [("0", str(i), "x", 0.1 * i) for i in range(1, n, 2)] + [(str(i), "0", "y", 0.9) for i in range(1, n, 3)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, weight double")
    starts = spark.createDataFrame([(str(i),) for i in range(n)], "start string")
    for depth in (1, 2, 4):
        one, two = ({tuple(r) for r in graph.walk(edges, starts, depth, mode=m).collect()} for m in ("exact", "paths"))
        assert one == two


def test_pending_of_peers_by_one_order(spark):
    log = spark.createDataFrame([(i // 3,) for i in range(30)], "hlc_ts long")
    peers = spark.createDataFrame([("a", None, 0), ("b", "x", 4), ("c", None, 99), ("d", None, None), ("e", None, 4)], "peer_id string, endpoint string, last_synced_hlc long")
    assert [r["ops_pending"] for r in sync.sync_status(log, peers).collect()] == [27, 15, 0, 0, 15]
