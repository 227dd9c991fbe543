import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.operators.changes import BucketedTable, reduce_changes
from mnemospark.operators.nested import _parse_deep, flatten_json, parse_json, read_table, store_json_rows, visit, write_tables
from mnemospark.operators.orphans import count_orphans, find_orphans, references
from mnemospark.operators.ranking import latest_rows, spread_row_number

# ---- nested records ----


def rows_of(spark, texts, extra=()):
    df = spark.createDataFrame(list(texts.items()), "id string, j string")
    for i, name in enumerate(extra):
        df = df.withColumn(name, F.lit(i))
    return flatten_json(df, "t", F.col("id"), "j").collect()


def objects(text):
    """Paths of the objects that are elements of arrays, recursively."""
    out = []

    def walk(x, path, element):
        if isinstance(x, dict):
            if element:
                out.append(path)
            for k, v in x.items():
                walk(v, f"{path}.{k}", False)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]", True)

    walk(text, "$", False)
    return out


def random_json(rng, depth=0):
    r = rng.random()
    if depth > 5 or r < 0.25:
        return rng.choice([1, 1.5, "x", None, True, 'q"uote', "é", -3])
    if r < 0.6:
        return {rng.choice("abc.d") * rng.randint(1, 2): random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def test_paths_and_links(spark):
    rng = random.Random(1)
    values = {f"r{i}": random_json(rng) for i in range(300)}
    got = rows_of(spark, {k: json.dumps(v) for k, v in values.items()}, ("tag", "path", "kind", "json"))
    for k, v in values.items():
        own = [r for r in got if r["record_id"] == k]
        if isinstance(v, str):
            continue
        assert sorted(r["path"] for r in own if r["kind"] == "object") == sorted(objects(v))
        keys = {r["pk"] for r in own}
        assert len(keys) == len(own) and all(r["parent_pk"] in keys for r in own if r["kind"] != "root")
        assert sum(r["kind"] == "root" for r in own) == 1


def test_validity(spark):
    bad = ["", " ", "{", "[1,]", '{"a":1,}', "NaN", "[Infinity]", "{'a':1}", "[01]", '["\n"]', "[1] x", None, '"[1"', "﻿[]"]
    good = [' [ {"a": [ {} ] } ] ', json.dumps(json.dumps([{"a": 1}])), '[{"n": ' + "9" * 5000 + "}]", "[{}]", '[{"x": 1e999}]']
    got = rows_of(spark, {f"b{i}": t for i, t in enumerate(bad)} | {f"g{i}": t for i, t in enumerate(good)})
    assert {r["record_id"] for r in got} == {f"g{i}" for i in range(len(good))}
    assert all(any(r["kind"] == "object" for r in got if r["record_id"] == f"g{i}") for i in range(len(good)))
    twice = rows_of(spark, {"x": json.dumps({"inner": json.dumps([{"a": 1}])})})
    assert [r["kind"] for r in twice] == ["root"]


def test_very_deep(spark):
    deep = "[" * 50_000 + "{}" + "]" * 50_000
    r = [x for x in rows_of(spark, {"d": deep}) if x["kind"] == "object"]
    assert len(r) == 1 and r[0]["path"] == "$" + "[0]" * 50_000


def test_deep_parser_agrees():
    rng = random.Random(2)
    for _ in range(300):
        v = random_json(rng)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert json.dumps(_parse_deep(text)).replace('"', "") == json.dumps(v).replace('"', "")
        broken = text[: rng.randint(0, len(text))] + rng.choice(["", ",", "]", "}", ":"])
        try:
            json.loads(broken)
        except ValueError:
            with pytest.raises(ValueError):
                _parse_deep(broken)
    assert parse_json("[1]") == [1]


def test_tables(spark, tmp_path):
    texts = {"a": '{"name": "x", "steps": [{"n": 1, "tools": [{"t": "p"}, 5]}, {"n": 2}], "o": {"p": {"q": 7}}}'}
    df = spark.createDataFrame(list(texts.items()), "id string, j string")
    write_tables(flatten_json(df, "w", F.col("id"), "j"), str(tmp_path / "t"))
    steps = read_table(spark, str(tmp_path / "t"), "w.steps", T.StructType([T.StructField("n", T.IntegerType())])).orderBy("path").collect()
    assert [(r["data_n"], r["parent_pk"]) for r in steps] == [(1, "w=a"), (2, "w=a")]
    tools = read_table(spark, str(tmp_path / "t"), "w.steps.tools", T.StructType([T.StructField("t", T.StringType()), T.StructField("value", T.IntegerType())])).orderBy("path").collect()
    assert [(r["data_t"], r["data_value"], r["parent_pk"]) for r in tools] == [("p", None, "w=a#$.steps[0]"), (None, 5, "w=a#$.steps[0]")]
    root = read_table(spark, str(tmp_path / "t"), "w", T.StructType([T.StructField("name", T.StringType()), T.StructField("o.p.q", T.IntegerType())])).first()
    assert root["data_o.p.q"] == 7


def test_newest_state_and_empty(spark):
    v = spark.createDataFrame([("i", "c", "[{}]", 1, 5), ("i", "c", "{}", 1, 9), ("i", "c", "{}", 1, 9), (None, None, "[{}]", 1, 1)], "id string, collection_id string, metadata string, created_at long, updated_at long")
    n = spark.createDataFrame([], "id string, data string, created_at long, updated_at long")
    w = spark.createDataFrame([("w", None, 1, 1)], "id string, input string, created_at long, updated_at long")
    got = store_json_rows(v, n, w).collect()
    assert {(r["record_id"], r["path"]) for r in got if r["kind"] == "object"} == {(None, "$[0]")}


# ---- references ----


def orphan_rows(spark, refs, targets, deleted, heavy_keys=2000, heavy_from=1000):
    r = spark.createDataFrame(refs, "k string, src string, at long, extra string").withColumn("target", F.lit("own")).withColumn("period", F.lit("own"))
    x = references(r, "s", "src", F.col("k"), "T", F.col("at"))
    t = spark.createDataFrame(targets, "target string, id string, created_at long")
    d = spark.createDataFrame(deleted, "target string, id string")
    return find_orphans(x, t, d, heavy_keys, heavy_from)


JAN, FEB = 1_736_000_000_000, 1_739_000_000_000


@pytest.mark.parametrize(("heavy_keys", "heavy_from"), [(2000, 1000), (2000, 1), (1, 1), (2000, 100)])
def test_orphans(spark, heavy_keys, heavy_from):
    refs = [("1", "a", JAN, ""), ("2", " A ", JAN, ""), ("3", "b", JAN, ""), ("4", "late", JAN, ""), ("5", "late", FEB, ""), ("6", "gone", None, ""), ("7", "", JAN, ""), ("8", None, JAN, ""), ("3", "b", JAN, ""), (None, "b", JAN, ""), ("9", "　b\t", 10**18, "")]
    refs += [(f"h{i}", "hot", JAN + i, "") for i in range(200)]
    got = {tuple(r)[2:] for r in orphan_rows(spark, refs, [("T", "a", JAN), ("T", "a", FEB), ("T", "late", JAN + 1), ("T", "late", FEB), ("U", "b", 1)], [("T", "gone"), ("T", "a"), ("U", "b")], heavy_keys, heavy_from).collect()}
    want = {("3", "b", "2025-01", "missing"), (None, "b", "2025-01", "missing"), ("9", "b", "unknown", "missing"), ("4", "late", "2025-01", "late"), ("6", "gone", "unknown", "deleted")}
    assert got == want | {(f"h{i}", "hot", "2025-01", "missing") for i in range(200)}


def test_orphan_counts_and_empty(spark):
    got = orphan_rows(spark, [("1", "x", JAN, ""), ("2", "x", FEB, ""), ("3", "x", FEB, "")], [], [])
    assert {(r["period"], r["reason"], r["n"]) for r in count_orphans(got).collect()} == {("2025-01", "missing", 1), ("2025-02", "missing", 2)}
    assert orphan_rows(spark, [], [("T", "a", 1)], []).count() == 0


# ---- changes ----

FEED = "id string, timestamp long, action string, table_name string, record_id string, new_value string, reason string"


def fold(entries):
    """The table after all changes, one by one in order."""
    state = {}
    for e in sorted(set(entries), key=lambda e: (e[1], -1 if e[5] is None else json.loads(e[5])["rev"], e[0])):
        key, act = (e[3], e[4]), e[2].strip().lower()
        if act == "delete":
            state.pop(key, None)
        elif act in ("insert", "update") and e[5] is not None and (act == "insert" or key in state):
            state[key] = e[0], e[5]
    return {(*k, *v) for k, v in state.items()}


def made_feed(seed, n=600):
    rng = random.Random(seed)
    out, rev = [], {}
    for i in range(n):
        key = "hot" if rng.random() < 0.3 else f"r{rng.randrange(40)}"
        rev[key] = rev.get(key, 0) + 1
        act = rng.choice(["insert", "update", "update ", " UPDATE", "delete", "Read", "touch"])
        value = None if act in ("delete", "touch") or rng.random() < 0.1 else json.dumps({"rev": rev[key]})
        out.append((f"e{i:04d}", 1000 + i // 3 if act != "delete" else 1000 + i // 3, act, rng.choice("xy"), key, value))
    return out


def applied(spark, path, batches, buckets=8):
    table = BucketedTable(spark, path, ["table_name", "record_id"], buckets)
    rev = F.get_json_object("new_value", "$.rev").cast("int")
    for batch in batches:
        df = spark.createDataFrame([(*e, "why") for e in batch], FEED).withColumn("removed", F.lit(1)).withColumn("_act", F.lit(2))
        table.apply(reduce_changes(df, table.keys, "id", "action", "new_value", [F.col("timestamp"), rev]))
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_in_any_batches_and_order(spark, tmp_path, seed):
    feed = made_feed(seed)
    want = fold(feed)
    one = applied(spark, str(tmp_path / "one"), [feed])
    assert {tuple(r) for r in one.read().collect()} == want
    rng = random.Random(seed)
    late = feed + rng.sample(feed, 50)
    rng.shuffle(late)
    cuts = [late[i::4] for i in range(4)] + [late[:20], []]
    many = applied(spark, str(tmp_path / "many"), cuts)
    assert {tuple(r) for r in many.read().collect()} == want and many.manifest()["version"] == 6


def test_only_touched_buckets_are_replaced(spark, tmp_path):
    table = applied(spark, str(tmp_path / "t"), [made_feed(3)], 8)
    before = table.manifest()["files"]
    applied(spark, str(tmp_path / "t"), [[("z", 9999, "insert", "x", "r1", '{"rev": 99}')]], 8)
    after = table.manifest()["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert ("x", "r1", "z", '{"rev": 99}') in {tuple(r) for r in table.read().collect()}


def test_nulls_in_feed(spark, tmp_path):
    feed = [("a", None, "insert", None, None, '{"rev": 1}'), ("b", 5, None, "x", "k", '{"rev": 1}'), (None, 6, "insert", "x", "k", '{"rev": 2}'), ("c", 7, "update", "x", "n", "not json")]
    got = {tuple(r) for r in applied(spark, str(tmp_path / "n"), [feed]).read().collect()}
    assert got == {(None, None, "a", '{"rev": 1}'), ("x", "k", None, '{"rev": 2}')}


# ---- ranking ----


def test_latest_and_row_numbers(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r["k"]: (r["v"], r["i"]) for r in latest_rows(df, ["k"], ["v"]).collect()}
    assert got == {k: max((v, i) for kk, v, i in rows if kk == k) for k in {r[0] for r in rows}}
    numbered = spread_row_number(df, ["k"], [F.col("v").desc(), F.col("i")], "n").collect()
    for k in {r[0] for r in rows}:
        own = sorted(((v, i) for kk, v, i in rows if kk == k), key=lambda t: (-t[0], t[1]))
        assert {(r["v"], r["i"]): r["n"] for r in numbered if r["k"] == k} == {t: n + 1 for n, t in enumerate(own)}


def test_store_walk_from_every_source(spark, tmp_path):
    """Against brute force, on a skewed edge table with older states, loops and edges without a source."""
    import random

    from mnemospark.plans.reference import QUERIES

    rng = random.Random(3)
    rows = [(rng.choice(["hub", f"n{rng.randint(0, 30)}"]), f"n{rng.randint(0, 30)}", rng.choice("ab"), rng.randint(-2, 9) / 10, k) for k in range(200)]
    rows += [(None, "n1", "a", 0.5, 1), (" ", "n1", "a", 0.5, 1), ("n1", None, "a", 0.5, 1), ("n2", "n2", "a", 0.3, 999)]
    spark.createDataFrame(rows, "src string, dst string, relation string, weight double, created_at long").write.parquet(f"{tmp_path}/edges.parquet")
    newest = {}
    for s, t, r, w, at in sorted(rows, key=lambda x: x[4]):
        newest[s, t, r] = w
    out = {}
    for (s, t, _), w in newest.items():
        if t is not None and w >= 0:
            out.setdefault(s, []).append((t, w))
    want = {}
    for s in out:
        if s is None or not s.strip():
            continue
        for t, w in out[s]:
            for i, depth, x in [(t, 1, w), *((u, 2, y) for u, y in out.get(t, []) if u not in (s, t))]:
                had = want.get((s, i), (9, -1.0))
                want[s, i] = min(had[0], depth), max(had[1], x)
    got = QUERIES["graph_store_walk"](spark, str(tmp_path)).collect()
    assert {(r["start"], r["id"]): (r["depth"], r["weight"]) for r in got} == want and len(got) == len(want)
    assert len({r["start"] for r in got}) > 3


def test_changes_query_merges_into_a_base(spark, tmp_path, monkeypatch):
    from mnemospark.plans import problems

    rows = [(f"a{i:03d}", "t", f"r{i % 40}", ("insert", "update", "delete")[i % 7 % 3], f'{{"rev": {i}}}', i) for i in range(300)]
    spark.createDataFrame(rows, "id string, table_name string, record_id string, action string, new_value string, timestamp long").write.parquet(f"{tmp_path}/audit_log.parquet")
    seen, apply = [], BucketedTable.apply

    def watched(self, delta):
        before = self.manifest()["files"]
        version = apply(self, delta)
        seen.append(sum(before[b] != path for b, path in self.manifest()["files"].items() if b in before))
        return version

    monkeypatch.setattr(BucketedTable, "apply", watched)
    got = {r["record_id"]: r["id"] for r in problems.p7_found(spark, str(tmp_path)).collect()}
    want = {}
    for i, _, record, action, _, _ in rows:
        if action == "delete":
            want.pop(record, None)
        elif action == "insert" or record in want:
            want[record] = i
    assert got == want and want and len(seen) == 2 and seen[1] > 0  # buckets with a base were merged and replaced


def test_rows_query_reads_the_written_tables(spark, tmp_path):
    from mnemospark.plans import problems

    stamp = "created_at long, updated_at long"
    spark.createDataFrame([("i", "c", '{"a": 1, "A": "x", "b": [{"n": 1}, {"n": null}, 5]}', 1, 1)], f"id string, collection_id string, metadata string, {stamp}").write.parquet(f"{tmp_path}/adb_vectors.parquet")
    spark.createDataFrame([("n", '{"o": {"p": true}}', 1, 1)], f"id string, data string, {stamp}").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([], f"id string, input string, {stamp}").write.parquet(f"{tmp_path}/workflows.parquet")
    rows = store_json_rows(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("adb_vectors", "nodes", "workflows")))
    want = {(r["tag"], r["kind"]): r["count"] for r in rows.groupBy("tag", "kind").count().collect()}
    got = {(r["tag"], r["kind"]): (r["n"], r["filled"]) for r in problems.p4_rows(spark, str(tmp_path)).collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    assert sum(f for (tag, _), (_, f) in got.items() if tag == "adb_vectors") == 2 and sum(f for (tag, _), (_, f) in got.items() if tag == "adb_vectors.b") == 2


def test_names_and_keys_never_meet():
    """Dots, brackets and signs in JSON keys and ids are told apart from those that part names."""
    rows = list(visit("t", "r", {"a": {"b": 1, "c": [{"x": 1}]}, "a.b": 2, "a.c": [{"x": 2}], "e": {}, "f": []}))
    assert json.loads(rows[0][6]) == {"a.b": 1, "a\\.b": 2, "e": {}, "f": []}
    keys = [r[2] for r in rows]
    assert len(set(keys)) == len(keys) == 3 and {r[4] for r in rows[1:]} == {"$.a.c[0]"} and {r[0] for r in rows[1:]} == {"t.a.c", "t.a\\.c"}
    both = [r for i in ("r", "r#$.a[0]", None, "") for r in visit("t", i, {"a": [{"b": 1}]})]
    assert len({r[2] for r in both}) == len(both) and all(r[3] is None or r[3] in {x[2] for x in both} for r in both)


def test_many_heavy_keys(spark):
    """Beyond what is broadcast, heavy keys are dealt out; the result stays."""
    refs = spark.range(4000).selectExpr("'s' source_table", "'f' field_name", "cast(id AS string) record_key", "concat('k', id % 40) ref_key", "1600000000000L + id * 86400000 ref_at", "'t' target")
    targets = spark.sql("SELECT 't' target, concat('k', id) id, 1700000000000L created_at FROM range(10)")
    gone = spark.sql("SELECT 't' target, concat('k', id) id FROM range(5, 20)")
    want = {tuple(r) for r in find_orphans(refs, targets, gone).collect()}
    assert len(want) > 2000 and {tuple(r) for r in find_orphans(refs, targets, gone, heavy_from=2, broadcast_keys=3).collect()} == want
