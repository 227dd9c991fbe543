import numpy as np

from mnemospark.llm.queries import QUERIES
from mnemospark.llm.similar import VectorIndex, hamming_radius, plan_index

V = "id string, collection_id string, vector array<float>, updated_at long, created_at long"
C = "id string, dim long"


def brute(rows, dims, least):
    newest = {}
    for r in rows:
        k = (r[0], r[1])
        if r[0] is not None and r[1] in dims and (k not in newest or r[3] > newest[k][3]):
            newest[k] = r
    by = {}
    for (i, c), r in newest.items():
        v = r[2]
        if v is not None and len(v) == dims[c] and all(x is not None for x in v):
            x = np.array(v, float)
            if np.isfinite(x).all() and (x != 0).any():
                by.setdefault(c, []).append((i, np.float32(x).astype(float)))
    out = set()
    for c, vs in by.items():
        vs.sort(key=lambda t: t[0])
        for a in range(len(vs)):
            for b in range(a + 1, len(vs)):
                p, q = vs[a][1], vs[b][1]
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= least:
                    out.add((c, vs[a][0], vs[b][0]))
    return out


def data(n=400, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c, k in (("c1", n), ("c2", n // 4)):
        x = rng.standard_normal((k, dim))
        for i in range(0, k - 1, 5):
            x[i + 1] = x[i] * rng.uniform(0.2, 5) + rng.standard_normal(dim) * rng.uniform(0.05, 0.3)
        rows += [(f"v{i:04d}", c, [float(t) for t in x[i]], 5, 1) for i in range(k)]
    return rows


def pairs(spark, rows, dims, least=0.97):
    index = VectorIndex(spark.createDataFrame(rows, V), spark.createDataFrame(list(dims.items()), C), least)
    got = [tuple(r)[:3] for r in index.pairs().collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_recall_and_precision(spark):
    rows, dims = data(), {"c1": 24, "c2": 24}
    want, got = brute(rows, dims, 0.97), pairs(spark, rows, dims)
    assert len(want) > 30 and got <= want and len(got) >= 0.97 * len(want)


def test_dirty_rows(spark):
    rows = data(60)
    one = rows[0][2]
    rows += [
        ("copy", "c1", one, 1, 1), ("copy2", "c1", one, 1, 1), ("copy2", "c1", one, 1, 1), ("short", "c1", one[:-1], 1, 1), ("zero", "c1", [0.0] * 24, 1, 1),
        ("nan", "c1", [float("nan"), *one[1:]], 1, 1), ("none", "c1", None, 1, 1), ("hole", "c1", [None, *one[1:]], 1, 1), ("else", "C1 ", one, 1, 1),
        ("old", "c1", one, 1, 1), ("old", "c1", [-x for x in one], 2, 1), (None, "c1", one, 1, 1), ("x", None, one, 1, 1), ("big", "c1", [x * 1e30 for x in one], 1, 1), ("tiny", "c1", [x * 1e-30 for x in one], 1, 1),
    ]
    dims = {"c1": 24, "c2": 24}
    got = pairs(spark, rows, dims)
    assert ("c1", "copy", "copy2") in got and ("c1", "big", "copy") in got and ("c1", "copy", "tiny") in got
    assert not {x for p in got for x in p} & {"short", "zero", "nan", "none", "hole", "else", "old", None}
    assert got <= brute(rows, dims, 0.97)


def test_many_copies_and_empty(spark):
    rows = [(f"v{i:03d}", "c", [1.0, 2.0, 3.0, 4.0], 1, 1) for i in range(60)]
    assert len(pairs(spark, rows, {"c": 4})) == 60 * 59 // 2
    assert pairs(spark, [], {"c": 4}) == set()
    empty = VectorIndex(spark.createDataFrame(rows, V).withColumnsRenamed({}).selectExpr("*", "1 AS twin", "2 AS dim2"), spark.createDataFrame([], C))
    assert empty.pairs().count() == 0


def test_plan_meets_every_code_within_the_radius():
    """Pigeonhole: whatever bits differ, one substring differs in no more than its probing radius."""
    rng = np.random.default_rng(1)
    radius = hamming_radius(0.97, 0.997)
    assert 15 < radius < 22
    for largest in (10, 2_000, 20_000, 10**6, 10**8):
        parts = plan_index(largest, radius)
        assert sum(n for _, n, _ in parts) <= 128 and all(n <= 32 for _, n, _ in parts)
        for r in range(radius + 1):
            for _ in range(100):
                bits = set(rng.choice(128, r, replace=False).tolist())
                assert any(sum(f <= b < f + n for b in bits) <= near for f, n, near in parts)
    assert len(plan_index(10**8, radius)) < len(plan_index(2_000, radius))


def test_probing_meets_what_brute_force_does(spark):
    """All pairs of codes within the radius, with groups so small that rows visit others and crowded ones are dealt out."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24))
    x[300:600] = x[0] + rng.standard_normal((300, 24)) * 0.04
    rows = [(f"v{i:04d}", "c1", [float(t) for t in v], 5, 1) for i, v in enumerate(x)]
    for group in (1 << 15, 64, 8):
        index = VectorIndex(spark.createDataFrame(rows, V), spark.createDataFrame([("c1", 24)], C), group=group)
        codes = index.codes.select("vid", "c0", "c1").collect()
        c = np.array([[r[1], r[2]] for r in codes], np.int64).view(np.uint64)
        far = np.bitwise_count(c[:, None, :] ^ c[None, :, :]).sum(2)
        want = {tuple(sorted((codes[i][0], codes[j][0]))) for i, j in zip(*np.nonzero(far <= index.radius)) if i < j}
        got = [tuple(r) for r in index.candidates().collect()]
        assert len(want) > 20_000 and set(got) == want and len(got) == len(want)


def test_nearest_recall(spark):
    """Recall against brute force on clustered vectors; the wrong query's neighbours must score low."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32))
    x = centres[rng.integers(0, 12, 1200)] + rng.standard_normal((1200, 32)) * 0.6
    rows = [(f"{i:04d}", "c", [float(t) for t in v], 1, 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, V)
    index = VectorIndex(df, spark.createDataFrame([("c", 32)], C))
    got = index.nearest(df.filter("cast(id AS int) % 100 = 0"), 10).collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = other = 0
    for q in range(0, 1200, 100):
        s = y @ y[q]
        s[q] = -2
        best = {f"{i:04d}" for i in s.argsort()[::-1][:10]}
        hit += len(best & {r["id"] for r in got if r["query_id"] == f"{q:04d}"})
        other += len(best & {r["id"] for r in got if r["query_id"] == f"{(q + 100) % 1200:04d}"})
    assert hit >= 0.9 * 120 > 60 > other


def test_nearest_of_unclustered_vectors_and_small_collections(spark):
    """Neighbours far below the planned cosine, equal scores, and a collection much smaller than the largest."""
    rng = np.random.default_rng(11)
    x, small = rng.standard_normal((4000, 64)), rng.standard_normal((25, 64))
    x[1] = x[2] = x[3]
    rows = [(f"{i:04d}", "large", [float(t) for t in v], 1, 1) for i, v in enumerate(x)] + [(f"{i:04d}", "small", [float(t) for t in v], 1, 1) for i, v in enumerate(small)]
    df = spark.createDataFrame(rows, V)
    index = VectorIndex(df, spark.createDataFrame([("large", 64), ("small", 64)], C))
    got = {}
    for r in index.nearest(df.filter("cast(id AS int) % 80 = 0 OR id = '0001' OR collection_id = 'small'"), 10).collect():
        got.setdefault((r["collection_id"], r["query_id"]), {})[r["rank"]] = r["id"]
    for name, m in (("large", x), ("small", small)):
        y = np.float32(m).astype(float)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        for q in [i for i in range(len(m)) if i % 80 == 0 or i == 1 or name == "small"]:
            s = np.round(y @ y[q], 12)
            order = [i for i in np.lexsort((np.arange(len(m)), -s)) if i != q][:10]
            assert got[name, f"{q:04d}"] == {n + 1: f"{i:04d}" for n, i in enumerate(order)}


def test_top_of_stored_vectors(spark, tmp_path):
    """Against brute force, with older states, copies and unusable vectors; queries are those that the hash picks."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16))
    state = {(f"v{i:04d}", "hot" if i % 10 else "cold"): [float(t) for t in np.float32(v)] for i, v in enumerate(x)}
    rows = [(i, c, v, 5, 1) for (i, c), v in state.items()] + [(i, c, [-t for t in v], 3, 1) for (i, c), v in list(state.items())[::3]]
    rows += [("nan", "hot", [float("nan")] * 16, 5, 1), ("zero", "hot", [0.0] * 16, 5, 1), ("short", "hot", [1.0] * 15, 5, 1), ("else", "gone", [1.0] * 16, 5, 1)]
    spark.createDataFrame(rows, V).write.parquet(f"{tmp_path}/adb_vectors.parquet")
    spark.createDataFrame([("hot", 16), ("cold", 16)], C).write.parquet(f"{tmp_path}/adb_collections.parquet")
    got = {}
    for r in QUERIES["p3_top"](spark, str(tmp_path)).collect():
        got.setdefault((r["collection_id"], r["query_id"]), {})[r["rank"]] = r["id"]
    asked = spark.read.parquet(f"{tmp_path}/adb_vectors.parquet").filter("xxhash64(collection_id, id) % 100 = 0").select("collection_id", "id").distinct().collect()
    want = {}
    for c, q in ((r[0], r[1]) for r in asked if (r[1], r[0]) in state):
        mine = sorted(i for i, name in state if name == c and i != q)
        y = np.array([state[i, c] for i in mine])
        s = y @ np.array(state[q, c]) / np.linalg.norm(y, axis=1)
        want[c, q] = {n + 1: mine[j] for n, j in enumerate(np.argsort(-s)[:10])}
    assert len(want) > 5 and sum(got[q][n] == want[q][n] for q in want for n in want[q]) >= 0.99 * 10 * len(want) and got.keys() == want.keys()
