import random
from collections import Counter
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm.packing import best_fit_decreasing, lower_bound, pack, pack_sessions, place_entries, place_pieces, refill

S = "id string, session_id string, source_type string, source_id string, content_preview string, token_count long, relevance_score double, priority long, included_at long"


def optimum(items, capacity):
    """Fewest bins by trying all ways to place each item."""
    items = sorted(items, reverse=True)

    @lru_cache(None)
    def fits(i, rooms):
        if i == len(items):
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in tried:
                tried.add(room)
                if fits(i + 1, tuple(sorted((*rooms[:k], room - items[i], *rooms[k + 1 :]), reverse=True))):
                    return True
        return False

    n = 0
    while not fits(0, (capacity,) * n):
        n += 1
    return n


def check(bins, items, capacity):
    got = Counter()
    for p, k in bins.items():
        assert sum(s * c for s, c in p) <= capacity
        for s, c in p:
            got[s] += c * k
    assert got == Counter(items)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_optimal(items):
    bins, bound, certified = pack(dict(Counter(items)), 20)
    check(bins, items, 20)
    best = optimum(tuple(items), 20) if items else 0
    assert bound <= best and certified and sum(bins.values()) == best


def test_planted_full_windows():
    rng = random.Random(5)
    for _ in range(60):
        items = []
        for _ in range(rng.randint(1, 12)):
            cuts = sorted(rng.sample(range(1, 4096), rng.randint(0, 7)))
            items += [b - a for a, b in zip([0, *cuts], [*cuts, 4096])]
        bins, bound, certified = pack(dict(Counter(items)))
        check(bins, items, 4096)
        assert certified and sum(bins.values()) * 4096 == sum(items)


def test_multiples_of_three_never_fill():
    bins, _, certified = pack(dict(Counter([2049 // 3 * 3, 1023, 1023, 3 * 341, 3 * 682])))
    assert certified and sum(bins.values()) * 4096 > 2049 + 1023 + 1023 + 1023 + 2046


def test_huge_session_by_counts():
    sizes = {1000: 3_000_000, 96: 1_000_000, 4096: 500_000}
    bins, bound, _ = pack(sizes)
    assert sum(bins.values()) < 1.05 * bound and sum(k * c for p, k in bins.items() for s, c in p if s == 1000) == 3_000_000
    assert lower_bound({2049: 10}, 4096) == 10 and sum(best_fit_decreasing({2048: 10}, 4096).values()) == 5


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "v", "x", None, t, r, p, 0) for i, s, t, r, p in rows], S)


def test_sessions(spark):
    rows = [
        ("a", "full", 4000, 0.1, 1), ("b", "full", 96, 0.2, 1), ("b", "full", 96, 0.2, 1), ("c", "full", 0, 0.2, 1), ("d", "full", -5, 0.2, 1), ("e", "full", None, None, None),
        ("f", "gap", 4000, 0.1, 1), ("g", "over", 8192, 0.1, 1), ("h", "over", 9000, 0.1, 1), ("i", None, 4096, 0.1, 1), (None, "noid", 1, 0.1, 1),
    ]
    df = frame(spark, rows).selectExpr("*", "1 AS tokens", "2 AS size", "3 AS hist")
    got = {r["session_id"]: (r["windows"], r["free"], r["oversize"], r["certified"]) for r in pack_sessions(df).collect()}
    assert got == {"full": (1, 0, 0, True), "gap": (1, 96, 0, True), "over": (5, 3288, 2, True), None: (1, 0, 0, True), "noid": (1, 4095, 0, True)}
    assert pack_sessions(frame(spark, [])).count() == 0


def test_places(spark):
    rng = random.Random(1)
    rows = [(f"e{i:04d}", f"s{i % 3}", rng.choice([10, 500, 500, 1300, 2000, 4096, 5000]), rng.random(), rng.randint(0, 2)) for i in range(300)]
    placed = place_entries(frame(spark, rows)).collect()
    assert len(placed) == len(rows)  # 5,000 leaves a rest
    load = Counter()
    for r in placed:
        load[r["session_id"], r["window"]] += r["tokens"]
    assert max(load.values()) <= 4096
    windows = {r["session_id"]: r["windows"] for r in pack_sessions(frame(spark, rows)).collect()}
    for s, n in windows.items():
        assert max(w for x, w in load if x == s) == n - sum(1 for r in rows if r[1] == s and r[2] == 5000)


def test_planted_long_sessions():
    """Sessions of many windows, all full; a pool that can't be packed better takes no steps from the others."""
    for n, each, seed in ((60, 5, 0), (240, 3, 0), (240, 3, 1)):
        rng, items = random.Random(seed * 1000 + n), []
        for _ in range(n):
            cuts = sorted(rng.sample(range(1, 4096), each - 1))
            items += [b - a for a, b in zip([0, *cuts], [*cuts, 4096])]
        bins, bound, certified = pack(dict(Counter(items)))
        check(bins, items, 4096)
        assert certified and sum(bins.values()) == bound == n


def test_common_divisor_is_certified():
    rng = random.Random(2)
    items = [3 * rng.randint(20, 600) for _ in range(400)]
    items += [3] * (-sum(items) // 3 % 4096)
    bins, bound, certified = pack(dict(Counter(items)))
    check(bins, items, 4096)
    assert sum(items) % 4096 == 0 and certified and sum(bins.values()) == bound > sum(items) // 4096


def test_refill_with_room_left():
    bins = Counter({((60, 1), (30, 1)): 1, ((50, 1), (20, 1)): 1, ((30, 1),): 1})
    better = refill(bins, 100)
    check(better, [60, 30, 50, 20, 30], 100)
    assert sum(better.values()) == 2


def test_pieces_hold_all_tokens(spark):
    rng = random.Random(4)
    rows = [(f"e{i:03d}", f"s{i % 2}", rng.choice([10, 500, 1300, 4096, 4097, 8192, 9000, 20480]), rng.random(), rng.randint(0, 2)) for i in range(80)]
    rows += [("x", "only", 8192, 0.1, 1), ("y", None, 12289, None, None), ("z", "only", 0, 0.1, 1)]
    placed = place_pieces(frame(spark, rows)).collect()
    by_id, load = Counter(), Counter()
    for r in placed:
        by_id[r["id"]] += r["tokens"]
        load[r["session_id"], r["window"]] += r["tokens"]
    assert by_id == +Counter({r[0]: r[2] for r in rows}) and max(load.values()) <= 4096
    for r in pack_sessions(frame(spark, rows)).collect():
        assert {w for s, w in load if s == r["session_id"]} == set(range(1, r["windows"] + 1))
    assert sorted((r["window"], r["tokens"]) for r in placed if r["id"] == "x") == [(1, 4096), (2, 4096)]


def test_full_sessions_of_three_pieces():
    """Sessions planted full with three entries a window, more than the searches for small pools settle; and many different sizes."""
    for windows, seed in ((60, 0), (60, 1), (150, 1)):
        r, items = random.Random(seed * 1000 + windows), []
        for _ in range(windows):
            a, b = sorted(r.sample(range(1, 4096), 2))
            items += [a, b - a, 4096 - b]
        bins, bound, certified = pack(dict(Counter(items)))
        check(bins, items, 4096)
        assert sum(bins.values()) == bound == windows and certified
    items = [*range(1, 3000), 4096 - 2999]
    bins, _, _ = pack(dict(Counter(items)), max_steps=2000)
    check(bins, items, 4096)
