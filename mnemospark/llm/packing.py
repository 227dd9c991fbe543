"""Filling context windows of fixed capacity (problem 5): bound-certified repacking.

What matters for a packing is how many entries there are of each size, and there are at most ``capacity`` sizes; so a
session of any length is packed from a histogram that fits in a task, bins of equal content are counted and not listed.
Dual feasible functions bound the number of windows from below. Best-fit decreasing packs; while its result is above the
bound, windows with gaps and some others exchange their entries and are packed again, by an exact search in the end.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import spread_row_number
from ..session import cut

CAPACITY = 4096
#: Steps of the exact search for each pool of windows; a session for which no pool's suffice comes out uncertified.
STEPS = 400_000
#: Random pools that are tried one after another where no growing pool helps, and the steps of each.
POOLS, POOL_STEPS = 400, 3_000
#: Windows taken into a random pool beside the entries not placed.
POOL_WINDOWS = (4, 8, 12, 16, 24, 32, 48)
#: Windows of a pool that is packed by covering, steps of that search for a session, and of one try in turn.
COVER_WINDOWS, COVER_STEPS, COVER_TRIES = 1_200, 600_000, (1_000, 10_000)
#: Different sizes in a pool to be covered, at most, as patterns grow with their square; with more, many small searches do.
COVER_SIZES = 1_200

Bins = Counter  # of tuples ((size, count), ...), largest size first


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Fewest windows, from the sum and from dual feasible functions at every threshold that matters.

    At threshold t: entries over capacity - t need a window each and share it with nothing of t or more; those over half
    need a window each; what is left of the entries from t to half must fit beside the latter.
    """
    if not sizes:
        return 0
    s = np.array(sorted(sizes), np.int64)
    n = np.array([sizes[int(x)] for x in s], np.int64)
    cs, cn = np.concatenate([[0], np.cumsum(s * n)]), np.concatenate([[0], np.cumsum(n)])
    best = -(-int(cs[-1]) // capacity)
    half = np.searchsorted(s, capacity / 2, "right")
    low = np.concatenate([[0], s[:half]])
    top = np.searchsorted(s, capacity - low, "right")  # first index over capacity - t
    n1 = cn[-1] - cn[top]
    n2 = np.maximum(cn[top] - cn[half], 0)
    room = n2 * capacity - np.maximum(cs[top] - cs[half], 0)
    small = cs[half] - cs[np.searchsorted(s, low, "left")]
    return max(best, int((n1 + n2 + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit_decreasing(sizes: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on counts: all entries of one size at once, all windows with the same room at once."""
    by_room: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(pattern: tuple, room: int, count: int) -> None:
        if room not in by_room:
            by_room[room] = Counter()
            insort(rooms, room)
        by_room[room][pattern] += count

    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put(((size, each),), capacity - size * each, full)
                if rest:
                    put(((size, rest),), capacity - size * rest, 1)
                break
            room = rooms[i]
            pattern, count = next(iter(by_room[room].items()))
            each = min(room // size, left)
            take = min(count, left // each)
            by_room[room][pattern] -= take
            if not by_room[room][pattern]:
                del by_room[room][pattern]
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            put((*pattern, (size, each)), room - size * each, take)
            left -= take * each
    out: Bins = Counter()
    for patterns in by_room.values():
        out.update(patterns)
    return out


def _weight(pattern: tuple) -> int:
    return sum(s * c for s, c in pattern)


def exact_fill(sizes: Counter, capacity: int, waste: int, steps: list[int], deepest: list | None = None) -> list[tuple] | None:
    """Windows for all entries with at most ``waste`` tokens left over together, by depth-first search; None if there are none.

    The largest entry left opens the next window; fillings of its room are tried from the fullest and largest on, along
    sums that can be reached at all. States known to fail are not tried again. ``steps`` counts down; None at zero, too.
    ``deepest`` takes the most windows that were filled at a time.
    """
    failed: set = set()

    def reach(items: list[tuple[int, int]], limit: int) -> list[int]:
        """Bit sets of the sums that the items from i on can make."""
        sets, bits, mask = [1], 1, (1 << (limit + 1)) - 1
        for s, c in reversed(items):
            k = 1
            c = min(c, limit // s)
            while c:
                m = min(k, c)
                bits |= (bits << (s * m)) & mask
                c -= m
                k *= 2
            sets.append(bits)
        return sets[::-1]

    def fillings(items: list[tuple[int, int]], room: int, spare: int):
        sets = reach(items, room)

        def walk(i: int, need: int, chosen: tuple):
            # as deep as a window has different sizes; sizes that are left out are passed over in the loop
            if need == 0:
                yield chosen
                return
            while i < len(items) and sets[i] >> need & 1:
                steps[0] -= 1
                if steps[0] < 0:
                    return
                s, c = items[i]
                for m in range(min(c, need // s), 0, -1):
                    if sets[i + 1] >> (need - s * m) & 1:
                        yield from walk(i + 1, need - s * m, (*chosen, (s, m)))
                i += 1

        for free in range(spare + 1):
            if room >= free and sets[0] >> (room - free) & 1:
                for chosen in walk(0, room - free, ()):
                    yield free, chosen

    # an explicit stack of (entries left, waste left, fillings still to try, windows so far)
    def options(left: Counter, spare: int):
        largest = max(left)
        rest = left.copy()
        rest[largest] -= 1
        items = sorted(((s, c) for s, c in rest.items() if c), reverse=True)
        for free, chosen in fillings(items, capacity - largest, min(spare, capacity - largest)):
            merged = Counter({largest: 1})
            for s, m in chosen:
                merged[s] += m
            yield free, tuple(sorted(merged.items(), reverse=True))

    if not +sizes:
        return []
    stack = [(+sizes, waste, options(+sizes, waste), None)]
    while stack:
        left, spare, tries, _ = stack[-1]
        step = next(tries, None)
        if steps[0] < 0:
            return None
        if step is None:
            failed.add((tuple(sorted(left.items())), spare))
            stack.pop()
            continue
        free, window = step
        after = left.copy()
        after.subtract(dict(window))
        after = +after
        stack[-1] = (left, spare, tries, window)
        if deepest is not None and len(stack) > len(deepest):
            deepest[:] = [f[3] for f in stack]
        if not after:
            return [f[3] for f in stack]
        if (tuple(sorted(after.items())), spare - free) not in failed:
            stack.append((after, spare - free, options(after, spare - free), None))
    return None


def _items(windows: Bins) -> Counter:
    items: Counter = Counter()
    for p, k in windows.items():
        for s, c in p:
            items[s] += c * k
    return items


def few_pieces(sizes: Counter, capacity: int) -> list[tuple]:
    """Contents of a full window of at most three pieces."""
    s, out = sorted(sizes), set()
    for i, a in enumerate(s):
        if a == capacity:
            out.add(((a, 1),))
        elif sizes.get(capacity - a) and capacity - a >= a:
            out.add((capacity - a, a))
        for b in s[i:]:
            if capacity - a - b < b:
                break
            if sizes.get(capacity - a - b):
                out.add((capacity - a - b, b, a))
    out = {p if isinstance(p[0], tuple) else tuple(sorted(Counter(p).items(), reverse=True)) for p in out}
    return sorted(p for p in out if all(sizes[x] >= n for x, n in p))


def cover(sizes: Counter, patterns: list[tuple], draw: random.Random, limit: int) -> list[int] | None:
    """Numbers of patterns that use up all entries, by depth-first search within ``limit`` steps; None if it found none.

    The size that fewest patterns can still use comes next, and of these patterns first those whose sizes few others use.
    """
    left = dict(sizes)
    by: dict[int, list[int]] = {s: [] for s in left}
    for i, p in enumerate(patterns):
        for s, _ in p:
            by[s].append(i)
    able, ways, chosen, steps = [True] * len(patterns), {s: len(v) for s, v in by.items()}, [], 0

    def use(i: int) -> list[int]:
        for s, n in patterns[i]:
            left[s] -= n
        gone = []
        for s, _ in patterns[i]:
            for j in by[s]:
                if able[j] and any(left[t] < m for t, m in patterns[j]):
                    able[j] = False
                    gone.append(j)
                    for t, _ in patterns[j]:
                        ways[t] -= 1
        return gone

    def undo(i: int, gone: list[int]) -> None:
        for j in gone:
            able[j] = True
            for t, _ in patterns[j]:
                ways[t] += 1
        for s, n in patterns[i]:
            left[s] += n

    def options() -> list[int] | None:
        """Patterns for the next size, best last; None if nothing is left."""
        best, fewest = None, 1 << 30
        for s, n in left.items():
            if n and ways[s] < fewest:
                best, fewest = s, ways[s]
                if fewest <= 1:
                    break
        if best is None:
            return None
        rank = {j: sum(1 / ways[s] for s, _ in patterns[j]) + 0.1 * draw.random() for j in by[best] if able[j]}
        return sorted(rank, key=rank.get)

    todo = options()
    stack: list[list] = [] if todo is None else [[todo, None]]
    while stack:
        steps += 1
        if steps > limit:
            return None
        tries, now = stack[-1]
        if now is not None:
            undo(*now)
            chosen.pop()
            stack[-1][1] = None
        if not tries:
            stack.pop()
            continue
        i = tries.pop()
        stack[-1][1] = (i, use(i))
        chosen.append(i)
        below = options()
        if below is None:
            return chosen
        stack.append([below, None])
    return None


def refill(bins: Bins, capacity: int, pools: int = POOLS, pool_steps: int = POOL_STEPS, cover_steps: int = COVER_STEPS) -> Bins | None:
    """The entries of ``bins`` in one window less, by many small searches; None if none of ``pools`` gets there.

    The room left over becomes entries of one token, so all windows must be full. The entries of windows that aren't are
    pooled with some full windows drawn at random; if a search fills at least as many as were drawn, these are kept and
    what it leaves goes into the next pool. What is left in the end, of few pieces a window, is pooled with so many full
    windows that there are many ways to fill them all, and packed by covering.
    """
    full = Counter({p: k for p, k in bins.items() if _weight(p) == capacity})
    left = _items(bins - full)
    units = (sum(bins.values()) - 1) * capacity - sum(_weight(p) * k for p, k in bins.items())
    if units < 0:
        return None
    left[1] += units
    left, draw = +left, random.Random(7)
    for _ in range(pools):
        if not left:
            break
        m = min(sum(full.values()), draw.choice(POOL_WINDOWS))
        names = sorted(full)
        drawn = Counter(draw.sample(names, m, counts=[full[p] for p in names]) if m else ())
        pool, found = left + _items(drawn), []
        exact_fill(pool, capacity, 0, [pool_steps], found)
        if len(found) >= m:
            full, left = full - drawn + Counter(found), pool - _items(Counter(found))
    steps, turn, covered, patterns = cover_steps, 0, None, []
    while left and steps > 0 and sum(left.values()) <= 3 * COVER_WINDOWS:
        # pools of windows with few pieces are exchanged as a whole: all patterns that fill a window are covered with
        m = min(sum(full.values()), max(0, COVER_WINDOWS - -(-sum(s * c for s, c in left.items()) // capacity)))
        names = sorted(full)
        drawn = Counter(draw.sample(names, m, counts=[full[p] for p in names]) if m else ())
        pool = left + _items(drawn)
        if len(pool) > COVER_SIZES or sum(pool.values()) * capacity > 3 * sum(s * c for s, c in pool.items()):
            break  # too many patterns, or more than three pieces a window
        limit = COVER_TRIES[turn % len(COVER_TRIES)]
        if pool != covered:
            covered, patterns = pool, few_pieces(pool, capacity)
        # a step costs as much more as there are more patterns to look at
        turn, steps = turn + 1, steps - limit * max(1, len(patterns) // 5000)
        found = cover(pool, patterns, draw, limit)
        if found is not None:
            full, left = full - drawn + Counter(patterns[i] for i in found), Counter()
    if left:
        return None
    out: Bins = Counter()
    for p, k in full.items():
        ones = dict(p).get(1, 0)
        for _ in range(k):
            if not ones or not units:
                out[p] += k if not ones else 1
                if not ones:
                    break
                continue
            take = min(ones, units)
            units -= take
            rest = tuple((s, c if s > 1 else c - take) for s, c in p if s > 1 or c > take)
            if rest:
                out[rest] += 1
    return out


def pack(sizes: dict[int, int], capacity: int = CAPACITY, max_steps: int = STEPS) -> tuple[Bins, int, bool]:
    """(windows, lower bound, certified) for entries of 1 to ``capacity`` tokens.

    Certified means that no packing has fewer windows: the count meets the bound, or the search over all entries ended.
    Pools for repacking start at the windows with gaps and double with full ones until they hold everything, each with
    steps of its own; after them come random pools. Where all sizes have a common divisor, only its multiples of a
    window can be filled.
    """
    bound = lower_bound(sizes, capacity - capacity % math.gcd(*sizes)) if sizes else 0
    bins = best_fit_decreasing(sizes, capacity)
    count = sum(bins.values())
    while count > bound:
        order = sorted(bins, key=_weight)
        gaps = [p for p in order if _weight(p) < capacity]
        pool, size = Counter(), max(2, 2 * sum(bins[p] for p in gaps))
        improved = exhausted = False
        while not improved and not exhausted:
            steps = [max_steps]
            pool = Counter()
            for p in order:
                take = min(bins[p], size - sum(pool.values()))
                if take <= 0:
                    break
                pool[p] = take
            n, items = sum(pool.values()), _items(pool)
            exhausted = n == count
            waste = (n - 1) * capacity - sum(s * c for s, c in items.items())
            if waste >= 0 and lower_bound(items, capacity) < n:
                better = best_fit_decreasing(items, capacity)
                if sum(better.values()) >= n:
                    found = exact_fill(items, capacity, waste, steps)
                    better = Counter(found) if found is not None else None
                if better is not None:
                    bins = +(bins - pool) + better
                    improved = True
            size *= 2
        if not improved:
            if steps[0] > 0:
                return bins, bound, True
            better = refill(bins, capacity)
            if better is None:
                return bins, bound, False
            bins = better
        count = sum(bins.values())
    return bins, bound, count == bound


def entry_rows(entries: DataFrame) -> DataFrame:
    """(id, session_id, tokens, priority, relevance): each id once, those without tokens left out.

    Of copies of an id the greatest (token_count, ...) counts; rows without an id count each on their own. A null session
    is a session of its own. Entries of null, zero or negative size take no room.
    """
    ghost = F.concat(F.lit("\0"), F.xxhash64("session_id", "source_type", "source_id", "content_preview", "token_count", "included_at").cast("string"))
    rows = entries.select(F.coalesce("id", ghost).alias("id"), F.col("token_count").cast("long").alias("tokens"), "session_id", F.col("priority").cast("long").alias("priority"), F.col("relevance_score").cast("double").alias("relevance"))
    names = ["tokens", "session_id", "priority", "relevance"]
    rows = rows.groupBy("id").agg(F.max(F.struct(*names)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in names])
    return rows.filter(F.col("tokens") > 0)


def _pack_batches(capacity: int, max_steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("session_id", "entries", "tokens", "oversize", "windows", "bound", "certified", "free", "bins")
        kind = pa.list_(pa.struct([("count", pa.int64()), ("content", pa.list_(pa.struct([("size", pa.int32()), ("n", pa.int64())])))]))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), kind)
        for b in batches:
            rows = []
            for session, hist in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sizes = {h["size"]: h["n"] for h in hist if h["size"] > 0}
                full, over, entries, tokens = 0, 0, 0, 0
                for h in hist:
                    full, over, entries, tokens = full + h["full"], over + h["over"], entries + h["whole"], tokens + h["tokens"]
                bins, bound, certified = pack(sizes, capacity, max_steps)
                n = sum(bins.values()) + full
                listed = [{"count": k, "content": [{"size": s, "n": c} for s, c in p]} for p, k in sorted(bins.items(), reverse=True)]
                rows.append((session, entries, tokens, over, n, bound + full, certified, n * capacity - tokens, listed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, types)], names=list(names))

    return run


def pack_sessions(entries: DataFrame, capacity: int = CAPACITY, max_steps: int = STEPS) -> DataFrame:
    """One row per session: (session_id, entries, tokens, oversize, windows, bound, certified, free, bins).

    Entries over the capacity are split into full windows and a rest that is packed like an entry; ``oversize`` counts
    them. ``bins`` lists the different windows with their number. Sessions without entries of any size don't come out.
    """
    rows = entry_rows(entries)
    piece = F.when(F.col("tokens") <= capacity, F.col("tokens")).otherwise(F.col("tokens") % capacity).cast("int")
    hist = rows.groupBy("session_id", piece.alias("size")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(0)).cast("long").alias("full"),
        F.sum((F.col("tokens") > capacity).cast("long")).alias("over"), F.count("*").alias("whole"), F.sum("tokens").alias("tokens"),
    )
    by_session = hist.groupBy("session_id").agg(F.collect_list(F.struct("size", "n", "full", "over", "whole", "tokens")).alias("hist"))  # at most `capacity` elements
    schema = "session_id string, entries long, tokens long, oversize long, windows long, bound long, certified boolean, free long, bins array<struct<count:long,content:array<struct<size:int,n:long>>>>"
    return by_session.mapInArrow(_pack_batches(capacity, max_steps), schema)


def place_entries(entries: DataFrame, capacity: int = CAPACITY, max_steps: int = STEPS) -> DataFrame:
    """(session_id, id, tokens, window): the window, from 1 in each session, of each entry or rest of a split one.

    Within a size, entries of higher priority, then relevance, come into earlier windows. Full windows that a split entry
    fills by itself come after the others and are not listed; :func:`place_pieces` has them too.
    """
    return _placed(entries, pack_sessions(entries, capacity, max_steps), capacity)


def place_pieces(entries: DataFrame, capacity: int = CAPACITY, max_steps: int = STEPS) -> DataFrame:
    """:func:`place_entries` and a row of ``capacity`` tokens for each full window that a split entry fills by itself.

    These windows come after the packed ones of the session, in the same order of entries; so the tokens of all rows add
    up to those of the session, in as many windows as :func:`pack_sessions` counts.
    """
    packed = cut(pack_sessions(entries, capacity, max_steps))
    pieces = entry_rows(entries).filter(F.col("tokens") > capacity)
    pieces = pieces.select("session_id", "id", "priority", "relevance", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("tokens") / capacity))).alias("piece"))
    order = [F.col("priority").desc(), F.col("relevance").desc(), F.col("id"), F.col("piece")]
    ranked = spread_row_number(pieces, ["session_id"], order, "rank")
    before = packed.select(F.col("session_id").alias("_s"), F.aggregate("bins", F.lit(0).cast("long"), lambda n, b: n + b["count"]).alias("before"))
    full = ranked.join(before, F.col("session_id").eqNullSafe(F.col("_s")))
    full = full.select("session_id", "id", F.lit(capacity).cast("long").alias("tokens"), (F.col("before") + F.col("rank")).alias("window"))
    return _placed(entries, packed, capacity).unionByName(full)


def _placed(entries: DataFrame, packed: DataFrame, capacity: int) -> DataFrame:
    packed = packed.select("session_id", F.posexplode("bins").alias("pos", "bin"))
    order = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.withColumn("first", F.coalesce(F.sum("bin.count").over(order), F.lit(0)) + 1)
    runs = packed.select("session_id", "pos", "first", F.col("bin.count").alias("count"), F.explode("bin.content").alias("c")).select("session_id", "pos", "first", "count", F.col("c.size").alias("size"), F.col("c.n").alias("each"))
    upto = Window.partitionBy("session_id", "size").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("lo", F.coalesce(F.sum(F.col("count") * F.col("each")).over(upto), F.lit(0)))
    by_size = runs.groupBy("session_id", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "first", "each"))).alias("runs"))
    rows = entry_rows(entries)
    piece = F.when(F.col("tokens") <= capacity, F.col("tokens")).otherwise(F.col("tokens") % capacity).cast("int")
    rows = rows.withColumn("size", piece).filter("size > 0")
    ranked = spread_row_number(rows, ["session_id", "size"], [F.col("priority").desc(), F.col("relevance").desc(), F.col("id")], "rank")
    both = ranked.alias("r").join(by_size.alias("s"), F.col("r.session_id").eqNullSafe(F.col("s.session_id")) & (F.col("r.size") == F.col("s.size")))
    run = F.element_at(F.filter("runs", lambda x: x["lo"] < F.col("rank")), -1)
    both = both.withColumn("run", run)
    window = F.col("run.first") + F.floor((F.col("rank") - 1 - F.col("run.lo")) / F.col("run.each"))
    return both.select(F.col("r.session_id").alias("session_id"), "id", F.col("r.size").cast("long").alias("tokens"), window.cast("long").alias("window"))
