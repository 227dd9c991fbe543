"""Most similar vectors by multi-index hashing (problem 3).

Vectors become binary codes of 128 bits by learned rotations (iterative quantisation on a bounded sample). Codes are cut
into substrings, each of which is an index of its own. By the pigeonhole principle, codes that differ in at most r bits
differ in at most floor(r / m) bits in one of m substrings (in one less but for the first r mod m + 1 of them), so looking
into all buckets within that radius meets every code within r; what it meets is reranked on floats.

Buckets are not probed by a join for each. Rows are grouped by the leading bits of a substring, so that a group fits in
memory, a row goes to the groups that its own bits come near, and a task probes the other bits by binary search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import latest_rows
from ..session import broadcast_if_small, cut

#: Vectors of one length that the rotations are learned from, at most; every vector is indexed.
FIT_ROWS = 4096
#: Bits of a code.
BITS = 128
#: Rows that a group should have, and rows that are probed at once.
GROUP, AT_ONCE = 1 << 15, 1 << 17
#: Query vectors that a task holds at once where they are compared with all; and rows that it compares at once.
BLOCK, CHUNK = 4096, 1024


def learn_rotations(x: np.ndarray, bits: int, seed: int = 7, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dim, bits) and thresholds: as many orthogonal rotations as needed, each fitted to its own signs."""
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    blocks = []
    for _ in range(math.ceil(bits / dim)):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(x) >= dim else 0):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ vt
        blocks.append(r)
    r = np.concatenate(blocks, axis=1)[:, :bits]
    at = np.median(x @ r, axis=0) if len(x) else np.zeros(bits)
    # a threshold near the middle halves the rows; it is kept small, as the angle is what counts
    return r.astype(np.float32), np.clip(at, -0.05, 0.05).astype(np.float32)


def hamming_radius(cosine: float, recall: float) -> int:
    """Least number of bits within which the codes of two vectors at this similarity are with chance ``recall``."""
    flip, got = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 0.0
    for r in range(BITS):
        got += math.comb(BITS, r) * flip**r * (1 - flip) ** (BITS - r)
        if got >= recall:
            return r
    return BITS


def plan_index(largest: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, probing radius) of each substring, that together meet every code within ``radius``.

    Of all numbers of substrings the one is taken that costs least for ``largest`` rows: a row for each substring, a
    search for each bucket, a comparison for each code that stands in one by chance.
    """

    def split(m: int) -> list[tuple[int, int, int]]:
        each, more = divmod(BITS, m)
        q, a = divmod(radius, m)
        out, at = [], 0
        for i in range(m):
            n = each + (i < more)
            if (near := q if i <= a else q - 1) >= 0:
                out.append((at, n, near))
            at += n
        return out

    def cost(parts: list[tuple[int, int, int]]) -> float:
        return sum(10 + (balls := sum(math.comb(n, r) for r in range(near + 1))) * (1 + 0.05 * largest / 2**n) for _, n, near in parts)

    return min((split(m) for m in range(BITS // 30 + 1, min(radius + 1, 64) + 1)), key=cost, default=[(0, 30, 0)])


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scan(asked: dict[str, tuple[np.ndarray, np.ndarray]], k: int):
    """The k best rows of a task for each query of ``asked``, {collection: (vids, unit vectors)}; scores to 9 digits, ties by id."""
    schema = pa.schema([("q", pa.int64()), ("vid", pa.int64()), ("id", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        for b in batches:
            names = np.array(b.column("collection_id").to_pylist(), object)
            vids, ids = b.column("vid").to_numpy(), np.array(b.column("id").to_pylist(), object)
            vec = b.column("vector")
            flat, starts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            for name in set(names.tolist()) & asked.keys():
                qv, qx = asked[name]
                mine = np.flatnonzero(names == name)
                for at in range(0, len(mine), CHUNK):
                    rows = mine[at : at + CHUNK]
                    x = _unit(flat[starts[rows][:, None] + np.arange(qx.shape[1])])
                    score = np.round(qx @ x.T, 9)
                    score[qv[:, None] == vids[rows]] = -np.inf
                    had = best.get(name) or (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object), np.full(len(qv), -2.0))
                    least = had[4]
                    if len(rows) >= k:
                        least = np.maximum(least, np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k])
                    i, j = np.nonzero(score >= least[:, None])
                    q, s, v, n = (np.concatenate(c) for c in zip(had[:4], (i, score[i, j], vids[rows][j], ids[rows][j])))
                    order = np.lexsort((n, -s, q))
                    q, s, v, n = q[order], s[order], v[order], n[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    least = least.copy()
                    least[q[rank == k - 1]] = np.maximum(least[q[rank == k - 1]], s[rank == k - 1])
                    keep = rank < k
                    best[name] = q[keep], s[keep], v[keep], n[keep], least
        for name, (q, s, v, n, _) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[name][0][q]), pa.array(v, pa.int64()), pa.array(n, pa.string()), pa.array(s)], schema=schema)

    return run


def _encoder(models: dict):
    schema = pa.schema([("collection_id", pa.string()), ("id", pa.string()), ("updated_at", pa.int64()), ("created_at", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64()), ("usable", pa.bool_()), ("c0", pa.int64()), ("c1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, vec, dims = b.num_rows, b.column("vector"), b.column("dim").to_numpy(zero_copy_only=False)
            usable, codes = np.zeros(n, bool), np.zeros((n, 2), np.int64)
            lengths = vec.value_lengths().fill_null(-1).to_numpy()
            starts = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for dim, (r, at) in models.items():
                rows = np.flatnonzero((lengths == dim) & (dims == dim))
                if not len(rows):
                    continue
                x = flat[starts[rows][:, None] + np.arange(dim)]
                ok = np.isfinite(x).all(1) & (x != 0).any(1)
                rows, x = rows[ok], x[ok]
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                usable[rows] = True
                codes[rows] = np.packbits(x.astype(np.float32) @ r > at, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("collection_id", "id", "updated_at", "created_at", "v1", "v2")] + [pa.array(usable), pa.array(codes[:, 0]), pa.array(codes[:, 1])], schema=schema)

    return run


def _bits(words: np.ndarray, first: int, n: int) -> np.ndarray:
    """Bits [first, first + n) of codes (rows, 2)."""
    if first >= 64:
        out = words[:, 1] >> np.uint64(first - 64)
    else:
        out = words[:, 0] >> np.uint64(first)
        if first + n > 64:
            out = out | (words[:, 1] << np.uint64(64 - first))
    return out & np.uint64((1 << n) - 1)


def _prober(parts: list[tuple[int, int, int]], radius: int, asked: bool):
    """Pairs of codes within ``radius`` out of groups of rows sorted by key; with ``asked``, pairs (query, row) only."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("collection", pa.int64())])
    ones = lambda x: np.bitwise_count(x[:, 0]).astype(np.int16) + np.bitwise_count(x[:, 1])
    cover = np.array([[sum(1 << i for i in range(f, f + n) if i < 64), sum(1 << (i - 64) for i in range(f, f + n) if i >= 64)] for f, n, _ in parts], np.uint64)

    def probe(key, vid, code, info, collection):
        t, high, spent, home = info & 255, (info >> 8) & 255, (info >> 16) & 255, (info >> 24) & 1 == 1
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (collection[1:] != collection[:-1])]).astype(np.uint64)
        for i in np.unique(t).tolist():
            first, n, near = parts[i]
            mine = np.flatnonzero(t == i)
            low = _bits(code[mine], first, n) & ((np.uint64(1) << (n - high[mine]).astype(np.uint64)) - np.uint64(1))
            at = (group[mine] << np.uint64(32)) | low
            rows = np.flatnonzero(home[mine])
            rows = rows[np.argsort(at[rows], kind="stable")]
            where = at[rows]
            queries = np.flatnonzero(~home[mine]) if asked else np.arange(len(mine))
            if not len(rows) or not len(queries):
                continue
            width = int((n - high[mine]).max())
            for flips in range(near + 1):
                able = queries[near - spent[mine][queries] >= flips]
                able = able[np.argsort(at[able], kind="stable")]
                for bits in combinations(range(width), flips):
                    mask = np.uint64(sum(1 << b for b in bits))
                    target = at[able] ^ mask
                    lo, hi = np.searchsorted(where, target, "left"), np.searchsorted(where, target, "right")
                    for q, r in _expanded(able, lo, hi - lo):
                        q, r = mine[q], mine[rows[r]]
                        both = np.flatnonzero(~home[q] | (q < r))
                        q, r = q[both], r[both]
                        x = code[q] ^ code[r]
                        close = np.flatnonzero((ones(x) <= radius) & (vid[q] != vid[r]))
                        q, r, x = q[close], r[close], x[close]
                        for j in range(i):  # an earlier substring meets the pair, too
                            if len(q):
                                new = ones(x & cover[j]) > parts[j][2]
                                q, r, x = q[new], r[new], x[new]
                        if len(q):
                            u, v = vid[q], vid[r]
                            yield (u, v, collection[q]) if asked else (np.minimum(u, v), np.maximum(u, v), collection[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(columns):
            code = np.stack([columns[2], columns[3]], 1).view(np.uint64)
            for found in probe(columns[0], columns[1], code, columns[4].astype(np.int64), columns[5]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy() for i in range(6)])
            size += b.num_rows
            if size >= AT_ONCE:
                columns = [np.concatenate(c) for c in zip(*held)]
                end = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last group may go on
                if end:
                    yield from flush([c[:end] for c in columns])
                held, size = [[c[end:] for c in columns]], size - end
        if size:
            yield from flush([np.concatenate(c) for c in zip(*held)])

    return run


def _expanded(queries: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) for ``count`` successive rows from ``start`` for each query, about ``most`` at a time."""
    some = np.flatnonzero(count)
    queries, start, count = queries[some], start[some], count[some]
    upto = np.cumsum(count)
    at = 0
    while at < len(queries):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + most, "right")))
        c = count[at:to]
        inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(queries[at:to], c), np.repeat(start[at:to], c) + inside
        at = to


def _cosine(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, p: s + p.cast("double") * p))
    return dot / (norm(a) * norm(b))


def _content() -> list:
    """128 bits for what a vector holds."""
    return [F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2")]


class VectorIndex:
    """Codes of every usable vector of ``vectors`` (id, collection_id, vector, updated_at, created_at) for ``collections`` (id, dim).

    Per (id, collection_id) only the newest row counts. A vector is usable if its collection is registered under exactly
    this id with exactly this length, and all its values are finite, not all zero; null ids, vectors and elements are
    not usable. The rotations are learned from at most ``fit_rows`` vectors of each length, chosen by a hash.
    """

    def __init__(self, vectors: DataFrame, collections: DataFrame, cosine: float = 0.97, recall: float = 0.997, fit_rows: int = FIT_ROWS, group: int = GROUP):
        self.cosine, self.group = cosine, group
        self.radius = hamming_radius(cosine, recall)
        dims = collections.filter("id IS NOT NULL").groupBy(F.col("id").alias("collection_id")).agg(F.max("dim").cast("long").alias("dim"))
        self.raw = vectors.filter("id IS NOT NULL").select("id", "collection_id", F.col("vector").cast("array<float>").alias("vector"), F.col("updated_at").cast("long").alias("updated_at"), F.col("created_at").cast("long").alias("created_at")).join(dims, "collection_id")
        of = {r[0]: r[1] for r in self.raw.groupBy("dim").count().collect() if r[0] and r[0] > 0}  # one row for each length
        models = {}
        for dim in sorted(of):
            share = min(1.0, 1.3 * fit_rows / max(1, of[dim]))
            some = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) <= int(share * (1 << 30))
            good = self.raw.filter((F.col("dim") == dim) & (F.size("vector") == dim) & some).select("vector")
            sample = [r[0] for r in good.limit(fit_rows).collect()]
            x = np.array([[np.nan if e is None else e for e in v] for v in sample], float).reshape(-1, dim)
            x = x[np.isfinite(x).all(1) & (x != 0).any(1)]
            models[dim] = learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), BITS)
        schema = "collection_id string, id string, updated_at long, created_at long, v1 long, v2 long, usable boolean, c0 long, c1 long"
        coded = self.raw.select("collection_id", "id", "updated_at", "created_at", "vector", "dim", *_content()).mapInArrow(_encoder(models), schema)
        newest = latest_rows(coded, ["id", "collection_id"], ["updated_at", "created_at", "v1", "v2"]).filter("usable")
        # the numbers of the rows are fixed by what is written
        self.codes = cut(newest.select("collection_id", "id", "v1", "v2", "c0", "c1", F.monotonically_increasing_id().alias("vid")))
        sizes = self.codes.groupBy("collection_id").agg(F.count("*").alias("rows"))
        self.largest = sizes.agg(F.max("rows")).first()[0] or 0  # one number
        self.parts = plan_index(self.largest, self.radius)
        lead = F.greatest(F.ceil(F.log2(F.col("rows") / group)), F.lit(0)).cast("int")
        self.leads = sizes.select("collection_id", lead.alias("lead"))

    def _heads(self) -> DataFrame:
        """(collection_id, v1, v2, vid, copies) of the first of each group of exact copies."""
        return self.codes.groupBy("collection_id", "v1", "v2").agg(F.min("vid").alias("vid"), F.count("*").alias("copies"))

    def _subs(self, rows: DataFrame, visits: str) -> DataFrame:
        """``rows`` (collection_id, vid, c0, c1) once for each substring and group they go to: all by themselves (``own``), also those above (``up``), or all (``all``)."""
        most = max(0, math.ceil(math.log2(max(1, self.largest) / self.group))) if self.largest else 0
        masks = sorted(sum(1 << b for b in bits) for n in range(max(p[2] for p in self.parts) + 1) for bits in combinations(range(most), n))
        subs = []
        for first, n, near in self.parts:
            if first >= 64:
                word = F.shiftrightunsigned("c1", first - 64)
            else:
                word = F.shiftrightunsigned("c0", first)
                if first + n > 64:
                    word = word.bitwiseOR(F.shiftleft("c1", 64 - first))
            subs.append(F.struct(word.bitwiseAND(F.lit((1 << n) - 1)).alias("sub"), F.lit(n).alias("bits"), F.lit(near).alias("near")))
        rows = rows.join(broadcast_if_small(self.leads), "collection_id").select("collection_id", "vid", "c0", "c1", "lead", F.posexplode(F.array(*subs)).alias("t", "s"))
        lead = F.least(F.col("lead"), F.col("s.bits"))
        rows = rows.select("collection_id", "vid", "c0", "c1", "t", lead.alias("lead"), F.expr("CAST(shiftright(s.sub, s.bits - least(lead, s.bits)) AS INT)").alias("high"), "s.near")
        rule = {"own": "m = 0", "up": "(high ^ m) >= high", "all": "true"}[visits]
        rows = rows.withColumn("m", F.explode(F.expr(f"filter(array({', '.join(map(str, masks))}), m -> m < shiftleft(1, lead) AND bit_count(m) <= near AND {rule})")))
        info = F.expr(f"t + shiftleft(lead, 8) + shiftleft(CAST(bit_count(m) AS INT), 16) + CASE WHEN m = 0 AND {str(visits != 'all').lower()} THEN {1 << 24} ELSE 0 END")
        return rows.select(F.xxhash64("collection_id", "t", F.expr("high ^ m")).alias("key"), "vid", "c0", "c1", info.alias("info"), F.xxhash64("collection_id").alias("collection"))

    def _probed(self, rows: DataFrame, asked: bool) -> DataFrame:
        """(a, b, collection): pairs within the radius of the rows of :meth:`_subs`.

        A group that is far larger than planned, as its vectors crowd, is dealt out: each row stands in one part and
        goes to those after it, so no task holds all of it.
        """
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 8 * self.group)
        crowded = cut(sizes.select("key", F.ceil(F.col("n") / (2 * self.group)).cast("int").alias("deal")))
        if not crowded.isEmpty():
            home = F.col("info") >= 1 << 24
            dealt = rows.join(crowded, "key", "left").withColumn("deal", F.coalesce("deal", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("deal")).cast("int"))
            to = F.when(home, F.sequence(F.col("own"), F.when(F.lit(asked), F.col("own")).otherwise(F.col("deal") - 1))).otherwise(F.sequence(F.lit(0), F.col("deal") - 1))
            dealt = dealt.withColumn("to", F.explode(to))
            here = F.when(home & (F.col("to") != F.col("own")), F.col("info") - (1 << 24)).otherwise(F.col("info")).cast("int")
            rows = dealt.select(F.when(F.col("deal") > 1, F.xxhash64("key", "to")).otherwise(F.col("key")).alias("key"), "vid", "c0", "c1", here.alias("info"), "collection")
        parted = rows.repartition("key").sortWithinPartitions("key", "info", "collection", "vid")
        return parted.mapInArrow(_prober(self.parts, self.radius, asked), "a long, b long, collection long")

    def candidates(self) -> DataFrame:
        """(a, b), a < b: every pair of different vectors of one collection whose codes are within the radius; copies are joined as one."""
        heads = self.codes.join(self._heads().select("collection_id", "vid"), ["collection_id", "vid"], "left_semi").select("collection_id", "vid", "c0", "c1")
        return self._probed(self._subs(heads, "up"), False).select("a", "b").distinct()

    def nearest(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(collection_id, query_id, id, cosine, rank): the k most similar vectors of the same collection for each query.

        ``queries`` has (collection_id, id) of indexed vectors; a vector isn't its own neighbour, ties go by id. Probing
        meets every code within the radius, which settles a query whose k-th cosine is at least the index's: vectors as
        similar as that are within the radius with the chance ``recall``. All other queries, and those that meet fewer
        than k, are compared with every vector of their collection, as no radius that is worth probing holds their
        neighbours.
        """
        asked = cut(self.codes.join(queries.select("collection_id", "id").distinct(), ["collection_id", "id"], "left_semi"))
        both = self._subs(self.codes.select("collection_id", "vid", "c0", "c1"), "own").unionByName(self._subs(asked.select("collection_id", "vid", "c0", "c1"), "all"))
        met = self._probed(both, True).select(F.col("a").alias("q"), F.col("b").alias("vid")).distinct()
        probed = cut(self._best(cut(met), k))
        settled = probed.groupBy("q").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).filter((F.col("n") >= k) & (F.col("least") >= self.cosine))
        open_ = asked.select("vid", "collection_id").join(settled.select(F.col("q").alias("vid")), "vid", "left_anti")
        best = probed.join(settled.select("q"), "q", "left_semi").unionByName(self._best(self._compared(open_, k), k))
        names = self.codes.select(F.col("vid").alias("q"), F.col("id").alias("query_id"))
        return best.join(names, "q").select("collection_id", "query_id", "id", "cosine", "rank")

    def _best(self, met: DataFrame, k: int) -> DataFrame:
        """(q, vid, collection_id, id, cosine, rank) of the k best by float cosine among the pairs (q, vid) of ``met``."""
        floats = self._floats(met.select("vid").unionByName(met.select(F.col("q").alias("vid"))).distinct())
        scored = met.join(floats.select(F.col("vid").alias("q"), F.col("vector").alias("va")), "q").join(floats.select("vid", F.col("vector").alias("vb")), "vid")
        scored = scored.select("q", "vid", _cosine("va", "vb").alias("cosine")).join(self.codes.select("vid", "collection_id", "id"), "vid")
        w = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "vid", "collection_id", "id", "cosine", "rank")

    def _compared(self, asked: DataFrame, k: int) -> DataFrame:
        """(q, vid) of the k most similar to each of ``asked`` (vid, collection_id), out of all vectors of its collection.

        The queries go to the tasks in blocks; a task keeps k rows for each, which a window merges.
        """
        inside = self.codes.join(asked.select("collection_id").distinct(), "collection_id", "left_semi").select("vid", "collection_id", "id")
        base = cut(inside.join(self._floats(inside.select("vid")), "vid"))
        wanted = base.join(asked.select("vid"), "vid", "left_semi").select("collection_id", "vid", "vector").orderBy("collection_id", "vid").toLocalIterator()
        out = None
        while block := list(islice(wanted, BLOCK)):
            by = {}
            for r in block:
                by.setdefault(r["collection_id"], []).append(r)
            by = {c: (np.array([r["vid"] for r in rs], np.int64), _unit([r["vector"] for r in rs])) for c, rs in by.items()}
            one = cut(base.filter(F.col("collection_id").isin(list(by))).mapInArrow(_scan(by, k), "q long, vid long, id string, score double"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return asked.select(F.col("vid").alias("q"), "vid").limit(0)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return cut(out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("q", "vid"))

    def _floats(self, need: DataFrame) -> DataFrame:
        """(vid, vector) of the vectors needed, each in its newest state."""
        known = self.codes.join(need, "vid", "left_semi").select("collection_id", "id", "v1", "v2", "vid")
        floats = self.raw.select("collection_id", "id", "vector", *_content()).join(broadcast_if_small(known, 10_000), ["collection_id", "id", "v1", "v2"])
        return floats.groupBy("vid").agg(F.first("vector").alias("vector"))

    def classes(self) -> DataFrame:
        """(collection_id, id, class, copies): for each vector the least row number among its exact copies, and how many they are."""
        return self.codes.join(self._heads().withColumnRenamed("vid", "class"), ["collection_id", "v1", "v2"]).select("collection_id", "id", "class", "copies")

    def class_pairs(self) -> DataFrame:
        """(a, b, cosine): pairs of classes with at least the index's cosine, but for few that are missed."""
        heads = cut(self.candidates())
        floats = self._floats(heads.select(F.col("a").alias("vid")).unionByName(heads.select(F.col("b").alias("vid"))).distinct())
        scored = heads.join(floats.select(F.col("vid").alias("a"), F.col("vector").alias("va")), "a").join(floats.select(F.col("vid").alias("b"), F.col("vector").alias("vb")), "b")
        return scored.select("a", "b", _cosine("va", "vb").alias("cosine")).filter(F.col("cosine") >= self.cosine)

    def pairs(self) -> DataFrame:
        """(collection_id, id_a, id_b, cosine): :meth:`class_pairs` between all members, and those of each class with each other."""
        member = self.classes()
        found = (
            self.class_pairs().join(member.select(F.col("class").alias("a"), "collection_id", F.col("id").alias("p")), "a")
            .join(member.select(F.col("class").alias("b"), F.col("collection_id").alias("other"), F.col("id").alias("q")), "b").filter("collection_id = other").select("collection_id", "p", "q", "cosine")
        )
        same = member.filter("copies > 1")
        copies = same.select("class", "collection_id", F.col("id").alias("p")).join(same.select("class", F.col("id").alias("q")), "class").filter("p < q")
        every = found.unionByName(copies.select("collection_id", "p", "q", F.lit(1.0).alias("cosine")))
        return every.select("collection_id", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "cosine")
