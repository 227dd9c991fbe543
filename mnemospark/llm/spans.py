"""Long exact spans shared between records (problem 10).

The tokens are characters, since spans are asked for in characters. Every window of the full length gets a Rabin-Karp
hash, the windows are counted in Spark, and repeated ones merge into maximal intervals. To keep what is shuffled small,
windows are counted twice: first together with all others that have the same least seed (the least hash of the windows
of half the length inside), by one row for each different seed of a text; a seed that stands in one text only settles
all windows that have it, as equal windows have equal least seeds. Every other window is counted by its own hash of 80
bits. The texts that hold a window are known by their number and the combined hash of their keys, so records that share
windows with the same texts form one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Odd multipliers of the two hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Texts that hold a window, up to which its rows are counted in one task; those of more are dealt out.
PER_TASK = 100_000
#: Rows of a batch that goes to Spark.
BATCH = 1 << 16
#: Characters that are hashed at once, few enough for a processor's cache; a longer text is taken whole.
CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Rabin-Karp hashes modulo 2**64 of windows at any place, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(self.base, n + n // 4 + 2), _powers(self.inverse, n + n // 4 + 2)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(0x51ED27)) * self.up[:n], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, k: int, lo: int, hi: int) -> np.ndarray:
        """Mixed hashes of the windows of k characters that start in [lo, hi)."""
        h = (sums[lo + k : hi + k] - sums[lo:hi]) * self.down[lo:hi]
        h ^= h >> np.uint64(48)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of every ``width`` successive values, in about log2(width) passes."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[:-rest], x[rest:]) if rest else x


def least_seeds(codes: np.ndarray, ends: np.ndarray, hasher: Hasher, seed: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of the runs of stretches that have the same least seed.

    A stretch is ``near`` successive seeds of one of the texts laid end to end; ``ends`` has for each character the end of
    its text. The least hash of a stretch depends on nothing outside of it, so a text that holds the stretch has it, too.
    """
    n = len(codes) - seed + 1
    if n < near:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _slide(hasher.windows(hasher.sums(codes), seed, 0, n), near, np.minimum)
    inside = ends[: len(low)] - np.arange(len(low)) >= near + seed - 1
    low = np.where(inside, low | np.uint64(1), np.uint64(0))
    first = np.flatnonzero(np.diff(low, prepend=np.uint64(0)) != 0)
    last = np.append(first[1:], len(low)) - 1
    real = low[first] != 0
    return first[real], last[real], low[first[real]]


def code_points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    keys, parts, size = [], [], 0
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for row in zip(*columns):
            if row[1] is None or len(row[1]) < least:
                continue
            keys.append(row)
            parts.append(code_points(row[1]))
            size += len(parts[-1])
            if size >= CHUNK:
                yield keys, parts
                keys, parts, size = [], [], 0
    if keys:
        yield keys, parts


def _own(keys: list, parts: list[np.ndarray], hasher: Hasher, seed: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, hash) of the runs of windows of each text that have the same least seed."""
    sizes = np.array([len(p) for p in parts])
    stop = np.cumsum(sizes)
    first, last, h = least_seeds(np.concatenate(parts).astype(np.uint64), np.repeat(stop, sizes), hasher, seed, near)
    text = np.searchsorted(stop, first, "right")
    begin = (stop - sizes)[text]
    return text, first - begin, last - begin, h


def _seeds(least: int, seed: int, near: int):
    """The different least seeds of each text."""
    schema = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BASES[0])
        for rows, parts in _chunks(batches, least):
            text, _, _, h = _own(rows, parts, hasher, seed, near)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = (np.diff(text, prepend=-1) != 0) | (np.diff(h, prepend=np.uint64(0)) != 0)
            keys = np.array([(r[0], r[2]) for r in rows], np.int64).reshape(-1, 2)[text[new]]
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], schema=schema)

    return run


def _windows(least: int, seed: int, near: int):
    """Every window of the full length whose least seed stands in other texts, too: its hash, place and what it may share."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("first", pa.bool_()), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(BASES[0]), Hasher(BASES[1])
        for rows, parts in _chunks(batches, least):
            text, first, last, h = _own(rows, parts, one, seed, near)
            at = np.searchsorted(text, np.arange(len(rows) + 1))
            for i, (k1, _, k2, again) in enumerate(rows):
                known = {s["h"]: s["n"] for s in again}
                runs = [(int(first[j]), int(last[j]) + 1, known[x]) for j, x in zip(range(at[i], at[i + 1]), h[at[i] : at[i + 1]].view(np.int64).tolist()) if x in known]
                c = parts[i].astype(np.uint64)
                s1, s2 = one.sums(c), two.sums(c)
                seen = np.zeros(0, np.uint64)
                spans = [(p, min(p + BATCH, hi), n) for lo, hi, n in runs for p in range(lo, hi, BATCH)]
                while spans:
                    taken, size = [], 0
                    while spans and size < BATCH:
                        taken.append(spans.pop(0))
                        size += taken[-1][1] - taken[-1][0]
                    h1 = np.concatenate([one.windows(s1, least, p, q) for p, q, _ in taken])
                    h2 = np.concatenate([two.windows(s2, least, p, q) for p, q, _ in taken]) >> np.uint64(48)
                    pos = np.concatenate([np.arange(p, q, dtype=np.int32) for p, q, _ in taken])
                    most = np.concatenate([np.full(q - p, n, np.int64) for p, q, n in taken])
                    # windows that the text holds more than once count once
                    new = np.zeros(len(h1), bool)
                    values, where = np.unique(h1 ^ (h2 << np.uint64(40)), return_index=True)
                    new[where[~np.isin(values, seen)]] = True
                    if spans or len(seen):
                        seen = np.union1d(seen, values)
                    n = len(h1)
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(np.full(n, k1, np.int64)), pa.array(np.full(n, k2, np.int64)), pa.array(pos), pa.array(new), pa.array(most)], schema=schema)

    return run


class SharedSpans:
    """Spans of at least ``least`` characters (code points) that stand verbatim in more than one record.

    ``documents`` has doc_id and text. Null ids and texts are left out; several rows of one doc_id are one record with
    several texts, which is no pair with itself, though what its texts share is an interval. Equal texts are handled once, under a key of 128 bits. Shorter texts share nothing. Other columns play
    no part.
    """

    def __init__(self, documents: DataFrame, least: int = 400, per_task: int = PER_TASK):
        self.least, self.per_task = least, per_task
        seed = max(1, least // 2)
        near = least - seed + 1  # a window of full length is exactly one stretch of seeds
        texts = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter((F.col("doc_id").isNotNull()) & (F.length("text") >= least))
        texts = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
        self.members = texts.select("k1", "k2", "doc_id", F.length("text").alias("chars"))
        # equal texts once, reduced before they are shuffled; what follows keeps this partitioning
        once = texts.select("k1", "text", "k2").dropDuplicates(["k1", "k2"])
        kind = "h long, k1 long, k2 long"
        # counted from all rows, so that no text is shuffled for it; n may count equal texts, too
        all_seeds = texts.select("k1", "text", "k2").mapInArrow(_seeds(least, seed, near), kind)
        again = cut(all_seeds.groupBy("h").agg(F.count("*").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("h", "n"))
        seeds = once.mapInArrow(_seeds(least, seed, near), kind)
        self.hot = (again.agg(F.max("n")).first()[0] or 0) > per_task  # one number
        chosen = seeds.join(again, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "n")).alias("again"))  # a text's own seeds
        bodies = once.join(chosen, ["k1", "k2"]).select("k1", "text", "k2", "again")
        rows = bodies.mapInArrow(_windows(least, seed, near), "h1 long, h2 int, k1 long, k2 long, pos int, first boolean, most long")
        self.rows = rows

    def _counted(self, rows: DataFrame) -> DataFrame:
        """``rows`` of windows that stand in more than one text: with the number of these, and their keys combined.

        No task gets more rows of one window than about ``per_task`` texts have: where the least seed says that there may
        be more, they are summed up before they are shuffled, and what they sum up to is joined with them.
        """
        if "first" in rows.columns:
            texts, combined = F.sum(F.col("first").cast("long")), F.bit_xor(F.when(F.col("first"), F.xxhash64("k1", "k2")).otherwise(F.lit(0).cast("long")))
        else:
            texts, combined = F.count("*"), F.bit_xor(F.xxhash64("k1", "k2"))
        w = Window.partitionBy("h1", "h2")
        few = (rows.filter(F.col("most") <= self.per_task) if self.hot else rows).withColumns({"n": texts.over(w), "together": combined.over(w)})
        if not self.hot:
            return few.filter("n > 1")
        many = rows.filter(F.col("most") > self.per_task)
        total = many.groupBy("h1", "h2").agg(texts.alias("n"), combined.alias("together"))
        return few.unionByName(many.join(total, ["h1", "h2"])).filter("n > 1")

    def groups(self) -> DataFrame:
        """(n, together, k1, k2): for each window that is shared, the texts that hold it; each set of texts comes out once."""
        return self._counted(self.rows.filter("first").drop("first", "pos")).select("n", "together", "k1", "k2").distinct()

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), doc_id_a < doc_id_b, distinct: records that share a span."""
        groups = cut(self.groups())
        other = groups.select("n", "together", F.col("k1").alias("l1"), F.col("k2").alias("l2"))
        keys = groups.join(other, ["n", "together"]).filter("k1 < l1 OR (k1 = l1 AND k2 < l2)").select("k1", "k2", "l1", "l2").distinct()
        m = self.members.select("k1", "k2", "doc_id").distinct()
        a, b = m.withColumnRenamed("doc_id", "p"), m.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("doc_id").alias("q"))
        across = keys.join(a, ["k1", "k2"]).join(b, ["l1", "l2"]).select("p", "q")
        twice = m.groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1").select("k1", "k2")
        same = a.join(twice, ["k1", "k2"], "left_semi")
        same = same.join(same.withColumnRenamed("p", "q"), ["k1", "k2"]).select("p", "q")
        both = across.unionByName(same).filter("p <> q")
        return both.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()

    def _runs(self) -> DataFrame:
        """(k1, k2, start, end): repeated windows of each text, merged."""
        w = Window.partitionBy("k1", "k2").orderBy("pos")  # a text's own windows
        rows = self._counted(self.rows).select("k1", "k2", "pos")
        rows = rows.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) <= self.least, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
        return rows.groupBy("k1", "k2", "run").agg(F.min("pos").alias("start"), (F.max("pos") + self.least).alias("end")).drop("run")

    def intervals(self) -> DataFrame:
        """(doc_id, start, end): the maximal intervals of each record's text, in characters from 0, that stand elsewhere, too.

        A text that is the whole text of another record, too, is one interval.
        """
        m = self.members.distinct()
        whole = m.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("copies")).filter("copies > 1").select("k1", "k2")
        part = m.join(self._runs().join(whole, ["k1", "k2"], "left_anti"), ["k1", "k2"]).select("doc_id", "start", "end")
        return part.unionByName(m.join(whole, ["k1", "k2"], "left_semi").select("doc_id", F.lit(0).alias("start"), F.col("chars").alias("end")))

    def report(self) -> DataFrame:
        """(doc_id, chars, shared_chars, share) for each record with at least ``least`` characters."""
        got = self.intervals().groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("shared_chars"))
        sizes = self.members.distinct().groupBy("doc_id").agg(F.sum("chars").cast("long").alias("chars"))
        return sizes.join(got, "doc_id", "left").na.fill(0, ["shared_chars"]).withColumn("share", F.col("shared_chars") / F.col("chars"))
