"""Evaluation texts leaking into training text (problem 8): greedy string tiling on words.

Seeds, the Karp-Rabin hashes of ``least`` successive words, are joined: those of the corpus, made in one pass over it,
with those of the items. A filter of fixed size keeps out of the join what no item can have; it may let other seeds pass
but never drops one. Each document and item that share a seed are tiled: the longest match of unmarked words is marked
again and again, and how much of the item is covered tells whether it leaked, in whatever order its passages stand.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .spans import BASES, Hasher, code_points

_WORD = re.compile(r"[^\W_]+")
#: Odd multiplier of the Karp-Rabin hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Bits of the filter of the items' seeds, as a power of two, and bits that each seed sets.
FILTER_BITS, MARKS = 24, 3
#: Characters of text that are hashed at once; a longer text is taken whole.
CHUNK = 1 << 17


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the text in lower case."""
    return _WORD.findall(text.lower())


def tile(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of non-overlapping matches of at least ``least`` words.

    The longest match of unmarked words is marked first, ties from the left; matches are found from the seeds of
    ``least`` words that both share (Karp-Rabin, compared in full) and extended as far as nothing is marked.
    """
    seeds: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(_rolling(np.array(item, np.uint64), least)):
        seeds[int(h)].append(j)
    hits = [(i, j) for i, h in enumerate(_rolling(np.array(doc, np.uint64), least)) for j in seeds.get(int(h), ()) if doc[i : i + least] == item[j : j + least]]
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while hits:
        best, left = (0, 0, 0), []
        ends: dict[int, int] = {}  # diagonal -> end of its last match
        for i, j in hits:
            if any(used_d[i : i + least]) or any(used_i[j : j + least]):
                continue
            left.append((i, j))
            if ends.get(i - j, -1) > i:
                continue
            n = least
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_d[i + n] and not used_i[j + n]:
                n += 1
            ends[i - j] = i + n
            if n > best[2]:
                best = (i, j, n)
        if not best[2]:
            break
        i, j, n = best
        used_d[i : i + n] = [True] * n
        used_i[j : j + n] = [True] * n
        tiles.append(best)
        hits = left
    return tiles


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + ids[i : i + len(out)]
    return out


class WordHasher:
    """Hashes of successive words of many texts at once."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        self.chars, self.grams = Hasher(BASES[0]), Hasher(BASES[1])

    def seeds(self, texts: list[str], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, text, hash) of all ``k`` successive words of each text, for each k of ``sizes``."""
        codes = code_points("\n".join(texts).lower())
        stop = np.cumsum([len(t.lower()) + 1 for t in texts])  # where the next text begins
        inside = self.letter[np.minimum(codes, 0x10FFFF)]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(stop, first, "right")
        sums = self.chars.sums(codes.astype(np.uint64))
        h = (sums[last] - sums[first]) * self.chars.down[first]
        h ^= h >> np.uint64(29)
        grams = self.grams.sums(h)
        for k in sizes:
            n = len(h) - k + 1
            if n > 0:
                whole = np.flatnonzero(text[:n] == text[k - 1 :])
                yield k, text[whole], self.grams.windows(grams, k, 0, n)[whole]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            rows.append(row)
            size += len(row[1])
            if size >= CHUNK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _mark(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit that a hash sets in a filter of 2**bits bits."""
    return (h >> np.uint64(64 - bits - 20 * i)) & np.uint64((1 << bits) - 1)


def _item_seeds(least: int, bits: int):
    schema = pa.schema([("item", pa.int64()), ("k", pa.int32()), ("h", pa.int64()), ("marks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for rows in _portions(batches):
            for item, text in rows:
                k = min(least, len(words(text)))
                for _, _, h in hasher.seeds([text], [k] if k else []):
                    h = np.unique(h)
                    marks = np.stack([_mark(h, i, bits) for i in range(MARKS)], 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item)), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, marks.size + 1, MARKS, dtype=np.int32), marks.ravel())], schema=schema)

    return run


def _doc_seeds(sizes: list[int], packed: bytes, bits: int):
    """Documents with the seeds that pass the filter, those with any."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("seeds", pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(), np.frombuffer(packed, np.uint64)
        for rows in _portions(batches):
            found: dict[int, set] = defaultdict(set)
            for k, text, h in hasher.seeds([r[1] for r in rows], sizes):
                for i in range(MARKS):
                    m = _mark(h, i, bits)
                    able = (held[m >> np.uint64(6)] >> (m & np.uint64(63))) & np.uint64(1) == 1
                    text, h = text[able], h[able]
                for i, x in zip(text.tolist(), h.view(np.int64).tolist()):
                    found[i].add((k, x))
            if found:
                some = sorted(found)
                seeds = [[{"k": k, "h": x} for k, x in sorted(found[i])] for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.string()), pa.array(seeds, schema.field("seeds").type)], schema=schema)

    return run


def _tiler(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("longest", pa.int64()), ("covered", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, item_id, item in zip(*(b.column(i).to_pylist() for i in range(4))):
                vocab: dict[str, int] = {}
                seq = [vocab.setdefault(w, len(vocab) + 1) for w in words(item)]
                lengths = [t[2] for t in tile([vocab.get(w, 0) for w in words(text)], seq, min(least, len(seq)))]
                if lengths:
                    rows.append((doc_id, item_id, len(seq), max(lengths), sum(lengths)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], schema=schema)

    return run


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 13, coverage: float = 0.6, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, item_words, longest, covered, coverage, leaked) for each document and item that share a seed.

    A seed is ``least`` consecutive words, or all words of a shorter item. ``covered`` is the number of the item's words
    in tiles, ``leaked`` whether that is at least ``coverage`` of them: passages in another order count, too. Several
    rows of one document or item give a row each; items without words match nothing, null texts and ids are left out.
    The corpus is read once; a filter of 2**``filter_bits`` bits (at least 64, at most 2**24) goes to every task; the items' seeds are broadcast if they are few, which is counted, else joined by a shuffle.
    """
    docs = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text"))
    known = cut(known.withColumn("item", F.monotonically_increasing_id()))
    seeds = cut(known.select("item", "item_text").mapInArrow(_item_seeds(least, filter_bits), "item long, k int, h long, marks array<int>"))
    sizes = sorted(r[0] for r in seeds.select("k").distinct().collect())  # at most ``least``
    # the filter: at most 2**filter_bits / 64 words, however many seeds there are
    words_ = seeds.select(F.explode("marks").alias("m")).groupBy(F.expr("shiftright(m, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), m & 63)")).alias("bits"))
    held = np.zeros(1 << (filter_bits - 6), np.int64)
    for r in words_.toLocalIterator():
        held[r["w"]] = r["bits"]
    hits = cut(docs.mapInArrow(_doc_seeds(sizes, held.tobytes(), filter_bits), "doc_id long, text string, seeds array<struct<k:int,h:long>>").withColumn("row", F.monotonically_increasing_id()))
    shared = hits.select("row", F.explode("seeds").alias("s")).select("row", F.col("s.k").alias("k"), F.col("s.h").alias("h"))
    shared = shared.join(broadcast_if_small(seeds.select("k", "h", "item")), ["k", "h"]).select("row", "item").distinct()
    both = hits.select("row", "doc_id", "text").join(shared, "row").join(broadcast_if_small(known), "item").select("doc_id", "text", "item_id", "item_text")
    out = both.mapInArrow(_tiler(least), "doc_id long, item_id long, item_words long, longest long, covered long")
    share = F.col("covered") / F.col("item_words")
    return out.withColumn("coverage", share).withColumn("leaked", share >= coverage)
