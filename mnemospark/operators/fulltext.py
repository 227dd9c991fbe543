"""Full-text search with BM25: index, query language, ranking and snippets.

Tokens are runs of ASCII letters and digits and of all non-ASCII characters; only ASCII is folded to lower case. The id of
a document is text, too: its tokens match and count in the document's length. A score is the sum over the phrases of
``-idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))``, so the best comes first in ascending order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..session import cut
from .porter import stem

K1, B = 1.2, 0.75
#: The least idf, for terms in half of the documents or more.
LEAST_IDF = 1e-6
#: Positions of the second column begin here.
TEXT_AT = 1 << 32

_TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text: str, stemmed: bool = True) -> list[str]:
    """Tokens of a text, on the driver."""
    out = [t.translate(_LOWER) for t in _TOKEN.findall(text)]
    return [stem(t) for t in out] if stemmed else out


_PAIRS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.LongType())), T.StructField("length", T.LongType())])


def _postings(stemmed: bool, terms: frozenset[str] | None = None, prefixes: tuple[str, ...] = ()):
    """Postings of (doc_id, text) rows, of all terms or of those wanted; and for each batch a row with term "" for its
    statistics: the number of documents as the only position, their tokens as the length."""
    schema = pa.schema([("doc_id", pa.string()), ("term", pa.string()), ("positions", pa.list_(pa.int64())), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}

        def term_of(raw: str) -> str | None:
            folded = raw.translate(_LOWER)
            t = stem(folded) if stemmed else folded
            if terms is not None and t not in terms and not (prefixes and t.startswith(prefixes)):
                t = None
            if len(known) < 500_000:
                known[raw] = t
            return t

        for b in batches:
            rows, total = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at: dict[str, list[int]] = {}
                n = 0
                for base, part in ((0, doc), (TEXT_AT, text or "")):
                    toks = _TOKEN.findall(part)
                    n += len(toks)
                    for i, raw in enumerate(toks):
                        t = known[raw] if raw in known else term_of(raw)
                        if t is not None:
                            at.setdefault(t, []).append(base + i)
                total += n
                rows += [(doc, t, p, n) for t, p in at.items()]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            rows.append((None, "", [b.num_rows], total))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


@dataclass
class Phrase:
    """Tokens in a row; the last one may be a prefix; at the first place of a column; within one column."""

    terms: list[str]
    prefix: bool = False
    first: bool = False
    column: str | None = None


@dataclass
class Near:
    """Phrases within so many tokens of each other."""

    phrases: list[Phrase]
    distance: int = 10


@dataclass
class Node:
    """AND, OR or NOT of two or more parts."""

    op: str
    parts: list = field(default_factory=list)


class QueryParser:
    """The query language: words, "phrases", prefix*, ^first, column : x, NEAR(a b, n), AND, OR, NOT, brackets.

    Words next to each other are all needed. NOT binds tightest, then AND, then OR. Operators are in capitals.
    """

    _LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[0-9A-Za-z_\x1a\u0080-\U0010ffff]+)|(?P<sign>[():*+^{},-]))')

    def __init__(self, stemmed: bool = True, columns: tuple[str, ...] = ("vec_id", "text")):
        self.stemmed, self.columns = stemmed, columns

    def parse(self, text: str):
        """The query's tree; ``InvalidArgument`` if it isn't one."""
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = self._LEX.match(text, at)
            if not m:
                raise InvalidArgument(f"syntax error near {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        if not self.items:
            raise InvalidArgument("empty query")
        self.at = 0
        out = self._or()
        if self.at < len(self.items):
            raise InvalidArgument(f"syntax error near {self.items[self.at][1]!r}")
        return out

    def _peek(self, k: int = 0):
        return self.items[self.at + k] if self.at + k < len(self.items) else (None, None)

    def _take(self, value: str | None = None):
        kind, text = self._peek()
        if kind is None or (value is not None and text != value):
            raise InvalidArgument(f"syntax error: expected {value or 'more'}")
        self.at += 1
        return kind, text

    def _chain(self, op: str, below):
        parts = [below()]
        while self._peek() == ("word", op):
            self._take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(op, parts)

    def _or(self):
        return self._chain("OR", self._and)

    def _and(self):
        return self._chain("AND", self._not)

    def _not(self):
        out = self._implicit()
        while self._peek() == ("word", "NOT"):
            self._take()
            out = Node("NOT", [out, self._implicit()])
        return out

    def _starts(self) -> bool:
        kind, text = self._peek()
        return kind in ("string",) or (kind == "word" and text not in ("AND", "OR", "NOT")) or (kind == "sign" and text in "(^{" )

    def _implicit(self):
        parts = [self._primary()]
        while self._starts():
            parts.append(self._primary())
        return parts[0] if len(parts) == 1 else Node("AND", parts)

    def _primary(self):
        kind, text = self._peek()
        if text == "(" and kind == "sign":
            self._take()
            out = self._or()
            self._take(")")
            return out
        if kind in ("word", "string") and self._peek(1) == ("sign", ":"):
            self._take()
            self._take(":")
            name = text.strip('"').lower()
            if name not in self.columns:
                raise InvalidArgument(f"no such column: {name}")
            return self._within(self._primary(), name)
        if kind == "word" and text == "NEAR" and self._peek(1) == ("sign", "("):
            self._take()
            self._take("(")
            phrases = []
            while self._starts():
                phrases.append(self._phrase())
            distance = 10
            if self._peek() == ("sign", ","):
                self._take()
                n = self._take()[1]
                if not n.isdigit():
                    raise InvalidArgument("expected a number in NEAR")
                distance = int(n)
            self._take(")")
            return Near(phrases, distance)
        return self._phrase()

    def _within(self, tree, name: str):
        for p in phrases_of(tree):
            p.column = p.column or name
        return tree

    def _phrase(self) -> Phrase:
        first = False
        if self._peek() == ("sign", "^"):
            self._take()
            first = True
        terms, prefix = [], False
        while True:
            kind, text = self._take()
            if kind not in ("word", "string") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise InvalidArgument(f"syntax error near {text!r}")
            raw = text[1:-1].replace('""', '"') if kind == "string" else text
            prefix = self._peek() == ("sign", "*")
            if prefix:
                self._take()
            terms += tokens_of(raw, self.stemmed)
            if self._peek() != ("sign", "+"):
                break
            self._take()
        return Phrase(terms, prefix, first)


def phrases_of(tree) -> list[Phrase]:
    """The phrases of a query that count in the score, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    parts = tree.parts[:1] if tree.op == "NOT" else tree.parts
    return [p for x in parts for p in phrases_of(x)]


def _all_phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    return [p for x in (tree.phrases if isinstance(tree, Near) else tree.parts) for p in _all_phrases(x)]


class TextIndex:
    """An inverted index over ``documents`` (id, text).

    Of several rows of one id the greatest text counts, unless ``unique`` says that there are none; null ids are left out,
    a null text has no tokens. An index that isn't saved is never built as a whole: a search makes the postings of its own
    terms in one pass over the texts. A saved one is sorted by term, and a search reads the parts with its terms.
    """

    def __init__(self, documents: DataFrame, stemmed: bool = True, unique: bool = False, searchable_ids: bool = True):
        self.stemmed, self.saved = stemmed, None
        rows = documents.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("doc_id"), "text")
        self.texts = rows if unique else rows.groupBy("doc_id").agg(F.max("text").alias("text"))
        self.searchable_ids = searchable_ids

    def _make(self, terms: frozenset[str] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
        emit = _postings(self.stemmed, terms, prefixes)
        if self.searchable_ids:
            return self.texts.mapInArrow(emit, _PAIRS)

        def without_ids(batches):
            def hidden():
                for b in batches:
                    kept.append(b.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([f"{i}" for i in range(b.num_rows)]), b.column(1)], names=["doc_id", "text"])

            kept: list[list] = []
            # a batch's rows go by number, one token each, which is taken off again
            for out in emit(hidden()):
                ids, term, pos, length = (out.column(i).to_pylist() for i in range(4))
                rows = []
                for i, t, p, n in zip(ids, term, pos, length):
                    if i is None:
                        rows.append((None, t, p, n - p[0]))
                    elif p := [x for x in p if x >= TEXT_AT]:
                        rows.append((kept[-1][int(i)], t, p, n - 1))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out.schema)], schema=out.schema)

        return self.texts.mapInArrow(without_ids, _PAIRS)

    def save(self, path: str) -> None:
        """Write the index."""
        self._make().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")

    @classmethod
    def open(cls, spark, path: str, stemmed: bool = True) -> "TextIndex":
        """Read an index that was saved."""
        out = cls.__new__(cls)
        out.stemmed, out.saved, out.searchable_ids = stemmed, spark.read.parquet(f"{path}/postings"), True
        out.texts = spark.read.parquet(f"{path}/texts")
        return out

    def _wanted(self, phrases: list[Phrase]) -> DataFrame:
        """The postings that a query needs and the statistics, written once."""
        exact = {t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)}
        starts = tuple(sorted({p.terms[-1] for p in phrases if p.prefix and p.terms}))
        if self.saved is None:
            return cut(self._make(frozenset(exact), starts))
        keep = F.col("term").isin("", *sorted(exact))
        for x in starts:
            keep = keep | F.col("term").startswith(x)
        return cut(self.saved.filter(keep))

    # ---- matching ----

    def _term(self, p: Phrase, i: int) -> DataFrame:
        t, last = p.terms[i], i == len(p.terms) - 1
        keep = F.col("term").startswith(t) if p.prefix and last else F.col("term") == t
        rows = self._now.filter("doc_id IS NOT NULL").filter(keep).select("doc_id", "length", "positions")
        if p.prefix and last:
            rows = rows.groupBy("doc_id", "length").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        return rows

    def _phrase(self, p: Phrase) -> DataFrame:
        """(doc_id, length, at): where the phrase begins in each document that has it."""
        if not p.terms:
            return self._now.filter(F.lit(False)).select("doc_id", "length", F.array().cast("array<bigint>").alias("at"))
        out = self._term(p, 0).withColumnRenamed("positions", "at")
        for i in range(1, len(p.terms)):
            nxt = self._term(p, i).select("doc_id", F.expr(f"transform(positions, x -> x - {i})").alias("p"))
            out = out.join(nxt, "doc_id").withColumn("at", F.array_intersect("at", "p")).drop("p")
        if p.column == "vec_id":
            out = out.withColumn("at", F.filter("at", lambda x: x < TEXT_AT))
        elif p.column == "text":
            out = out.withColumn("at", F.filter("at", lambda x: x >= TEXT_AT))
        if p.first:
            out = out.withColumn("at", F.filter("at", lambda x: (x == 0) | (x == TEXT_AT)))
        return out.filter(F.size("at") > 0)

    def _match(self, tree, found: dict[int, DataFrame]) -> DataFrame:
        """(doc_id) of the documents that match; ``found`` gets the places of each phrase."""
        if isinstance(tree, Phrase):
            found[id(tree)] = self._phrase(tree)
            return found[id(tree)].select("doc_id")
        if isinstance(tree, Near):
            for p in tree.phrases:
                found[id(p)] = self._phrase(p)
            if len(tree.phrases) < 2:
                return found[id(tree.phrases[0])].select("doc_id")
            out = None
            for k, p in enumerate(tree.phrases):
                one = found[id(p)].select("doc_id", F.col("at").alias(f"at{k}"))
                out = one if out is None else out.join(one, "doc_id")
            sizes, n, many = [len(p.terms) for p in tree.phrases], tree.distance, len(tree.phrases)

            def close(batches):
                for b in batches:
                    rows = []
                    for d, *ats in zip(*(b.column(i).to_pylist() for i in range(many + 1))):
                        if kept := _near(ats, sizes, n):
                            rows.append((d, kept))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "kept"])

            near = out.mapInArrow(close, "doc_id string, kept array<array<bigint>>")
            for k, p in enumerate(tree.phrases):
                found[id(p)] = found[id(p)].drop("at").join(near.select("doc_id", F.col("kept")[k].alias("at")), "doc_id")
            return near.select("doc_id")
        parts = [self._match(x, found) for x in tree.parts]
        out = parts[0]
        for x in parts[1:]:
            out = out.join(x, "doc_id", "left_anti" if tree.op == "NOT" else "left_semi") if tree.op != "OR" else out.unionByName(x)
        return out.distinct() if tree.op == "OR" else out

    def search(self, query: str, top_k: int | None = 10, snippets: bool = False) -> DataFrame:
        """(doc_id, rank[, snippet]) of the matching documents, best first, ties by id."""
        tree = QueryParser(self.stemmed).parse(query)
        found: dict[int, DataFrame] = {}
        self._now = self._wanted(_all_phrases(tree))
        match = self._match(tree, found)
        stats = self._now.filter("term = ''").agg(F.sum(F.col("positions")[0]).alias("total"), (F.sum("length") / F.sum(F.col("positions")[0])).alias("average"))
        scored = None
        for p in phrases_of(tree):
            hits = found[id(p)].select("doc_id", "length", F.size("at").alias("tf"))
            n = self._phrase(p).agg(F.count("*").alias("n"))  # wherever it stands, near or not
            one = hits.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(stats))  # one row each
            idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(0.0))
            idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
            tf = F.col("tf").cast("double")
            part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))
            one = one.select("doc_id", part.alias("s"))
            scored = one if scored is None else scored.unionByName(one)
        out = scored.groupBy("doc_id").agg((-F.sum("s")).alias("rank")).join(match.distinct(), "doc_id", "left_semi")
        if top_k is not None:
            out = out.orderBy("rank", "doc_id").limit(top_k)
        if snippets:
            terms = [(p.terms, p.prefix) for p in phrases_of(tree) if p.terms]
            rows = out.join(self.texts, "doc_id").select("doc_id", "rank", "text")
            out = rows.mapInArrow(_snippets(terms, self.stemmed), "doc_id string, rank double, snippet string").orderBy("rank", "doc_id")
        return out


def _near(ats: list[list[int]], sizes: list[int], n: int) -> list[list[int]] | None:
    """The places of each phrase that are close to one of every other: at most n tokens between its end and the last begin."""
    kept: list[set[int]] = [set() for _ in ats]
    for last in {x for at in ats for x in at}:
        inside = [[x for x in at if last - size - n <= x <= last] for at, size in zip(ats, sizes)]
        if all(inside):
            for k, xs in zip(kept, inside):
                k.update(xs)
    return [sorted(k) for k in kept] if kept[0] else None


def snippet(text: str, terms: list[tuple[list[str], bool]], stemmed: bool = True, width: int = 10, left: str = "<b>", right: str = "</b>", more: str = "...") -> str:
    """At most ``width`` tokens of the text around the most hits, hits marked; the first such place counts."""
    spots = [(m.start(), m.end(), m.group().translate(_LOWER)) for m in _TOKEN.finditer(text)]
    words = [stem(w) if stemmed else w for _, _, w in spots]
    hit = [False] * len(words)
    for seq, prefix in terms:
        for i in range(len(words) - len(seq) + 1):
            if words[i : i + len(seq) - 1] == seq[:-1] and (words[i + len(seq) - 1] == seq[-1] or (prefix and words[i + len(seq) - 1].startswith(seq[-1]))):
                hit[i : i + len(seq)] = [True] * len(seq)
    if len(words) <= width:
        lo, hi = 0, len(words)
    else:
        score = [sum(hit[i : i + width]) for i in range(len(words) - width + 1)]
        lo = max(range(len(score)), key=lambda i: (score[i], -i))
        hi = lo + width
    if not words:
        return text
    at, end = (0 if lo == 0 else spots[lo][0]), (len(text) if hi == len(words) else spots[hi - 1][1])
    out = more if lo else ""
    for i in range(lo, hi):
        if hit[i] and (i == lo or not hit[i - 1]):
            out += text[at : spots[i][0]] + left
            at = spots[i][0]
        if hit[i] and (i == hi - 1 or not hit[i + 1]):
            out += text[at : spots[i][1]] + right
            at = spots[i][1]
    return out + text[at:end] + (more if hi < len(words) else "")


def _snippets(terms, stemmed: bool):
    def run(batches):
        for b in batches:
            made = [snippet(t or "", terms, stemmed) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["doc_id", "rank", "snippet"])

    return run


def search_messages(messages: DataFrame, query: str, top_k: int = 10, conversation_id: str | None = None, stemmed: bool = False) -> DataFrame:
    """Messages (id, conversation_id, role, content) that match, with the statistics of all messages: (id, conversation_id, role, content, rank)."""
    # ids of messages aren't searchable
    index = TextIndex(messages.select("id", F.col("content").alias("text")), stemmed, searchable_ids=False)
    found = index.search(query, None)
    rows = found.join(messages.select("id", "conversation_id", "role", "content").dropDuplicates(["id"]), found.doc_id == F.col("id"))
    if conversation_id is not None:
        rows = rows.filter(F.col("conversation_id") == conversation_id)
    return rows.select("id", "conversation_id", "role", "content", "rank").orderBy("rank", "id").limit(top_k)
