"""Personal information inside free text (problem 2): found by the tagger, replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tagger import LABELS, Tagger, spans

#: The tagger fitted by ``labelled``.
MODEL = Path(__file__).with_name("tagger.npz")

_AT = re.compile(r"@|\bat\b|\(at\)|\[at\]", re.IGNORECASE)


def holds(kind: str, value: str) -> bool:
    """Whether what was tagged can be of this kind at all: enough digits or letters, a sign for at in an email."""
    digits = sum(c.isdigit() for c in value)
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 5
    if kind == "street_address":
        return digits >= 1 and sum(c.isalpha() for c in value) >= 3
    if kind == "email":
        return bool(_AT.search(value)) and len(value) >= 5
    return sum(c.isalpha() for c in value) >= 2


#: Characters that are scored at once; a longer text is taken alone, but whole.
AT_ONCE = 2_000_000


def _portions(texts: list[str]) -> Iterator[list[str]]:
    portion, size = [], 0
    for t in texts:
        if portion and size + len(t) > AT_ONCE:
            yield portion
            portion, size = [], 0
        portion.append(t)
        size += len(t)
    if portion:
        yield portion


def find_in(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of what each text holds, without white space at the ends."""
    out = []
    for text, labels in ((t, y) for p in _portions(texts) for t, y in zip(p, tagger.tag(p))):
        found = []
        if np.count_nonzero(labels):
            for a, b, k in spans(labels):
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if holds(LABELS[k], text[a:b]):
                    found.append((a, b, LABELS[k]))
        out.append(found)
    return out


def _find(model: bytes | None, path: str, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        tagger = Tagger.load(io.BytesIO(model) if model else path)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            different = list(dict.fromkeys(texts[i] for i in some))
            of = dict(zip(different, find_in(tagger, different)))
            found = {i: of[texts[i]] for i in some}
            rows = some if not redact else range(len(texts))
            if redact:
                new = []
                for i in rows:
                    t = texts[i]
                    for a, e, kind in reversed(found.get(i, [])):
                        t = f"{t[:a]}[{kind.upper()}]{t[e:]}"
                    new.append(t)
                yield pa.RecordBatch.from_arrays([ids, pa.array(new, pa.string()), pa.array([len(found.get(i, [])) for i in rows], pa.int32())], names=["id", "text", "replaced"])
                continue
            flat = [(i, *s, texts[i][s[0] : s[1]]) for i in rows for s in found[i]]
            cols = list(zip(*flat)) if flat else [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["id", "start", "end", "kind", "value"])

    return run


def _weights(path: str | Path) -> bytes:
    return Path(path).read_bytes()


def personal_spans(df: DataFrame, row_id: Column, text: Column, model: str | Path = MODEL) -> DataFrame:
    """(id, start, end, kind, value) of every piece of personal data, places in characters from 0, whole texts.

    Null and empty texts hold nothing; repeated rows come out repeatedly; a null id stays null. Nothing is shuffled.
    """
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    rows = df.select(row_id.cast("string").alias("id"), text.cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(_find(_weights(model), "", False), out)


def replace_personal(df: DataFrame, row_id: Column, text: Column, model: str | Path = MODEL) -> DataFrame:
    """(id, text, replaced): each row's text with placeholders such as [EMAIL], the rest unchanged; null stays null."""
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("replaced", T.IntegerType())])
    return df.select(row_id.cast("string").alias("id"), text.cast("string").alias("text")).mapInArrow(_find(_weights(model), "", True), out)
