"""Deeply nested JSON records to related flat tables (problem 4).

One pass: a depth-first visitor emits, for each record, tagged rows ``(tag, record_id, pk, parent_pk, path, kind,
payload)``; the rows of one tag are one flat table, written partitioned by tag and read with a schema of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import latest_rows

EMITTED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("tag", "record_id", "pk", "parent_pk", "path", "kind", "payload")]
)


def _refuse(text: str):
    raise ValueError(f"not JSON: {text}")


def parse_json(text: str):
    """Parse RFC 8259 text; ``ValueError`` if it is none. NaN and Infinity are refused, numbers of any length are taken."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        if "integer string conversion" in str(e):
            return json.loads(text, parse_constant=_refuse, parse_int=str)
        raise


def _parse_deep(text: str):
    """The same for texts nested deeper than the interpreter's stack: containers on a list, scalars by ``json``."""
    scalar = json.JSONDecoder(parse_constant=_refuse, parse_int=str)
    stack: list[list] = []  # [container, pending key]
    i, n, want, done = 0, len(text), "value", None
    while True:
        while i < n and text[i] in " \t\n\r":
            i += 1
        if i >= n:
            break
        c = text[i]
        if want == "end":
            raise ValueError("extra data")
        if want in ("value", "value_or_close") and c not in "}]":
            if c in "{[":
                new: dict | list = {} if c == "{" else []
                stack.append([new, None])
                want, i = ("key_or_close" if c == "{" else "value_or_close"), i + 1
                continue
            value, i = scalar.raw_decode(text, i)
        elif want in ("key", "key_or_close") and c == '"':
            stack[-1][1], i = scalar.raw_decode(text, i)
            while i < n and text[i] in " \t\n\r":
                i += 1
            if text[i : i + 1] != ":":
                raise ValueError("no colon")
            want, i = "value", i + 1
            continue
        elif c in "}]" and stack and want in ("key_or_close", "value_or_close", "comma"):
            if (c == "}") != isinstance(stack[-1][0], dict):
                raise ValueError("wrong bracket")
            value, i = stack.pop()[0], i + 1
        elif c == "," and want == "comma":
            want, i = ("key" if isinstance(stack[-1][0], dict) else "value"), i + 1
            continue
        else:
            raise ValueError(f"unexpected {c!r} at {i}")
        if not stack:
            done, want = (value,), "end"
            continue
        top, key = stack[-1]
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        want = "comma"
    if done is None:
        raise ValueError("unfinished")
    return done[0]


def escaped(name: str, signs: str = ".[]#") -> str:
    """A key or an id in which signs that part others are marked by a backslash."""
    for c in "\\" + signs:
        name = name.replace(c, "\\" + c)
    return name


def visit(tag: str, record_id: str | None, root) -> Iterator[tuple]:
    """Depth-first rows of one parsed record.

    Kinds: ``root`` (the record), ``object`` (an object that is an element of an array, at any depth), ``value`` (another
    element of an array). Objects outside arrays stay columns of their row, under dotted names. ``parent_pk`` is the key
    of the nearest row that contains this one. Keys hold the record's table and id and the place; in these and in names a
    dot, bracket or ``#`` that belongs to a JSON key or an id stands behind a backslash, so no two rows or columns meet in
    one name, and a null id is none that a record can have. ``path`` has the keys as they are. Empty objects and arrays
    are values of their row.
    """
    top = f"{tag}=" + escaped(record_id) if record_id is not None else f"{tag}~"
    # (row's tag, pk, parent pk, path, escaped path, kind, node); depth first, in document order
    todo = [(tag, top, None, "$", "$", "root", root)]
    while todo:
        at, pk, parent, path, place, kind, node = todo.pop()
        flat: dict = {}
        children: list[tuple] = []
        if isinstance(node, dict):
            inner = [("", path, place, node)]
            while inner:
                prefix, here, there, obj = inner.pop()
                for key, v in obj.items():
                    safe = escaped(key)
                    name, sub, safe_sub = prefix + safe, f"{here}.{key}", f"{there}.{safe}"
                    if v == {} or v == []:
                        flat[name] = v
                    elif isinstance(v, dict):
                        inner.append((name + ".", sub, safe_sub, v))
                    elif isinstance(v, list):
                        children.append((f"{at}.{name}", sub, safe_sub, v))
                    else:
                        flat[name] = v
        elif isinstance(node, list):
            children.append((at if kind == "root" else f"{at}.items", path, place, node))
        else:
            flat["value"] = node
        yield at, record_id, pk, parent, path, kind, json.dumps(flat, ensure_ascii=False, separators=(",", ":"))
        below: list[tuple] = []
        for child_tag, child_path, child_place, items in children:
            lists = [(child_path, child_place, items)]
            while lists:
                p, q, xs = lists.pop()
                for i, x in enumerate(xs):
                    if isinstance(x, list):
                        lists.append((f"{p}[{i}]", f"{q}[{i}]", x))
                    else:
                        below.append((child_tag, f"{top}#{q}[{i}]", pk, f"{p}[{i}]", f"{q}[{i}]", "object" if isinstance(x, dict) else "value", x))
        todo.extend(reversed(below))


def _emit(batches):
    schema = pa.schema([(f.name, pa.string()) for f in EMITTED])
    for batch in batches:
        out: list[tuple] = []
        tags, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        for tag, rid, text in zip(tags, ids, texts):
            if text is None:
                continue
            try:
                root = parse_json(text)
                if isinstance(root, str):
                    root = parse_json(root)
            except ValueError:
                continue
            out.extend(visit(tag, rid, root))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)


def flatten_json(df: DataFrame, tag: str, record_id, json_col: str) -> DataFrame:
    """Tagged rows of every record of ``df`` (see :func:`visit`).

    ``record_id`` is a column. Null or invalid JSON yields nothing; a field that is as a whole a JSON string holding JSON
    text is opened once. Of repeated keys in one object the last counts. A null record id stays null. Repeated records
    yield repeated rows: take :func:`latest_rows` first. Other columns of ``df`` play no part, whatever their names.
    """
    return df.select(F.lit(tag).alias("tag"), record_id.cast("string").alias("record_id"), F.col(f"`{json_col}`").cast("string").alias("json")).mapInArrow(_emit, EMITTED)


def write_tables(rows: DataFrame, path: str) -> None:
    """Write tagged rows partitioned by tag, one folder for each flat table."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, schema: T.StructType | Sequence[T.StructField]) -> DataFrame:
    """One flat table: keys and links, and the payload under ``schema`` (values that don't fit are null)."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType(list(schema))
    rows = spark.read.parquet(path).filter(F.col("tag") == tag)
    parsed = rows.withColumn("_p", F.from_json("payload", schema))
    return parsed.select("record_id", "pk", "parent_pk", "path", "kind", *[F.col(f"_p.`{f.name}`").alias(f"data_{f.name}") for f in schema])


def store_json_rows(vectors: DataFrame, nodes: DataFrame, workflows: DataFrame) -> DataFrame:
    """Tagged rows of the three stores' JSON fields, of the newest state of each key (by updated_at)."""
    v = latest_rows(vectors.select("id", "collection_id", "updated_at", "created_at", "metadata"), ["id", "collection_id"], ["updated_at", "created_at"])
    n = latest_rows(nodes.select("id", "updated_at", "created_at", "data"), ["id"], ["updated_at", "created_at"])
    w = latest_rows(workflows.select("id", "updated_at", "created_at", "input"), ["id"], ["updated_at", "created_at"])
    return (
        flatten_json(v, "adb_vectors", F.concat(F.col("collection_id"), F.lit("|"), F.col("id")), "metadata")
        .unionByName(flatten_json(n, "nodes", F.col("id"), "data"))
        .unionByName(flatten_json(w, "workflows", F.col("id"), "input"))
    )
