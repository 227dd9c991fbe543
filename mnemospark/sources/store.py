"""A mutable store on Parquet: change logs under a versioned manifest, one writer, atomic transactions.

Every table is a log of rows with ``_seq`` and ``_op`` (put or delete); what it holds is, for each key, the last put that
no delete follows. A write adds a file; a transaction adds several and publishes one manifest, or none. Tables without a
key (made by SQL) are rewritten as a whole.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Corruption, InvalidArgument, SchemaMigration
from ..schemas import APPEND_ONLY, CASCADES, KEYS, REQUIRED, SCHEMAS, VERSION
from ..session import scratch


def now_ms() -> int:
    """Epoch milliseconds."""
    return int(time.time() * 1000)


class Store:
    """Tables under ``root``; ``None`` makes a folder for the session. Opening an empty folder creates the tables."""

    def __init__(self, spark: SparkSession, root: str | None = None, check: bool = True):
        self.spark, self.root = spark, (root or scratch(spark, "store")).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open_tx: dict | None = None
        self.closed = False
        if not self._names():
            self._publish({"version": 0, "seq": 0, "schema_version": VERSION, "tables": {}, "user": {}})
        if check:
            self.check_version()

    # ---- manifests ----

    def _names(self) -> list[str]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.endswith(".json"))

    def manifest(self) -> dict:
        """The manifest in force: that of the open transaction, else the newest."""
        if self.closed:
            raise InvalidArgument("the store is closed")
        if self._open_tx is not None:
            return self._open_tx
        stream = self._fs.open(self._path(f"{self.root}/manifests/{self._names()[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as e:
            raise Corruption(f"manifest: {e}") from e
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        name, own = f"{self.root}/manifests/{manifest['version']:09d}", uuid.uuid4().hex[:8]
        out = self._fs.create(self._path(f"{name}.{own}.tmp"), True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(self._path(f"{name}.{own}.tmp"), self._path(f"{name}.json")):
            raise Corruption(f"another writer made version {manifest['version']}")

    def check_version(self) -> None:
        """``SchemaMigration`` unless the store is of this library's schema version."""
        have = self.manifest().get("schema_version")
        if have != VERSION:
            raise SchemaMigration(f"the store has schema version {have}, not {VERSION}; migrate() it")

    def migrate(self) -> None:
        """Bring an older store to this version; columns that it lacks are read as null. Repeating it changes nothing."""
        m = self.manifest()
        if m.get("schema_version") != VERSION:
            self._publish(m | {"schema_version": VERSION, "version": m["version"] + 1})

    @contextmanager
    def transaction(self) -> Iterator["Store"]:
        """All writes inside become visible together at the end, none if it raises; inside, reads see them."""
        if self._open_tx is not None:
            yield self
            return
        self._open_tx = json.loads(json.dumps(self.manifest()))
        before = json.dumps(self._open_tx)
        try:
            yield self
        except BaseException:
            self._open_tx = None
            raise
        done, self._open_tx = self._open_tx, None
        if json.dumps(done) != before:
            self._publish(done | {"version": done["version"] + 1})

    # ---- reading ----

    def schema(self, table: str) -> T.StructType:
        """A table's columns."""
        if table in SCHEMAS:
            return SCHEMAS[table]
        user = self.manifest()["user"]
        if table not in user:
            raise InvalidArgument(f"no table {table!r}")
        return T.StructType.fromJson(json.loads(user[table]))

    def tables(self) -> list[str]:
        """All tables, the library's and the user's."""
        return [*SCHEMAS, *sorted(self.manifest()["user"])]

    def read(self, table: str) -> DataFrame:
        """What a table holds now."""
        schema, files = self.schema(table), self.manifest()["tables"].get(table, [])
        if not files:
            return self.spark.createDataFrame([], schema)
        log = self.log(table, files)
        keys = KEYS.get(table)
        if not keys or table in APPEND_ONLY:
            return log.select(*schema.names)
        rest = [c for c in schema.names if c not in keys]
        best = F.max_by(F.struct(F.col("_op"), *rest), "_seq").alias("_r")
        rows = log.groupBy(*keys).agg(best).filter("_r._op = 'put'")
        return rows.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in schema.names])

    def log(self, table: str, files: Sequence[str]) -> DataFrame:
        """Rows of some files of a table's change log, with ``_seq`` and ``_op``."""
        full = T.StructType([*self.schema(table).fields, T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType())])
        return self.spark.read.schema(full).parquet(*files)

    def note(self, path: str, value: dict | None = None) -> dict | None:
        """Read a small JSON file below the store, null if there is none, or write one in its place."""
        at = self._path(path)
        if value is not None:
            out = self._fs.create(at, True)
            try:
                out.write(bytearray(json.dumps(value).encode()))
            finally:
                out.close()
            return value
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def views(self) -> None:
        """Make a temporary view of every table, for SQL."""
        for t in self.tables():
            self.read(t).createOrReplaceTempView(t)

    # ---- writing ----

    def _log(self, table: str, rows: DataFrame, op: str) -> None:
        schema = self.schema(table)
        with self.transaction():
            m = self._open_tx
            m["seq"] += 1
            out = f"{self.root}/data/{table}/{m['seq']:012d}-{uuid.uuid4().hex[:8]}"
            cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            rows.select(*cols, F.lit(m["seq"]).cast("long").alias("_seq"), F.lit(op).alias("_op")).write.parquet(out)
            m["tables"].setdefault(table, []).append(out)

    def frame(self, table: str, rows: Iterable[dict]) -> DataFrame:
        """Rows given as dictionaries, in the table's schema."""
        schema = self.schema(table)
        return self.spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)

    def put(self, table: str, rows: DataFrame | Iterable[dict]) -> None:
        """Insert rows or put them in place of those with the same keys; a batch has each key once."""
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            for r in rows:
                for c in REQUIRED.get(table, ()):
                    if r.get(c) is None:
                        raise InvalidArgument(f"{table}.{c} must not be null")
            if not rows:
                return
            rows = self.frame(table, rows)
        self._log(table, rows, "put")

    def delete(self, table: str, keys: DataFrame) -> None:
        """Delete rows by their key columns, and what depends on them; unknown keys are no error."""
        if table in APPEND_ONLY:
            raise InvalidArgument(f"{table} is append-only")
        with self.transaction():
            keys = keys.select(*KEYS[table]).distinct()
            for child, links in CASCADES.items():
                for column, parent, parent_column in links:
                    if parent == table:
                        gone = keys.select(F.col(parent_column).alias("_gone"))
                        rows = self.read(child)
                        below = rows.join(gone, rows[column] == gone["_gone"], "left_semi")
                        if not below.isEmpty():
                            self.delete(child, below)
            self._log(table, keys, "delete")

    def rewrite(self, table: str, rows: DataFrame) -> None:
        """Put rows in place of all that a table holds; ``rows`` may be read from it."""
        with self.transaction():
            old = list(self._open_tx["tables"].get(table, []))
            self._log(table, rows, "put")
            self._open_tx["tables"][table] = [f for f in self._open_tx["tables"][table] if f not in old]

    def replace(self, table: str, rows: DataFrame) -> None:
        """:meth:`rewrite` for tables that aren't append-only."""
        if table in APPEND_ONLY:
            raise InvalidArgument(f"{table} is append-only")
        self.rewrite(table, rows)

    def create_table(self, name: str, schema: T.StructType) -> None:
        """A new table of the user's own."""
        with self.transaction():
            if name in SCHEMAS or name in self._open_tx["user"]:
                raise InvalidArgument(f"table {name!r} exists")
            self._open_tx["user"][name] = schema.json()

    def drop_table(self, name: str) -> None:
        """Forget a table of the user's own."""
        with self.transaction():
            if name not in self._open_tx["user"]:
                raise InvalidArgument(f"no table {name!r}")
            del self._open_tx["user"][name]
            self._open_tx["tables"].pop(name, None)

    def compact(self, tables: Sequence[str] | None = None) -> None:
        """Rewrite change logs as what they hold."""
        with self.transaction():
            for t in tables or list(self.manifest()["tables"]):
                if t not in APPEND_ONLY and len(self.manifest()["tables"].get(t, [])) > 1:
                    self.replace(t, self.read(t))

    def close(self) -> None:
        """Compact and take no more calls."""
        if not self.closed:
            self.compact()
            self.closed = True

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ---- export ----

    def export(self, path: str, format: str = "parquet", tables: Sequence[str] | None = None) -> None:
        """Write tables to a folder as parquet, json, csv or orc, one folder each; arrays become JSON text in csv."""
        for t in tables or self.tables():
            df = self.read(t)
            if format == "csv":
                df = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns])
            df.write.mode("overwrite").format(format).save(f"{path}/{t}")

    def snapshot(self, path: str) -> None:
        """Copy what is visible now into a new store's folder."""
        other = Store(self.spark, path)
        with other.transaction():
            for t in self.tables():
                if t not in SCHEMAS:
                    other.create_table(t, self.schema(t))
                if self.manifest()["tables"].get(t):
                    other.put(t, self.read(t))


def create_statement(store: Store, table: str) -> str:
    """CREATE TABLE with the columns and the key, in SQLite's type names."""
    kinds = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER", "binary": "BLOB"}
    keys = KEYS.get(table) or tuple(f.name for f in store.schema(table) if f.metadata.get("key"))
    need = REQUIRED.get(table, ())
    parts = [f'"{f.name}" {kinds.get(f.dataType.simpleString(), "TEXT")}' + (" NOT NULL" if f.name in need else "") for f in store.schema(table)]
    if keys:
        parts.append("PRIMARY KEY (" + ", ".join(f'"{k}"' for k in keys) + ")")
    return f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(parts)});'


def sql_dump(df: DataFrame, table: str) -> DataFrame:
    """(statement): an INSERT for each row; quotes are doubled, bytes are X'..', nulls NULL."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            v = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
        elif isinstance(f.dataType, (T.NumericType,)):
            v = c.cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            v = c.cast("int").cast("string")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            v = quote(F.to_json(c))
        else:
            v = quote(c.cast("string"))
        parts.append(F.coalesce(v, F.lit("NULL")))
    names = ", ".join(f'"{n}"' for n in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *parts), F.lit(");")).alias("statement"))
