"""SQL on a store: queries, parameters, changes, batches, JSON rows and counters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, SqlError
from ..schemas import APPEND_ONLY, KEYS
from ..session import cut
from ..sources.store import Store

# SQLite's type names and spellings, and what they are here.
TYPES = {"TEXT": "string", "VARCHAR": "string", "INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "NUMERIC": "double", "BLOB": "binary", "BOOLEAN": "boolean"}
SHIMS = ((r"strftime\s*\(\s*'%s'\s*,\s*'now'\s*\)", "unix_timestamp()"), (r"strftime\s*\(\s*'%s'\s*,", "unix_timestamp("), (r"\bjson_extract\s*\(", "get_json_object("), (r"\bgroup_concat\s*\(", "listagg("), (r"datetime\s*\(\s*'now'\s*\)", "current_timestamp()"), (r"\bIFNULL\s*\(", "coalesce("))


#: Quoted texts and names, comments, parameters, words, white space, anything else.
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\?\d*|\w+|\s+|.", re.DOTALL)


def shim(sql: str) -> str:
    """Rewrite a few of SQLite's functions."""
    for pattern, to in SHIMS:
        sql = re.sub(pattern, to, sql, flags=re.IGNORECASE)
    return sql


def bind(sql: str, params: Sequence | dict | None) -> tuple[str, dict]:
    """The statement with named places only, and what goes there: ``?3`` is the third value, ``?`` the one after the greatest number so far."""
    if params is None or isinstance(params, dict):
        return sql, params or {}
    top, out = 0, []
    for t in _TOKEN.findall(sql):
        if t[0] == "?":
            n = int(t[1:]) if len(t) > 1 else top + 1
            if not 1 <= n <= len(params):
                raise SqlError(f"no value for parameter {t}")
            top, t = max(top, n), f":_p{n}"
        out.append(t)
    return "".join(out), {f"_p{i + 1}": v for i, v in enumerate(params)}


def split_top(text: str, *words: str) -> list[str]:
    """``text`` parted where the words (or signs) stand one after another, outside of quotes and brackets."""
    tokens, parts, now, depth, i = _TOKEN.findall(text), [], "", 0, 0
    while i < len(tokens):
        t = tokens[i]
        if depth == 0:
            j, k = i, 0
            while j < len(tokens) and k < len(words) and (tokens[j].upper() == words[k] or (k and tokens[j].isspace())):
                k += tokens[j].upper() == words[k]
                j += 1
            if k == len(words):
                parts.append(now)
                now, i = "", j
                continue
        depth += (t == "(") - (t == ")")
        now += t
        i += 1
    return [*parts, now]


_NAME = r"[\"`]?(\w+)[\"`]?"


def _pragma(store: Store, name: str, table: str | None) -> DataFrame:
    """``table_info(t)``, ``table_list``, ``user_version``, ``integrity_check``; settings that have no meaning here give no rows."""
    spark = store.spark
    if name == "table_info" and table:
        keys = table_keys(store, table)
        rows = [(i, f.name, f.dataType.simpleString(), keys.index(f.name) + 1 if f.name in keys else 0) for i, f in enumerate(store.schema(table))]
        return spark.createDataFrame(rows, "cid int, name string, type string, pk int")
    if name == "table_list":
        return spark.createDataFrame([(t,) for t in store.tables()], "name string")
    if name == "user_version":
        return spark.createDataFrame([(int(store.manifest()["schema_version"]),)], "user_version int")
    return spark.createDataFrame([("ok",)] if name == "integrity_check" else [], f"{name} string")


def query(store: Store, sql: str, params: Sequence | dict | None = None) -> DataFrame:
    """A SELECT or WITH over the store's tables; parameters are bound by position (?), number (?1) or name (:x)."""
    if m := re.match(rf"\s*PRAGMA\s+(\w+)\s*(?:\(\s*{_NAME}\s*\)|=\s*\w+)?\s*;?\s*$", sql, re.IGNORECASE):
        return _pragma(store, m[1].lower(), m[2])
    store.views()
    text, args = bind(shim(sql), params)
    try:
        return store.spark.sql(text, args=args) if args else store.spark.sql(text)
    except PySparkException as e:
        raise SqlError(str(e)) from e


def json_rows(df: DataFrame) -> DataFrame:
    """(row): each row as a JSON object; nulls stay, bytes become ``<blob N bytes>``, NaN and infinities null.

    Of columns with one name the last counts.
    """
    last = {n: i for i, n in enumerate(df.columns)}
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cols = []
    for n, i in last.items():
        kind, c = flat.schema[f"c{i}"].dataType, F.col(f"c{i}")
        if isinstance(kind, T.BinaryType):
            c = F.when(c.isNotNull(), F.format_string("<blob %d bytes>", F.octet_length(c)))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        cols.append(c.alias(n))
    return flat.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("row"))


def split_statements(script: str) -> list[str]:
    """Statements of a script, parted by semicolons outside of quotes; comments are dropped."""
    out, now = [], ""
    for part in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|;|[^'\";-]+|.", script, re.DOTALL):
        if part == ";":
            out.append(now)
            now = ""
        elif not part.startswith("--"):
            now += part
    return [s.strip() for s in [*out, now] if s.strip()]


def _create(store: Store, sql: str) -> int:
    m = re.match(rf"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\((.*)\)\s*$", sql, re.IGNORECASE | re.DOTALL)
    if not m:
        raise SqlError(f"can't run: {sql}")
    if m[2] in store.tables():
        if m[1]:
            return 0
        raise SqlError(f"table {m[2]} exists")
    fields, keys = [], set()
    for part in split_top(m[3], ","):
        words = part.split()
        if words and words[0].upper() == "PRIMARY":
            keys |= {c.strip().strip('"`') for c in part[part.index("(") + 1 : part.rindex(")")].split(",")}
        if not words or words[0].upper() in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT"):
            continue
        kind = re.sub(r"\(.*", "", words[1].upper()) if len(words) > 1 else "TEXT"
        fields.append(T.StructField(words[0].strip('"`'), T.DataType.fromDDL(TYPES.get(kind, "string"))))
        if re.search(r"\bPRIMARY\s+KEY\b", part, re.IGNORECASE):
            keys.add(fields[-1].name)
    for f in fields:
        if f.name in keys:
            f.metadata = {"key": True}
    store.create_table(m[2], T.StructType(fields))
    return 0


def table_keys(store: Store, table: str) -> list[str]:
    """The key columns of a table, of the library's or as it was created."""
    return list(KEYS.get(table) or [f.name for f in store.schema(table) if f.metadata.get("key")])


def _put(store: Store, table: str, rows: DataFrame, keys: list[str]) -> None:
    if keys and table not in KEYS:
        store.replace(table, store.read(table).join(rows.select(*keys), keys, "left_anti").unionByName(rows))
    else:
        store.put(table, rows)


def _typed(store: Store, table: str, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema(table)])


def _assignments(text: str, columns: list[str], keys: list[str]) -> dict[str, str]:
    sets = {k.strip().strip('"`'): v.strip() for k, v in (split_top(p, "=")[:1] + ["=".join(split_top(p, "=")[1:])] for p in split_top(text, ","))}
    if unknown := set(sets) - set(columns):
        raise SqlError(f"no column {unknown}")
    if set(keys) & set(sets):
        raise InvalidArgument("a key can't be updated")
    return sets


def _insert(store: Store, sql: str, params) -> int:
    """INSERT, with OR REPLACE, OR IGNORE, or ON CONFLICT (key) DO NOTHING or DO UPDATE SET, in which ``excluded`` is the new row.

    With ON CONFLICT no key may stand twice in one statement.
    """
    sql, params = bind(sql, params)
    sql, *conflict = split_top(sql, "ON", "CONFLICT")
    m = re.match(rf"INSERT\s+(OR\s+(?:REPLACE|IGNORE)\s+)?INTO\s+{_NAME}\s*(?:\(([^)]*)\)\s*)?(VALUES.*|SELECT.*|WITH.*)$", sql.strip(), re.IGNORECASE | re.DOTALL)
    if not m:
        raise SqlError(f"can't run: {sql}")
    table, schema = m[2], store.schema(m[2])
    names = [c.strip().strip('"`') for c in m[3].split(",")] if m[3] else schema.names
    rows = query(store, f"SELECT * FROM ({m[4]})" if m[4][:6].upper() == "VALUES" else m[4], params)
    if len(rows.columns) != len(names):
        raise SqlError(f"{len(names)} columns, {len(rows.columns)} values")
    if unknown := set(names) - set(schema.names):
        raise SqlError(f"no column {unknown}")
    rows = _typed(store, table, rows.toDF(*names))
    keys, how = table_keys(store, table), (m[1] or "").upper()
    if conflict:
        c = re.match(r"\s*(?:\(([^)]*)\))?\s*DO\s+(NOTHING|UPDATE\s+SET\s+(.*))$", conflict[0], re.IGNORECASE | re.DOTALL)
        if not c:
            raise SqlError(f"can't run: ON CONFLICT{conflict[0]}")
        keys = keys or [x.strip().strip('"`') for x in (c[1] or "").split(",") if x.strip()]
        if not keys or (c[1] and {x.strip().strip('"`') for x in c[1].split(",")} != set(keys)):
            raise SqlError("ON CONFLICT names no key of the table")
        if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise SqlError(f"a key of {table} twice in one statement")
        rows = cut(rows)
        now = store.read(table)
        out = rows.join(now.select(*keys), keys, "left_anti")
        if c[3]:
            sets, *where = split_top(c[3], "WHERE")
            sets = _assignments(sets, schema.names, keys)
            # the old row's columns by their names, the new row as a struct
            now.join(rows.select(*keys, F.struct(*schema.names).alias("excluded")), keys).createOrReplaceTempView("_met")
            text = f"SELECT {', '.join(f'{sets.get(n, n)} AS {n}' for n in schema.names)} FROM _met AS {table} WHERE {where[0] if where else 'true'}"
            try:
                out = out.unionByName(_typed(store, table, store.spark.sql(text, args=params) if params else store.spark.sql(text)))
            except PySparkException as e:
                raise SqlError(str(e)) from e
        out = cut(out)
        _put(store, table, out, keys)
        return out.count()
    if keys and "REPLACE" in how:
        # of a key that stands twice the last row counts, as far as rows have an order
        rows = rows.withColumn("_o", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*[n for n in schema.names if n not in keys] or [F.lit(1).alias("_")]), "_o").alias("_r"))
        rows = rows.select(*[F.col(n) if n in keys else F.col(f"_r.{n}").alias(n) for n in schema.names])
    elif keys:
        known = store.read(table).select(*keys)
        if "IGNORE" in how:
            rows = rows.dropDuplicates(keys).join(known, keys, "left_anti")
        elif not rows.join(known, keys, "left_semi").isEmpty() or rows.groupBy(*keys).count().filter("count > 1").count():
            raise SqlError(f"duplicate key in {table}")
    n = rows.count()
    _put(store, table, rows, keys)
    return n


def _change(store: Store, sql: str, params) -> int:
    """UPDATE or DELETE; of a table with a key only the rows that are hit are written."""
    sql, params = bind(sql, params)
    head, *where = split_top(sql, "WHERE")
    m = re.match(rf"(?:DELETE\s+FROM\s+{_NAME}|UPDATE\s+{_NAME}\s+SET\s+(.*?))\s*$", head.strip(), re.IGNORECASE | re.DOTALL)
    if not m or len(where) > 1:
        raise SqlError(f"can't run: {sql}")
    table = m[1] or m[2]
    names, keys = store.schema(table).names, table_keys(store, table)
    hit = f"coalesce(({where[0] if where else 'true'}), false)"
    if m[1]:
        gone = query(store, f"SELECT * FROM {table} WHERE {hit}", params)
        n = gone.count()
        if table in KEYS:
            store.delete(table, gone)
        else:
            store.replace(table, query(store, f"SELECT * FROM {table} WHERE NOT {hit}", params))
        return n
    sets = _assignments(m[3], names, keys)
    if table in KEYS and table not in APPEND_ONLY:
        new = cut(_typed(store, table, query(store, f"SELECT {', '.join(f'{sets[c]} AS {c}' if c in sets else c for c in names)} FROM {table} WHERE {hit}", params)))
        n = new.count()
        if n:
            store.put(table, new)
        return n
    n = query(store, f"SELECT * FROM {table} WHERE {hit}", params).count()
    new = query(store, f"SELECT {', '.join(f'CASE WHEN {hit} THEN {sets[c]} ELSE {c} END AS {c}' if c in sets else c for c in names)} FROM {table}", params)
    store.replace(table, _typed(store, table, new))
    return n


def execute(store: Store, sql: str, params: Sequence | dict | None = None) -> int:
    """One statement: CREATE or DROP TABLE, INSERT, UPDATE or DELETE; returns the number of rows concerned."""
    text = shim(sql.strip().rstrip(";"))
    verb = text.split(None, 1)[0].upper() if text else ""
    if verb == "CREATE":
        return 0 if re.match(r"CREATE\s+(UNIQUE\s+)?INDEX", text, re.IGNORECASE) else _create(store, text)
    if verb == "DROP":
        m = re.match(rf"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{_NAME}$", text, re.IGNORECASE)
        if not m:
            raise SqlError(f"can't run: {sql}")
        if m[2] in store.tables() or not m[1]:
            store.drop_table(m[2])
        return 0
    if verb == "INSERT":
        return _insert(store, text, params)
    if verb in ("UPDATE", "DELETE"):
        return _change(store, text, params)
    if verb in ("SELECT", "WITH"):
        return query(store, text, params).count()
    raise SqlError(f"can't run: {sql}")


def execute_batch(store: Store, script: str) -> int:
    """Statements parted by semicolons, all or none."""
    with store.transaction():
        return sum(execute(store, s) for s in split_statements(script))


def run(store: Store, sql: str) -> DataFrame | int:
    """A query's rows or a statement's count, by the first word."""
    return query(store, sql) if sql.strip().split(None, 1)[0].upper() in ("SELECT", "WITH", "EXPLAIN", "DESCRIBE", "SHOW", "PRAGMA", "VALUES") else execute(store, sql)


COUNTED = ("collections", "vectors", "nodes", "edges", "conversations", "messages", "workflows", "traces", "tools", "tool_calls", "audit_log", "context_entries", "prompt_templates")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, counted in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).alias(t) for t in tables])


def stats(store: Store) -> DataFrame:
    """The thirteen counters of a store."""
    return table_counts({t: store.read(t) for t in COUNTED})
