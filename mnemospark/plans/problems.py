"""Queries on the general problems' tables (4, 6 and 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import BucketedTable, reduce_changes
from ..operators.nested import EMITTED, read_table, store_json_rows, write_tables
from ..operators.orphans import count_orphans, store_orphans
from ..session import load, scratch


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON object that is an element of an array."""
    rows = store_json_rows(load(spark, d, "adb_vectors"), load(spark, d, "nodes"), load(spark, d, "workflows"))
    source = F.split("tag", r"\.").getItem(0)
    return rows.filter("kind = 'object'").select(source.alias("source_table"), "record_id", "path").distinct()


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table and values in its fields, after it was written and read again under its schema.

    A table's schema has every field of its rows as text, so that no value fails to fit.
    """
    rows = store_json_rows(load(spark, d, "adb_vectors"), load(spark, d, "nodes"), load(spark, d, "workflows"))
    path = scratch(spark, "flat")
    write_tables(rows, path)
    written = spark.read.schema(EMITTED).parquet(path)
    fields: dict[str, list[T.StructType]] = {}
    keys = written.groupBy("tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys("payload"))))).alias("keys"))
    for tag, names in keys.collect():  # one row for each table
        # names that differ in case only are read one after another
        layers: list[dict[str, str]] = [{}]
        for name in names:
            layer = next((x for x in layers if name.lower() not in x), None)
            if layer is None:
                layers.append(layer := {})
            layer[name.lower()] = name
        fields[tag] = [T.StructType([T.StructField(n, T.StringType()) for n in x.values()]) for x in layers]
    out = spark.createDataFrame([], "tag string, kind string, n long, filled long")
    for tag, layers in sorted(fields.items()):
        for k, schema in enumerate(layers):
            table = read_table(spark, path, tag, schema)
            filled = sum((F.col(f"`data_{f.name}`").isNotNull().cast("long") for f in schema), F.lit(0).cast("long"))
            one = table.groupBy("kind").agg((F.count("*") if not k else F.lit(0).cast("long")).alias("n"), F.sum(filled).alias("filled"))
            out = out.unionByName(one.select(F.lit(tag).alias("tag"), "kind", "n", "filled"))
    return out.groupBy("tag", "kind").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References to records that are missing, deleted or late."""
    return store_orphans(*(load(spark, d, t) for t in ("edges", "adb_vectors", "workflow_steps", "nodes", "adb_collections", "workflows", "audit_log")))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counted per table, field, month and reason."""
    return count_orphans(p6_found(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that exist after all changes, with the entry that gave the value."""
    feed = load(spark, d, "audit_log")
    late = F.pmod(F.xxhash64("id"), F.lit(4)) == 0  # any part of the feed may come later
    rev = F.get_json_object("new_value", "$.rev").try_cast("double")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as the cluster shuffles into
    table = BucketedTable(spark, scratch(spark, "current"), ["table_name", "record_id"], buckets)
    for part in (~late, late):
        table.apply(reduce_changes(feed.filter(part), ["table_name", "record_id"], "id", "action", "new_value", [F.col("timestamp"), rev]))
    return table.read().select("table_name", "record_id", F.col("entry").alias("id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_rows, p6_found, p6_counts, p7_found)}
