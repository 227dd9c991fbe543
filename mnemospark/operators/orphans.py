"""References to records that do not exist (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import month_of_ms, norm_key
from ..session import cut

#: References that a key of one month must have to count as heavy.
HEAVY_FROM = 1000
#: Heavy keys that are broadcast at most; of more, each is dealt out over so many tasks.
BROADCAST_KEYS, SALTS = 100_000, 64


def references(df: DataFrame, source: str, field: str, record_key, target: str, at) -> DataFrame:
    """References of one field in the shape that :func:`find_orphans` takes; blank and null references are left out.

    ``record_key`` and ``at`` (epoch milliseconds or null) are columns of ``df``; ``target`` names the table referred to.
    """
    out = df.select(
        F.lit(source).alias("source_table"), F.lit(field).alias("field_name"), record_key.cast("string").alias("record_key"),
        norm_key(F.col(f"`{field}`")).alias("ref_key"), at.cast("long").alias("ref_at"), F.lit(target).alias("target"),
    )
    return out.filter(F.col("ref_key") != "")


def find_orphans(refs: DataFrame, targets: DataFrame, deleted: DataFrame, heavy_from: int = HEAVY_FROM, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each orphan reference: (source_table, field_name, record_key, ref_key, period, reason), distinct.

    ``targets``: (target, id, created_at), any number of rows for an id, the earliest creation counts; ``deleted``:
    (target, id). Reasons: ``late`` (the target was created after the reference), ``deleted``, ``missing``. A reference
    without a time is never late; its period is ``unknown``. Rows with a null or blank key are no reference.

    References are aggregated per key and period before anything is shuffled, and each key and period is resolved once.
    What has no timely target is joined with the references again: keys with at least ``heavy_from`` in a period are
    broadcast if there are at most ``broadcast_keys``, which is counted, else dealt out; the rest are joined by a shuffle,
    in which none is hot.
    """
    refs = refs.withColumn("period", month_of_ms(F.col("ref_at")))
    per_key = refs.groupBy("target", "ref_key", "period").agg(F.count("*").alias("n"), F.min("ref_at").alias("first_at"))
    there = targets.groupBy("target", F.col("id").alias("ref_key")).agg(F.lit(True).alias("there"), F.min("created_at").alias("made_at"))
    gone = deleted.select("target", F.col("id").alias("ref_key")).distinct().withColumn("gone", F.lit(True))
    resolved = per_key.join(there, ["target", "ref_key"], "left").join(gone, ["target", "ref_key"], "left")
    suspect = cut(
        resolved.filter(F.col("there").isNull() | (F.col("made_at") > F.col("first_at")))
        .select("target", "ref_key", "period", "n", "there", "made_at", "gone")
    )
    on = ["target", "ref_key", "period"]
    heavy, light = suspect.filter(F.col("n") >= heavy_from), suspect.filter(F.col("n") < heavy_from)
    if heavy.limit(broadcast_keys + 1).count() <= broadcast_keys:
        heavy = F.broadcast(heavy)
        found = refs.join(heavy, on).unionByName(refs.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on))
    else:
        every = suspect.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= heavy_from, SALTS - 1).otherwise(0)))).withColumn("_deal", F.col("n") >= heavy_from)
        dealt = refs.withColumn("_salt", F.pmod(F.xxhash64("record_key", "ref_at"), F.lit(SALTS)).cast("int"))
        found = dealt.join(every.filter("_deal"), [*on, "_salt"]).drop("_deal", "_salt").unionByName(refs.join(light, on))
    reason = F.when(F.col("there") & (F.col("made_at") > F.col("ref_at")), "late").when(F.col("there").isNull() & F.col("gone"), "deleted").when(F.col("there").isNull(), "missing")
    return (
        found.select("source_table", "field_name", "record_key", "ref_key", "period", reason.alias("reason"))
        .filter(F.col("reason").isNotNull()).distinct()
    )


def count_orphans(orphans: DataFrame) -> DataFrame:
    """Orphan references by table, field, period and reason."""
    return orphans.groupBy("source_table", "field_name", "period", "reason").agg(F.count("*").alias("n"))


def store_orphans(edges: DataFrame, vectors: DataFrame, steps: DataFrame, nodes: DataFrame, collections: DataFrame, workflows: DataFrame, audit: DataFrame) -> DataFrame:
    """Orphan references of edges.src, edges.dst, vectors.collection_id and steps.workflow_id."""
    edge_key = F.concat_ws("|", F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit("")), F.coalesce("relation", F.lit("")))
    made = F.col("created_at")
    refs = (
        references(edges, "edges", "src", edge_key, "_adb_nodes", made)
        .unionByName(references(edges, "edges", "dst", edge_key, "_adb_nodes", made))
        .unionByName(references(vectors, "adb_vectors", "collection_id", F.col("id"), "_adb_collections", made))
        .unionByName(references(steps, "workflow_steps", "workflow_id", F.col("id"), "_adb_workflows", F.coalesce("started_at", "completed_at")))
    )
    targets = None
    for df, name in ((nodes, "_adb_nodes"), (collections, "_adb_collections"), (workflows, "_adb_workflows")):
        one = df.select(F.lit(name).alias("target"), "id", "created_at")
        targets = one if targets is None else targets.unionByName(one)
    deletes = audit.filter(F.col("table_name").isin("_adb_nodes", "_adb_collections", "_adb_workflows") & (norm_key(F.col("action")) == "delete"))
    return find_orphans(refs, targets, deletes.select(F.col("table_name").alias("target"), F.col("record_id").alias("id")))
