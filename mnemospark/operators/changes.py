"""Applying a feed of inserts, updates and deletes (problem 7): bucketed copy-on-write.

The base is hashed by key into buckets. Changes are reduced to one row for each key before they are shuffled, routed to
the buckets, and merged with the touched buckets only; their replacement files and a new manifest make the next version.

What is kept for a key is enough to take in changes that arrive later, in any order and any number of times: the place
of the last delete and of the last insert, and the last value set. A record exists if its last insert comes after its
last delete, and then its value is the last one that an insert or update set; an earlier update can't be the last. All
three are maxima, so a hot key is reduced on the map side and a repeated change alters nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_key


def reduce_changes(feed: DataFrame, keys: Sequence[str], entry: str, action: str, value: str, order: Sequence) -> DataFrame:
    """One row for each key: (keys, removed, made, current).

    ``order`` are columns that place a change; ``entry`` (its id) breaks ties, null places are smallest. ``action`` is
    compared trimmed and in lower case; inserts and updates with a null value and all other actions change nothing. Rows
    with a null key form a record of their own key. Copies of an entry may differ in other columns only.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    act, has = norm_key(F.col(f"`{action}`")), F.col(f"`{value}`").isNotNull()
    rows = feed.select(*[F.col(f"`{k}`") for k in keys], act.alias("_act"), has.alias("_has"), place.alias("_place"), F.col(f"`{entry}`").alias("_entry"), F.col(f"`{value}`").alias("_value"))
    sets = F.col("_has") & F.col("_act").isin("insert", "update")
    rows = rows.filter(sets | (F.col("_act") == "delete"))
    return rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max(F.when(F.col("_act") == "delete", F.col("_place"))).alias("removed"),
        F.max(F.when(F.col("_act") == "insert", F.col("_place"))).alias("made"),
        F.max(F.when(F.col("_act") != "delete", F.struct("_place", "_entry", "_value"))).alias("current"),
    )


class BucketedTable:
    """A table of current values, in hash buckets of Parquet files under a versioned manifest.

    Readers see the newest complete manifest; a manifest is written beside the others and renamed into place, so a job
    that dies leaves the version before it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest; version 0 without files if there is none."""
        at = self._fs_path(f"{self.path}/manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "files": {}}
        stream = self._fs.open(self._fs_path(f"{self.path}/manifests/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']:09d}"
        out = self._fs.create(self._fs_path(f"{name}.tmp"), True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(self._fs_path(f"{name}.tmp"), self._fs_path(f"{name}.json")):
            raise RuntimeError(f"version {manifest['version']} exists already")

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def apply(self, delta: DataFrame) -> int:
        """Merge reduced changes (see :func:`reduce_changes`) and return the new version.

        Only the files of touched buckets are read and replaced. An empty delta commits a version with the same files.
        """
        now = self.manifest()
        version = now["version"] + 1
        staged = f"{self.path}/staged/{version:09d}"
        delta.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").parquet(staged)
        delta = self.spark.read.parquet(staged)
        touched = [r[0] for r in delta.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        files = [now["files"][str(b)] for b in touched if str(b) in now["files"]]
        merged = delta
        if files:
            base = self.spark.read.schema(delta.drop("_bucket").schema).parquet(*files).withColumn("_bucket", self._bucket())
            on = F.col("b._bucket") == F.col("d._bucket")
            for k in self.keys:
                on = on & F.col(f"b.`{k}`").eqNullSafe(F.col(f"d.`{k}`"))
            either = base.alias("b").hint("merge").join(delta.alias("d"), on, "full")
            merged = either.select(
                *[F.coalesce(F.col(f"b.`{k}`"), F.col(f"d.`{k}`")).alias(k) for k in self.keys],
                *[F.greatest(F.col(f"b.{c}"), F.col(f"d.{c}")).alias(c) for c in ("removed", "made")],
                F.greatest(F.col("b.current"), F.col("d.current")).alias("current"),
                F.coalesce("b._bucket", "d._bucket").alias("_bucket"),
            )
        out = f"{self.path}/data/{version:09d}"
        merged.repartition("_bucket").sortWithinPartitions("_bucket", *[f"`{k}`" for k in self.keys]).write.mode("overwrite").partitionBy("_bucket").parquet(out)
        self._commit({"version": version, "files": now["files"] | {str(b): f"{out}/_bucket={b}" for b in touched}})
        self._fs.delete(self._fs_path(staged), True)
        return version

    def read(self) -> DataFrame:
        """Records that exist: (keys, entry, value); raises ``ValueError`` before the first version."""
        files = list(self.manifest()["files"].values())
        if not files:
            raise ValueError("the table has no files yet")
        df = self.spark.read.parquet(*files)
        live = F.col("made").isNotNull() & (F.col("removed").isNull() | (F.col("made") > F.col("removed")))
        return df.filter(live).select(*[F.col(f"`{k}`") for k in self.keys], F.col("current._entry").alias("entry"), F.col("current._value").alias("value"))
