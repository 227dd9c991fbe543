"""Replication: hybrid logical clocks, merging of operations, state of the peers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .ranking import spread_best_before, spread_sum_before

MASK = 0xFFFF


def pack(ms: int, logical: int) -> int:
    """Milliseconds and counter in one number; the counter wraps at 16 bits."""
    return (ms << 16) | (logical & MASK)


def unpack(hlc: int) -> tuple[int, int]:
    """(milliseconds, counter)."""
    return hlc >> 16, hlc & MASK


def pack_column(ms: Column, logical: Column) -> Column:
    """:func:`pack` on columns."""
    return F.shiftleft(ms.cast("bigint"), 16).bitwiseOR(logical.cast("bigint").bitwiseAND(F.lit(MASK)))


def physical(hlc: Column) -> Column:
    """Milliseconds of a packed clock."""
    return F.shiftright(hlc, 16)


def logical(hlc: Column) -> Column:
    """Counter of a packed clock."""
    return hlc.bitwiseAND(F.lit(MASK))


class Clock:
    """A hybrid logical clock; ``wall`` gives milliseconds."""

    def __init__(self, wall: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.wall, self.ms, self.counter = wall, 0, 0

    def now(self) -> int:
        """The next time of this node."""
        w = self.wall()
        if w > self.ms:
            self.ms, self.counter = w, 0
        else:
            self.counter += 1
        return pack(self.ms, self.counter)

    def update(self, remote: int) -> int:
        """The next time after one received."""
        w, (r_ms, r_counter) = self.wall(), unpack(remote)
        top = max(w, self.ms, r_ms)
        if top == self.ms and top == r_ms:
            self.counter = max(self.counter, r_counter) + 1
        elif top == self.ms:
            self.counter += 1
        elif top == r_ms:
            self.counter = r_counter + 1
        else:
            self.counter = 0
        self.ms = top
        return pack(self.ms, self.counter)


def ops_since(log: DataFrame, hlc: int) -> DataFrame:
    """Operations after a time, in order."""
    return log.filter(F.col("hlc_ts") > hlc).orderBy("hlc_ts", "op_id")


def _best(strategy: str):
    if strategy not in ("lww", "fww"):
        raise InvalidArgument(f"strategy must be lww or fww, not {strategy!r}")
    return strategy == "lww"


def merge_ops(local: DataFrame, remote: DataFrame, strategy: str = "lww") -> DataFrame:
    """The winning operation of each (table_name, record_id): the last written, or with ``fww`` the first.

    Of equal times the local one stays, then the one that came first: ``seq`` if the frames have it, else op_id. A
    partial aggregation, so hot records shuffle one row per task.
    """
    last = _best(strategy)
    seq = lambda df: F.col("seq") if "seq" in df.columns else F.lit(0).cast("long")
    cols = ["op_id", "hlc_ts", "node_id", "table_name", "record_id", "op_type", "payload"]
    both = local.select(*cols, F.lit(0).alias("_remote"), seq(local).alias("_seq")).unionByName(remote.select(*cols, F.lit(1).alias("_remote"), seq(remote).alias("_seq")))
    time_key = -F.col("hlc_ts") if last else F.col("hlc_ts")
    first = F.min(F.struct(time_key.alias("_t"), "_remote", "_seq", "op_id", "hlc_ts", "node_id", "op_type", "payload")).alias("_w")
    rows = both.groupBy("table_name", "record_id").agg(first)
    return rows.select("table_name", "record_id", *[F.col(f"_w.{c}").alias(c) for c in ("op_id", "hlc_ts", "node_id", "op_type", "payload")])


def merge_counts(local: DataFrame, remote: DataFrame, strategy: str = "lww") -> DataFrame:
    """One row (applied, conflicts, skipped) of taking the remote operations in order of ``seq`` (else hlc_ts, op_id).

    The first operation of an unknown record is applied. Every other one is a conflict with the winner so far: it is
    applied if it beats it strictly, else skipped. What an operation meets is the best time before it in its record, which
    is found over range partitions, so a hot record isn't one task.
    """
    last = _best(strategy)
    best = F.max if last else F.min
    known = local.groupBy("table_name", "record_id").agg(best("hlc_ts").alias("_known"))
    order = ["seq"] if "seq" in remote.columns else ["hlc_ts", "op_id"]
    narrow = remote.select("table_name", "record_id", "hlc_ts", *[c for c in order if c != "hlc_ts"])
    rows = spread_best_before(narrow, ["table_name", "record_id"], [F.col(c) for c in order], "hlc_ts", "_before_it", least=not last)
    rows = rows.join(known, ["table_name", "record_id"], "left")
    met = F.greatest("_known", "_before_it") if last else F.least("_known", "_before_it")
    wins = (F.col("hlc_ts") > met) if last else (F.col("hlc_ts") < met)
    rows = rows.select(met.isNotNull().alias("c"), F.coalesce(met.isNull() | wins, F.lit(False)).alias("a"))
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return rows.agg(n(F.col("a")).alias("applied"), n(F.col("c")).alias("conflicts"), n(~F.col("a")).alias("skipped"))


def sync_status(log: DataFrame, peers: DataFrame) -> DataFrame:
    """(peer_id, endpoint, last_synced_hlc, ops_pending) of each peer.

    Operations and the peers' marks are put in one order, and each mark gets the number of operations before it from a
    running sum over range partitions; nothing is paired, and neither side is broadcast.
    """
    marks = peers.select(F.coalesce("last_synced_hlc", F.lit(-(2**63))).alias("hlc_ts")).distinct().withColumn("n", F.lit(0).cast("long"))
    rows = log.filter("hlc_ts IS NOT NULL").select("hlc_ts", F.lit(1).cast("long").alias("n")).unionByName(marks)
    upto = spread_sum_before(rows, [], [F.col("hlc_ts"), F.desc("n")], "n", "upto").filter("n = 0").select("hlc_ts", "upto")
    total = log.agg(F.count("hlc_ts").alias("total"))
    one = peers.groupBy("peer_id").agg(F.first("endpoint").alias("endpoint"), F.first("last_synced_hlc").alias("last_synced_hlc"))
    out = one.join(upto, F.coalesce("last_synced_hlc", F.lit(-(2**63))) == F.col("hlc_ts"), "left").crossJoin(F.broadcast(total))  # one row
    pending = F.when(F.col("last_synced_hlc").isNull(), F.lit(0)).otherwise(F.col("total") - F.coalesce("upto", F.lit(0)))
    return out.select("peer_id", "endpoint", "last_synced_hlc", pending.alias("ops_pending")).orderBy("peer_id")


def merge_into_log(log: DataFrame, remote: DataFrame, strategy: str = "lww") -> DataFrame:
    """The log after taking in remote operations: of the records that they meet, the operation that lost gives way to the one that won.

    All other operations stay, those of records that no remote one meets and earlier ones of those that are met.
    """
    met = remote.select("table_name", "record_id").distinct()
    mine = log.join(met, ["table_name", "record_id"], "left_semi")
    won = merge_ops(mine, remote, strategy).join(mine.select("op_id"), "op_id", "left_anti")
    compared = merge_ops(mine, mine.limit(0), strategy).select("table_name", "record_id", "op_id")
    lost = compared.join(won.select("table_name", "record_id"), ["table_name", "record_id"], "left_semi").select("op_id")
    return log.join(lost, "op_id", "left_anti").select(*won.columns).unionByName(won)
