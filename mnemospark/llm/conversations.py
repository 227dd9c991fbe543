"""Rebuilding conversations from message rows (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, norm_key
from ..operators.ranking import spread_row_number
from ..session import cut
from .components import connected_components

# Spellings of roles, the roles allowed, and where metadata names the message that one answers or quotes.
ROLE_NAMES = {"human": "user", "ai": "assistant"}
ROLES = ("user", "assistant", "system", "tool")
LINKS = ("$.reply_to", "$.in_reply_to", "$.parent_id", "$.quote_of", "$.quoted_id")

#: Times below this are seconds.
SECONDS_BELOW = 100_000_000_000
_LAST = 2**63 - 1


def message_rows(messages: DataFrame, content: bool = False) -> DataFrame:
    """One row for each message id, with the earliest time: (id, conversation_id, role, blank, at[, content]).

    Times under 1e11 are seconds; rows without a time come last. Roles are trimmed, in lower case, synonyms resolved. An
    empty conversation_id is null. Rows without an id count once each if they differ in anything. Copies of an id that
    tie on time are told apart by their other columns.
    """
    t = F.col("created_at").cast("long")
    at = F.coalesce(F.when((t < SECONDS_BELOW) & (t > -SECONDS_BELOW), t * 1000).otherwise(t), F.lit(_LAST))
    role = norm_key(F.col("role"))
    for spelling, means in ROLE_NAMES.items():
        role = F.when(role == spelling, means).otherwise(role)
    ghost = F.concat(F.lit("\0"), F.sha2(F.to_json(F.struct("conversation_id", "role", "content", "created_at")), 256))
    rows = messages.select(
        F.coalesce("id", ghost).alias("id"), at.alias("at"), F.nullif(F.col("conversation_id"), F.lit("")).alias("conversation_id"),
        role.alias("role"), is_blank(F.col("content")).alias("blank"), *([F.col("content")] if content else []),
    )
    names = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*names)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in names])


def message_links(messages: DataFrame, paths: Sequence[str] = LINKS) -> DataFrame:
    """Reply and quote links of the metadata: (id, target), for rows with an id."""
    targets = F.array_distinct(F.array_compact(F.array(*[F.get_json_object("metadata", p) for p in paths])))
    return messages.filter(F.col("id").isNotNull() & F.col("metadata").isNotNull()).select("id", F.explode(targets).alias("target"))


def assign_conversations(rows: DataFrame, links: DataFrame, adopt: bool = True) -> DataFrame:
    """``rows`` with a conversation for those that have none, and ``given``: whether it was named by the row itself.

    Rows without a conversation that are connected over reply and quote links are one conversation, ``link:`` and its
    least message id. With ``adopt``, those linked to a row of a named conversation belong to that one (the least, if
    there are several). Links to unknown messages connect those who share them. Rows with neither name nor link stay
    without a conversation.
    """
    loose = rows.filter(F.col("conversation_id").isNull()).select("id")
    # a link counts if one of its ends is loose; named rows don't connect their conversations with each other
    ends = links.join(loose.withColumn("l1", F.lit(True)), "id", "left").join(loose.select(F.col("id").alias("target"), F.lit(True).alias("l2")), "target", "left")
    ends = cut(ends.filter("l1 OR l2").select("id", "target"))
    rows = rows.withColumn("given", F.col("conversation_id").isNotNull())
    if ends.isEmpty():
        return rows
    named = rows.filter("given").select("id", F.col("conversation_id").alias("named"))
    inner = ends.join(named.select("id"), "id", "left_anti").join(named.select(F.col("id").alias("target")), "target", "left_anti")
    single = ends.select("id").unionByName(ends.select(F.col("target").alias("id"))).distinct().join(loose, "id", "left_semi")
    comp = connected_components(inner, "id", "target").select(F.col("node").alias("id"), "component")
    comp = single.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    name = comp.select("component").distinct().withColumn("named", F.lit(None).cast("string"))
    if adopt:
        touch = ends.unionByName(ends.select(F.col("target").alias("id"), F.col("id").alias("target")))
        near = touch.join(named.withColumnRenamed("id", "target"), "target").join(comp, "id")
        name = name.drop("named").join(near.groupBy("component").agg(F.min("named").alias("named")), "component", "left")
    comp = comp.join(name, "component").select("id", F.coalesce("named", F.concat(F.lit("link:"), "component")).alias("found"))
    return rows.join(comp, "id", "left").withColumn("conversation_id", F.coalesce("conversation_id", "found")).drop("found")


def conversation_status(rows: DataFrame) -> DataFrame:
    """(conversation_id, given, turns, reason) for each conversation; reason is null where it is whole.

    Reasons, the first that holds: ``role`` (a role that isn't allowed, null included), ``empty`` (no user or assistant
    row), ``start`` (the first of these isn't user), ``end`` (the last isn't assistant), ``reply`` (a user row directly
    after a user row). Blank rows are no turns but still name their conversation.

    Rows are range-partitioned by (conversation, time, id); each part of a conversation is summed up by its first and
    last role, and the few summaries of a conversation are compared at their seams, so a conversation of any size is
    spread over many tasks.
    """
    turn = ~F.col("blank")
    code = F.when(turn & (F.col("role") == "user"), 1).when(turn & (F.col("role") == "assistant"), 2)
    bad = turn & (F.col("role").isNull() | ~F.col("role").isin(*ROLES))
    narrow = rows.filter(F.col("conversation_id").isNotNull()).select("conversation_id", "given", "at", "id", code.alias("code"), F.coalesce(bad, F.lit(True)).alias("bad"), turn.cast("int").alias("turn"))
    part = narrow.repartitionByRange("conversation_id", "at", "id").withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("conversation_id", "part").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("prev", F.last("code", ignorenulls=True).over(own))
    place = F.when(F.col("code").isNotNull(), F.struct("at", "id", "code"))
    seams = part.groupBy("conversation_id", "part").agg(
        F.max("bad").alias("bad"), F.sum("turn").alias("turns"), F.max("given").alias("given"),
        F.min(place).getField("code").alias("first"), F.max(place).getField("code").alias("last"),
        F.max(F.coalesce((F.col("code") == 1) & (F.col("prev") == 1), F.lit(False))).alias("twice"),
    )
    by_part = Window.partitionBy("conversation_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seams = seams.withColumn("before", F.last("last", ignorenulls=True).over(by_part))
    seam = F.when(F.col("first").isNotNull(), F.struct("part", "first", "last"))
    whole = seams.groupBy("conversation_id").agg(
        F.max("given").alias("given"), F.sum("turns").alias("turns"), F.max("bad").alias("bad"),
        F.min(seam).getField("first").alias("first"), F.max(seam).getField("last").alias("last"),
        F.max(F.col("twice") | F.coalesce((F.col("first") == 1) & (F.col("before") == 1), F.lit(False))).alias("twice"),
    )
    reason = (
        F.when(F.col("bad"), "role").when(F.col("first").isNull(), "empty").when(F.col("first") != 1, "start")
        .when(F.col("last") != 2, "end").when(F.col("twice"), "reply")
    )
    return whole.select("conversation_id", "given", "turns", reason.alias("reason"))


def judge_conversations(messages: DataFrame, adopt: bool = True) -> DataFrame:
    """:func:`conversation_status` of the messages, those without a conversation joined over their links first."""
    return conversation_status(assign_conversations(message_rows(messages), message_links(messages), adopt))


def rebuild_conversations(messages: DataFrame, adopt: bool = True) -> DataFrame:
    """The turns of whole conversations: (conversation_id, turn, role, content, id, created_at), turn from 1 in order."""
    rows = cut(assign_conversations(message_rows(messages, content=True), message_links(messages), adopt))
    good = conversation_status(rows).filter("reason IS NULL").select("conversation_id")
    turns = rows.filter(~F.col("blank")).join(good, "conversation_id", "left_semi")
    turns = spread_row_number(turns, ["conversation_id"], [F.col("at"), F.col("id")], "turn")
    at = F.when(F.col("at") < _LAST, F.col("at"))
    return turns.select("conversation_id", "turn", "role", "content", "id", at.alias("created_at"))
