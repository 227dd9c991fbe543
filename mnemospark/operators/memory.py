"""Reads and folds over the agent's stores: conversations, workflows, traces, tools, audit, context, prompts, labels.

Every function takes DataFrames in the shapes of :mod:`mnemospark.schemas` and returns one. Where the order of a store
leaves ties, the id decides.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..session import cut
from .ranking import spread_row_number

STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def _top(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


# ---- conversations ----


def last_messages(messages: DataFrame, n: int | None = None, conversation_id: str | None = None) -> DataFrame:
    """The last n messages of each conversation, or of one, with ``position`` from the first of those kept.

    Per conversation the n newest are picked by a group limit, which cuts before the shuffle, and then numbered. Without n
    all are kept and numbered over range partitions, so that no conversation is sorted in one task.
    """
    rows = messages if conversation_id is None else messages.filter(F.col("conversation_id") == conversation_id)
    if n is None:
        return spread_row_number(rows, ["conversation_id"], [F.col("created_at"), F.col("id")], "position")
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = rows.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n).drop("_back")
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    return rows.withColumn("position", F.row_number().over(w))


def list_conversations(messages: DataFrame) -> DataFrame:
    """(conversation_id, messages, created_at, updated_at), the newest first."""
    rows = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return rows.orderBy(F.desc("updated_at"), "conversation_id")


def speaker(role):
    """Human for user and unknown roles, AI for assistant and system."""
    return F.when(F.lower(role).isin("ai", "assistant", "system"), "AI").otherwise("Human")


#: Messages of a conversation that go into one row of a transcript.
PART = 1000


def transcript(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conversation_id, part, transcript): a line ``Human: ...`` or ``AI: ...`` for each message in order.

    A conversation of more than ``part`` messages comes in several rows, numbered from 0; messages are numbered over range
    partitions, so a row never holds more than ``part`` of them and no conversation is in one task as a whole.
    """
    line = F.concat(speaker(F.col("role")), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = spread_row_number(messages.select("conversation_id", "created_at", "id", line.alias("line")), ["conversation_id"], [F.col("created_at"), F.col("id")], "n")
    rows = rows.groupBy("conversation_id", F.floor((F.col("n") - 1) / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))  # at most ``part``
    return rows.select("conversation_id", "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def message_at(messages: DataFrame, index: int) -> DataFrame:
    """The message at a place, from 0, of each conversation; later ones are cut before the shuffle."""
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    return messages.withColumn("position", F.row_number().over(w)).filter(F.col("position") == index + 1)


# ---- workflows ----


def list_workflows(workflows: DataFrame, steps: DataFrame, status: str | None = None) -> DataFrame:
    """(id, name, status, created_at, step_count), the newest first; workflows without steps count 0."""
    rows = workflows if status is None else workflows.filter(F.col("status") == status)
    n = steps.groupBy("workflow_id").agg(F.count("*").alias("step_count"))
    rows = rows.join(n, rows.id == n.workflow_id, "left").withColumn("step_count", F.coalesce("step_count", F.lit(0)))
    return rows.select("id", "name", "status", "created_at", "step_count").orderBy(F.desc("created_at"), "id")


def get_workflow(workflows: DataFrame, steps: DataFrame, workflow_id: str) -> DataFrame:
    """The workflow with its steps in order, as an array."""
    s = steps.filter(F.col("workflow_id") == workflow_id).groupBy("workflow_id").agg(F.sort_array(F.collect_list(F.struct("step_index", "id", "name", "status", "input", "output", "error", "started_at", "completed_at"))).alias("steps"))
    rows = workflows.filter(F.col("id") == workflow_id)
    rows = rows.join(s, rows.id == s.workflow_id, "left").drop("workflow_id")
    return rows.withColumn("step_count", F.coalesce(F.size("steps"), F.lit(0)))


def number_steps(steps: DataFrame, order: list[str]) -> DataFrame:
    """``step_index`` from 0 in each workflow by the given order, which should be total."""
    return spread_row_number(steps, ["workflow_id"], [F.col(c) for c in order], "_place").withColumn("step_index", F.col("_place") - 1).drop("_place")


def fold_step_updates(events: DataFrame, strict: bool = False) -> DataFrame:
    """Events (step_id, seq, at, status, output?, error?) to the state of each step.

    (step_id, status, output, error, started_at, completed_at): the last status, the last output and error that aren't
    null, the last time of ``running`` and of ``completed`` or ``failed``. ``strict`` refuses unknown statuses.
    """
    if strict and not events.filter(~F.col("status").isin(*STATUSES)).isEmpty():
        raise InvalidArgument("unknown status")
    last = lambda value, where: F.max(F.when(where, F.struct("seq", value))).getField("v")
    return events.groupBy("step_id").agg(
        last(F.col("status").alias("v"), F.lit(True)).alias("status"), last(F.col("output").alias("v"), F.col("output").isNotNull()).alias("output"),
        last(F.col("error").alias("v"), F.col("error").isNotNull()).alias("error"), last(F.col("at").alias("v"), F.col("status") == "running").alias("started_at"),
        last(F.col("at").alias("v"), F.col("status").isin("completed", "failed")).alias("completed_at"),
    )


# ---- traces ----


def session_traces(traces: DataFrame, session_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A session's traces in order of time."""
    return _top(traces.filter(F.col("session_id") == session_id), ["created_at", "id"], limit, offset)


def trace_tree(traces: DataFrame, root: str) -> DataFrame:
    """The root and everything below it with ``depth``, in order of time; an unknown root gives nothing.

    One level a round, cut from its lineage; a trace that is its own ancestor is met once.
    """
    known = traces.select("id", "parent_id", "session_id", "trace_type", "content", "created_at")
    level = cut(known.filter(F.col("id") == root).withColumn("depth", F.lit(0)))
    every, depth = level, 0
    while not level.isEmpty():
        depth += 1
        below = known.join(level.select(F.col("id").alias("_p")), F.col("parent_id") == F.col("_p"), "left_semi")
        level = cut(below.join(every.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)).select(*every.columns))
        every = every.unionByName(level)
    return every.orderBy("created_at", "id")


# ---- tools and audit ----


def recent_tool_calls(calls: DataFrame, session_id: str | None = None, tool_name: str | None = None, limit: int = 100) -> DataFrame:
    """Tool calls, the newest first."""
    rows = calls
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    if tool_name is not None:
        rows = rows.filter(F.col("tool_name") == tool_name)
    return _top(rows, [F.desc("created_at"), "id"], limit)


def audit_by_record(audit: DataFrame, table_name: str, record_id: str, limit: int = 100) -> DataFrame:
    """Audit entries of a record, the newest first."""
    return _top(audit.filter((F.col("table_name") == table_name) & (F.col("record_id") == record_id)), [F.desc("timestamp"), "id"], limit)


def audit_by_actor(audit: DataFrame, actor: str, limit: int = 100) -> DataFrame:
    """Audit entries of an actor, the newest first."""
    return _top(audit.filter(F.col("actor") == actor), [F.desc("timestamp"), "id"], limit)


def audit_recent(audit: DataFrame, limit: int = 100) -> DataFrame:
    """The newest audit entries."""
    return _top(audit, [F.desc("timestamp"), "id"], limit)


# ---- context ----


def build_window(entries: DataFrame, max_tokens: int, session_id: str | None = None) -> DataFrame:
    """(session_id, id, token_count, used): entries taken greedily by priority, then relevance, both descending.

    An entry that doesn't fit is skipped and packing goes on. Zero and negative counts always fit, null counts 0.

    Each session is one ordered pass that keeps a single number, over what can be taken at all: as what is used never
    falls, of one size only the first ``max_tokens / size`` entries can, so about ``max_tokens * ln(max_tokens)`` of any
    session are passed over, picked by a group limit before the shuffle. Sessions with zero or negative counts keep those,
    and with negative ones all entries; their rows are sorted by Spark and stream through a task, none is held.
    """
    rows = entries if session_id is None else entries.filter(F.col("session_id") == session_id)
    count = F.coalesce("token_count", F.lit(0)).cast("long")
    rows = rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("string").alias("id"), count.alias("t"), (-F.col("priority")).alias("p"), (-F.col("relevance_score")).alias("r"))
    falls = rows.filter("t < 0").select(F.col("session_id").alias("_s")).distinct()
    rows = rows.filter(F.col("t") <= max_tokens)
    same = F.col("session_id").eqNullSafe(F.col("_s"))
    steady, other = rows.join(falls, same, "left_anti"), rows.join(falls, same, "left_semi")
    w = Window.partitionBy("session_id", "t").orderBy("p", "r", "id")
    most = max(max_tokens, 1)
    first = steady.filter("t > 0").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).filter(F.col("_n") * F.col("t") <= max_tokens).drop("_n")
    rows = first.unionByName(steady.filter("t <= 0")).unionByName(other)
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "p", "r", "id").select("session_id", "id", "t")
    return ordered.mapInArrow(_fill(max_tokens), "session_id string, id string, token_count long, used long")


def _fill(max_tokens: int):
    def run(batches):
        now, used = object(), 0
        for b in batches:
            taken, sums = [], []
            for i, (session, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if session != now:
                    now, used = session, 0
                if used + t <= max_tokens:
                    used += t
                    taken.append(i)
                    sums.append(used)
            some = b.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sums, pa.int64())], names=["session_id", "id", "token_count", "used"])

    return run


def session_entries(entries: DataFrame, session_id: str) -> DataFrame:
    """A session's entries in packing order."""
    return entries.filter(F.col("session_id") == session_id).orderBy(F.desc("priority"), F.desc("relevance_score"), "id")


# ---- prompts ----


def latest_templates(templates: DataFrame) -> DataFrame:
    """The newest version of each template."""
    rest = [c for c in templates.columns if c != "name"]
    best = F.max_by(F.struct(*rest), "version").alias("_t")
    return templates.groupBy("name").agg(best).select("name", *[F.col(f"_t.{c}").alias(c) for c in rest])


def list_templates(templates: DataFrame) -> DataFrame:
    """Templates by name, the newest version first."""
    return templates.orderBy("name", F.desc("version"))


def render(template, variables: dict[str, str]):
    """A template column with ``{{key}}`` replaced for each variable, in order of the keys; other places stay."""
    for key in sorted(variables):
        template = F.replace(template, F.lit("{{" + key + "}}"), F.lit(variables[key]))
    return template


# ---- labels ----


def labels_of(labels: DataFrame, table_name: str, record_id: str) -> DataFrame:
    """Labels of a record in order of tagging."""
    return labels.filter((F.col("table_name") == table_name) & (F.col("record_id") == record_id)).orderBy("tagged_at", "label")


def find_by_label(labels: DataFrame, label: str, limit: int = 100) -> DataFrame:
    """Records with a label, the newest first."""
    return _top(labels.filter(F.col("label") == label), [F.desc("tagged_at"), "table_name", "record_id"], limit)


def has_label(labels: DataFrame, table_name: str, record_id: str, label: str) -> bool:
    """Whether a record has a label."""
    return not labels_of(labels, table_name, record_id).filter(F.col("label") == label).isEmpty()
