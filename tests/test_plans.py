"""Shapes of physical plans: what is pushed down, pruned, broadcast and shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import memory, sync, vector
from mnemospark.operators.changes import reduce_changes
from mnemospark.operators.ranking import latest_rows
from mnemospark.schemas import SCHEMAS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name in ("audit_log", "vectors", "messages", "sync_log", "context_entries"):
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(str(root / name))
    return lambda name: spark.read.parquet(str(root / name))


def test_filters_reach_the_scan(tables):
    p = plan(memory.audit_by_record(tables("audit_log"), "t", "r").select("id", "timestamp"))
    assert "EqualTo(table_name,t)" in p and "EqualTo(record_id,r)" in p and "TakeOrderedAndProject" in p and "Exchange" not in p
    assert "new_value" not in re.search(r"ReadSchema: (\S+)", p)[1]


def test_vectors_are_read_only_when_needed(tables):
    p = plan(latest_rows(tables("vectors").select("id", "collection_id", "updated_at"), ["id", "collection_id"], ["updated_at"]))
    assert "vector:" not in p and p.count("Exchange") == 1
    p = plan(vector.vector_search(tables("vectors"), [1.0, 2.0], 5))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p


def test_partial_aggregation_before_the_shuffle(tables):
    feed = tables("audit_log")
    p = plan(reduce_changes(feed, ["table_name", "record_id"], "id", "action", "new_value", [F.col("timestamp")]))
    assert p.count("Exchange") == 1 and p.count("Aggregate(") >= 2 and "partial_max" in p and "Window" not in p
    p = plan(sync.merge_ops(tables("sync_log"), tables("sync_log")))
    assert p.count("Exchange") == 1 and "partial_min" in p


def test_last_messages_limit_groups_early(tables):
    p = plan(memory.last_messages(tables("messages"), 3))
    assert "WindowGroupLimit" in p and p.count("Exchange") == 1
