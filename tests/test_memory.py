import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.errors import InvalidArgument
from mnemospark.operators import memory, sync
from mnemospark.operators.changes import BucketedTable
from mnemospark.streaming.feed import apply_feed, file_stream, once_by_id, sessions, tumbling


def test_window_against_loop(spark):
    rng = random.Random(1)
    rows = [(f"e{i:03d}", f"s{i % 7}", rng.choice([None, 0, -3, 5, 10, 40, 200]), rng.choice([0.1, 0.5]), rng.randint(0, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, session_id string, token_count long, relevance_score double, priority long")
    want = set()
    for s in {r[1] for r in rows}:
        used = 0
        for i, _, t, _, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[4], -r[3], r[0])):
            if used + (t or 0) <= 100:
                used += t or 0
                want.add((s, i, t or 0, used))
    assert {tuple(r) for r in memory.build_window(df, 100).collect()} == want


def test_transcript_and_positions(spark):
    m = spark.createDataFrame([("1", "c", "user", "a", 1), ("2", "c", "ai", None, 2), ("3", "c", "odd", "b", 2), ("4", "c", "system", "s", 0)], "id string, conversation_id string, role string, content string, created_at long")
    assert memory.transcript(m).first()["transcript"] == "AI: s\nHuman: a\nAI: \nHuman: b"
    assert [r["id"] for r in memory.last_messages(m, 2).orderBy("position").collect()] == ["2", "3"]
    assert memory.message_at(m, 0).first()["id"] == "4"


def test_step_fold(spark):
    e = spark.createDataFrame([("s", 1, 10, "running", None, None), ("s", 2, 11, "failed", "o", "e1"), ("s", 3, 12, "running", None, None), ("s", 4, 13, "completed", None, "e2"), ("s", 5, 14, "odd", None, None)], "step_id string, seq long, at long, status string, output string, error string")
    r = memory.fold_step_updates(e).first()
    assert tuple(r) == ("s", "odd", "o", "e2", 12, 13)
    with pytest.raises(InvalidArgument):
        memory.fold_step_updates(e, strict=True)


def test_trace_cycle_ends(spark):
    t = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "b", 3)], "id string, parent_id string, created_at long").withColumns({"session_id": F.lit("s"), "trace_type": F.lit("t"), "content": F.lit("x")})
    assert [r["id"] for r in memory.trace_tree(t, "a").collect()] == ["a", "b", "c"]


def test_clock():
    wall = [100]
    c = sync.Clock(lambda: wall[0])
    assert sync.unpack(c.now()) == (100, 0) and sync.unpack(c.now()) == (100, 1)
    assert sync.unpack(c.update(sync.pack(100, 7))) == (100, 8)
    assert sync.unpack(c.update(sync.pack(200, 3))) == (200, 4)
    assert sync.unpack(c.update(sync.pack(50, 3))) == (200, 5)
    wall[0] = 300
    assert sync.unpack(c.update(sync.pack(250, 3))) == (300, 0)
    assert sync.unpack(sync.pack(1, 65_536)) == (1, 0)


def op(op_id, hlc, record, seq):
    return op_id, hlc, "n", "t", record, "update", None, seq


@pytest.mark.parametrize("strategy", ["lww", "fww"])
def test_merge_against_loop(spark, strategy):
    rng = random.Random(3)
    local = [op(f"l{i}", rng.randrange(20), f"r{i % 5}", i) for i in range(5)]
    remote = [op(f"r{i}", rng.randrange(20), f"r{rng.randrange(8)}", i) for i in range(60)]
    state, applied, conflicts, skipped = {o[4]: o for o in local}, 0, 0, 0
    for o in remote:
        old = state.get(o[4])
        conflicts += old is not None
        if old is None or (o[1] > old[1] if strategy == "lww" else o[1] < old[1]):
            state[o[4]] = o
            applied += 1
        else:
            skipped += 1
    schema = "op_id string, hlc_ts long, node_id string, table_name string, record_id string, op_type string, payload string, seq long"
    a, b = spark.createDataFrame(local, schema), spark.createDataFrame(remote, schema)
    assert {r["record_id"]: r["op_id"] for r in sync.merge_ops(a, b, strategy).collect()} == {k: v[0] for k, v in state.items()}
    assert tuple(sync.merge_counts(a, b, strategy).first()) == (applied, conflicts, skipped)


def test_feed_stream(spark, tmp_path):
    schema = "id string, timestamp long, action string, record_id string, new_value string"
    batches = [[("1", 1, "insert", "a", "x"), ("2", 2, "insert", "b", "y")], [("4", 4, "delete", "b", None), ("3", 3, "update", "a", "z")], [("1", 1, "insert", "a", "x"), ("5", 5, "update", "b", "late")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = BucketedTable(spark, str(tmp_path / "table"), ["record_id"], 4)
    q = apply_feed(file_stream(spark, str(tmp_path / "in"), T.StructType.fromDDL(schema), 1), table, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {tuple(r) for r in table.read().collect()} == {("a", "3", "z")} and table.manifest()["version"] == 3


def test_event_windows(spark, tmp_path):
    rows = [(i, "2024-01-01 00:%02d:00" % m, "k") for i, m in enumerate([0, 4, 5, 20, 21, 59])]
    df = spark.createDataFrame(rows, "id int, t string, key string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in tumbling(df, "t", "10 minutes").collect()) == [1, 2, 3]
    assert sum(r["n"] for r in tumbling(df, "t", "10 minutes", slide="5 minutes").collect()) == 12
    assert sorted(r["n"] for r in sessions(df, "t", "10 minutes", "key").collect()) == [1, 2, 3]
    assert once_by_id(df.union(df), "t", "id").count() == 6
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = tumbling(stream, "t", "10 minutes", late="5 minutes").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("win").collect()) == [1, 2, 3]
