"""File-change streams against the same functions over the whole table."""

import random
from datetime import datetime, timedelta

from graphloom.sources.change_stream import CHANGE_SCHEMA, bursts_of, change_stream, file_states, rebuilds, state_of

START = datetime(2024, 1, 1)


def deliver(spark, folder, rows):
    """One more file of changes (change_id, minute, path, kind)."""
    frame = spark.createDataFrame([(i, START + timedelta(minutes=m), p, k) for i, m, p, k in rows], CHANGE_SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(folder)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_states_equal_the_table_over_several_runs(spark, tmp_path):
    rng = random.Random(3)
    changes = [(i, rng.randrange(500), f"f{rng.randrange(6) * rng.randrange(2)}.py", rng.choice(["created", "changed", "deleted"])) for i in range(120)]
    changes += [(1000, 7, None, "changed"), (1001, 7, None, None)]
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        for piece in range(2):
            deliver(spark, source, changes[part * 2 + piece :: 6])
        states = file_states(change_stream(spark, source, files_per_batch=1), folder)
        assert rows_of(states.na.fill("-")) == rows_of(state_of(spark.read.schema(CHANGE_SCHEMA).parquet(source)).na.fill("-"))


def test_bursts_come_once_they_are_finished(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: rows_of(rebuilds(change_stream(spark, source, files_per_batch=1), folder, "10 minutes", "30 minutes").select("path", "changes", "last_kind"))
    deliver(spark, source, [(1, 0, "a", "created"), (2, 5, "a", "changed"), (3, 30, "b", "created")])
    assert run() == []
    # Late, but within the watermark: it joins the open burst of its file.
    deliver(spark, source, [(4, 12, "a", "deleted"), (5, 60, "b", "changed")])
    assert run() == [("a", 3, "deleted")]
    # Too late for the burst of a, which is out; b's first burst is finished now.
    deliver(spark, source, [(6, 13, "a", "changed"), (7, 200, "c", "created")])
    assert run() == [("a", 3, "deleted"), ("b", 1, "changed"), ("b", 1, "created")]
    whole = bursts_of(spark.read.schema(CHANGE_SCHEMA).parquet(source).filter("change_id <> 6"), "10 minutes")
    assert rows_of(whole.select("path", "changes", "last_kind")) == sorted([*run(), ("c", 1, "created")])


def test_nothing_arrived(spark, tmp_path):
    spark.createDataFrame([], CHANGE_SCHEMA).write.parquet(f"{tmp_path}/in")
    assert file_states(change_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/states").count() == 0
    assert rebuilds(change_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/bursts").count() == 0
