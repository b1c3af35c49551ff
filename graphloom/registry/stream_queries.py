"""File-change streams over the event table: each event is a change of one file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.registry.base import query
from graphloom.session import scratch_dir
from graphloom.sources.change_stream import change_stream, file_states, rebuilds

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"
CHANGES_SQL = """
with changes as (
  select event_id as change_id, ts, 'u' || user_id || '/f' || event_id % 3 || '.py' as path,
    case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'changed' end as kind from events)
"""


def table_changes(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("changed")
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    return events.select(
        F.col("event_id").alias("change_id"), "ts",
        F.expr("concat('u', user_id, '/f', event_id % 3, '.py')").alias("path"), kind.alias("kind"),
    )


def _arrived(spark, sf, parts: int):
    """The changes dealt over files by their number, so files overlap in time and come out of order."""
    folder = f"{scratch_dir(spark)}/changes/{uuid.uuid4().hex}"
    table_changes(spark, sf).repartition(parts, F.pmod("change_id", F.lit(parts))).write.parquet(f"{folder}/arrived")
    return folder


@query("stream_file_state", CHANGES_SQL + """
select path, count(*) as changes, arg_max(kind, row(ts, change_id)) as last_kind, arg_max(change_id, row(ts, change_id)) as last_change
from changes group by path""")
def stream_file_state(spark, sf):
    """The state of every file after a stream in several batches, late and unordered changes included."""
    folder = _arrived(spark, sf, 8)
    states = file_states(change_stream(spark, f"{folder}/arrived", files_per_batch=2), folder)
    return states.select("path", "changes", "last_kind", "last_change")


@query("stream_rebuilds", CHANGES_SQL + """
, gaps as (select *, case when ts < lag(ts) over w + interval 6 hour then 0 else 1 end as begins from changes
  window w as (partition by path order by ts, change_id)),
numbered as (select *, sum(begins) over (partition by path order by ts, change_id) as n from gaps),
bursts as (select path, n, count(*) as changes, arg_max(kind, row(ts, change_id)) as last_kind, max(ts) as ended from numbered group by path, n)
select path, changes, last_kind from bursts
where ended + interval 6 hour <= (select max(ts) from changes) - interval 1 day""")
def stream_rebuilds(spark, sf):
    """One row per finished burst of a file: changes within six hours of each other, a day after the last."""
    folder = f"{scratch_dir(spark)}/changes/{uuid.uuid4().hex}"
    table_changes(spark, sf).write.parquet(f"{folder}/arrived")
    bursts = rebuilds(change_stream(spark, f"{folder}/arrived", files_per_batch=10**6), folder, "6 hours", "1 day")
    return bursts.select("path", "changes", "last_kind")
