"""File changes as a stream: the state of every file, and rebuilds that wait until a file is quiet.

``file_states`` keeps one bounded row of state per file (an aggregation in update mode). Every batch
writes the rows it changed under its batch number, by overwriting, so a batch that is run again after a
failure replaces its own rows; readers take the last row per file. Changes may come late and in any
order: which one is last is decided by their time and number, not by arrival.

``rebuilds`` joins changes of a file that follow each other within ``quiet`` into one session and gives
it out when the watermark has passed its end, so a burst of saves causes one rebuild. Only open sessions
are kept as state; changes that come more than ``late`` behind the newest one are too late for theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CHANGE_SCHEMA = "change_id bigint, ts timestamp, path string, kind string"
STATE_SCHEMA = "path string, changes bigint, last_kind string, last_ts timestamp, last_change bigint"
SESSION_SCHEMA = "path string, started timestamp, ended timestamp, changes bigint, last_kind string"


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Changes (change_id, ts, path, kind) from the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def state_of(changes: DataFrame) -> DataFrame:
    """Number of changes and the last one of every file; of a table or a stream."""
    last = F.max(F.struct("ts", "change_id", "kind"))
    return changes.groupBy("path").agg(F.count(F.lit(1)).alias("changes"), last.alias("last")).select(
        "path", "changes", F.col("last.kind").alias("last_kind"), F.col("last.ts").alias("last_ts"), F.col("last.change_id").alias("last_change")
    )


def file_states(changes: DataFrame, folder: str) -> DataFrame:
    """Run a stream of changes over all that has arrived; the state of every file afterwards.

    ``folder`` keeps the checkpoint and the states, so the next run goes on where this one ended.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")

    run = (
        state_of(changes).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return current_states(changes.sparkSession, folder)


def current_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last written state of every file."""
    written = spark.read.schema(f"{STATE_SCHEMA}, batch bigint").parquet(f"{folder}/states")
    newest = F.max_by(F.struct("changes", "last_kind", "last_ts", "last_change"), "batch").alias("s")
    return written.groupBy("path").agg(newest).select("path", "s.*")


def bursts_of(changes: DataFrame, quiet: str) -> DataFrame:
    """(path, started, ended, changes, last_kind): changes of a file that follow each other within
    ``quiet``; of a table or a stream."""
    sessions = changes.groupBy("path", F.session_window("ts", quiet).alias("burst")).agg(
        F.count(F.lit(1)).alias("changes"), F.max(F.struct("ts", "change_id", "kind")).alias("last")
    )
    return sessions.select("path", F.col("burst.start").alias("started"), F.col("last.ts").alias("ended"), "changes", F.col("last.kind").alias("last_kind"))


def rebuilds(changes: DataFrame, folder: str, quiet: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Run a stream of changes over all that has arrived; one row per finished burst of a file.

    A burst is finished once a change of any file is more than ``late`` newer than its end. Bursts that
    are still open stay in the state for the next run.
    """
    run = (
        bursts_of(changes.withWatermark("ts", late), quiet).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/bursts")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return changes.sparkSession.read.schema(SESSION_SCHEMA).parquet(f"{folder}/bursts")
