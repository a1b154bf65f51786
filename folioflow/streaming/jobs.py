"""Streams of job rows, captures and transcript lines: once a day, heartbeats that stop, captures that settle, windows kept current."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.functions.times import due_day
from folioflow.operators.search import windows
from folioflow.sources.cuts import remove
from folioflow.sources.tables import stored_rows, write_again


def once_per_day(ticks: DataFrame, zone: str, daily_at: str, late: str = "2 days") -> DataFrame:
    """[SM6, DT8] task, subject, due_on, at: the first tick of each subject and local day once the day's time has come.

    ticks (a stream): task, subject, at (timestamp). State is kept for `late`, so it doesn't grow with time."""
    due = ticks.withWatermark("at", late).withColumn("due_on", due_day(F.col("at"), zone, daily_at)).where("due_on is not null")
    return due.dropDuplicatesWithinWatermark(["task", "subject", "due_on"])


HEARD = "last long, attempts int"
STALE = "job_id long, last long, attempts int"


def stale_jobs(beats: DataFrame, after: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """[SM1] job_id, last, attempts: a row whenever a running job has sent no heartbeat for `after` of event time; it then counts one attempt more.

    beats (a stream): job_id, at (timestamp), done (boolean). One small state a job; a job that is done leaves none. State holds
    milliseconds since 1970 in UTC, so the session's zone doesn't matter."""
    ms = int(pd.Timedelta(after).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, attempts = state.get
            state.update((last, attempts + 1))
            yield pd.DataFrame({"job_id": [key[0]], "last": [last], "attempts": [attempts + 1]})
            return
        rows = pd.concat(list(batches))
        if rows.done.any():
            state.remove()
            return
        last, attempts = state.get if state.exists else (None, 0)
        newest = int(rows["at_ms"].max())
        last = newest if last is None else max(last, newest)
        state.update((last, attempts))
        state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))

    marked = beats.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    found = marked.groupBy("job_id").applyInPandasWithState(follow, STALE, HEARD, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("last", F.timestamp_millis("last"))


#: Parts of the tables of lines and windows; a batch reads and writes those that its transcripts lie in.
BUCKETS = 64


def keep_windows(lines: DataFrame, lines_path: str, windows_path: str, checkpoint: str):
    """[WN3] Starts a query that keeps the search windows of transcripts current: each batch of lines (a stream: transcript_id, id, start_ms,
    text) is added to its transcripts, and the buckets that hold them are written anew. A batch read twice changes nothing.

    Transcripts lie in BUCKETS parts by a hash, so the number of folders doesn't grow with them; parts that no transcript of a batch lies in are
    neither read nor written. What is about to be written over is staged under the batch's number first."""

    def refresh(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64("transcript_id"), F.lit(BUCKETS)).cast("int"))
        touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if not touched:
            return
        stored = stored_rows(spark, lines_path, dealt).where(F.col("bucket").isin(touched)).select(dealt.columns)
        newest = dealt.withColumn("_new", F.lit(1)).unionByName(stored.withColumn("_new", F.lit(0)))
        rest = [c for c in dealt.columns if c not in ("transcript_id", "id")]
        whole = newest.groupBy("transcript_id", "id").agg(F.max_by(F.struct(*rest), "_new").alias("x")).select("transcript_id", "id", "x.*").select(dealt.columns)
        staged = f"{lines_path}.staged/batch-{number}"
        whole.write.mode("overwrite").parquet(staged)
        kept = spark.read.schema(dealt.schema).parquet(staged)
        write_again(kept, lines_path, "bucket")
        made = windows(kept).withColumn("bucket", F.pmod(F.xxhash64("transcript_id"), F.lit(BUCKETS)).cast("int"))
        write_again(made, windows_path, "bucket")
        remove(spark, staged)

    return lines.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
