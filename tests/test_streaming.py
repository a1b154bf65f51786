"""Structured Streaming jobs over folders of small files."""

import datetime

from folioflow.operators.search import windows
from folioflow.streaming import jobs


def at(text):
    return datetime.datetime.fromisoformat(text)


def stream_of(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"{k:03d}"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(stream, tmp_path, spark, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_once_per_day(spark, tmp_path):
    ticks = [[("sync", 1, at("2026-09-08T11:59:00+00:00")), ("sync", 1, at("2026-09-08T12:00:00+00:00")), ("sync", 2, at("2026-09-08T13:00:00+00:00"))], [("sync", 1, at("2026-09-08T18:00:00+00:00")), ("sync", 1, at("2026-09-09T12:30:00+00:00"))]]
    got = run(jobs.once_per_day(stream_of(spark, tmp_path, ticks, "task string, subject long, at timestamp"), "America/Denver", "06:00"), tmp_path, spark, "once")
    assert sorted((r["subject"], str(r["due_on"])) for r in got) == [(1, "2026-09-08"), (1, "2026-09-09"), (2, "2026-09-08")]


def test_stale_jobs(spark, tmp_path):
    m = lambda k: at(f"2026-09-08T10:{k:02d}:00+00:00")
    beats = [[(1, m(0), False), (2, m(0), False), (3, m(0), False)], [(2, m(4), False), (3, m(4), True)], [(2, m(8), False)], [(9, m(30), False)], [(9, m(31), False)]]
    got = run(jobs.stale_jobs(stream_of(spark, tmp_path, beats, "job_id long, at timestamp, done boolean")), tmp_path, spark, "stale")
    assert {(r["job_id"], r["attempts"]) for r in got} == {(1, 1), (2, 1)}


def test_windows_follow_lines(spark, tmp_path):
    batches = [[(1, 1, 0, "a"), (1, 2, 10, "b"), (2, 1, 0, "x")], [(1, 3, 20, "c"), (1, 2, 10, "B")]]
    lines = stream_of(spark, tmp_path, batches, "transcript_id long, id long, start_ms long, text string")
    path = str(tmp_path / "windows")
    jobs.keep_windows(lines, str(tmp_path / "lines"), path, str(tmp_path / "cp")).awaitTermination(120)
    want = windows(spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 10, "B"), (1, 3, 20, "c"), (2, 1, 0, "x")], "transcript_id long, id long, start_ms long, text string"))
    got = spark.read.schema(want.schema).parquet(path).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
