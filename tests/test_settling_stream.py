"""Captures that settle and jobs that wait, as streams, against a replay; in two session zones."""

import datetime
import random

import pytest
from test_streaming import run, stream_of

from folioflow.operators.captures import recheck
from folioflow.streaming import jobs, settling
from pyspark.sql import functions as F

UTC = datetime.UTC
ZERO = datetime.datetime(2026, 9, 8, tzinfo=UTC)
HOUR = 3_600_000
SCHEMA = "subject long, is_capture boolean, at timestamp, ended timestamp, sha256 string"


def at(ms):
    return None if ms is None else ZERO + datetime.timedelta(milliseconds=ms)


@pytest.fixture(params=["Asia/Tokyo", "America/Los_Angeles"])
def zone(spark, request):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", was)


def test_captures_settle_as_in_a_replay(spark, tmp_path, zone):
    rng = random.Random(9)
    captures, checks = {}, []
    for s in range(1, 13):
        captured = rng.randrange(0, 6 * HOUR)
        captures[s] = captured, rng.choice([None, captured - HOUR, captured - 30 * HOUR]), "a"
        t, sha = captured, "a"
        for _ in range(rng.randrange(0, 14)):
            t += rng.choice([HOUR // 2, HOUR, 3 * HOUR, 9 * HOUR])
            sha = rng.choice([sha, sha, "b", "c", None])
            checks.append((s, t, sha))
    events = [(s, True, at(c), at(e), sha) for s, (c, e, sha) in captures.items()] + [(s, False, at(t), None, sha) for s, t, sha in checks]
    rng.shuffle(events)
    size = -(-len(events) // 5)
    batches = [events[k : k + size] for k in range(0, len(events), size)]
    batches += [[(99, False, at(h * HOUR), None, "end")] for h in (900, 901)]  # only now the watermark passes any settling
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run(settling.settling(stream_of(spark, tmp_path, batches, SCHEMA), late="10 days"), tmp_path, spark, "settled")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = spark.table("settled").where("final").select("subject", "n_checks", "n_revisions", "settle", "under_churn", "reason", F.unix_millis("settled_at")).collect()
    zero = round(ZERO.timestamp() * 1000)
    want = {}
    for s, (c, e, sha) in captures.items():
        r = settling.replay(c, e, sha, [(t, x) for k, t, x in checks if k == s], 900 * HOUR)
        want[s] = (r["n_checks"], r["n_revisions"], True, r["under_churn"], r["reason"], r["settled_at"] + zero)
    assert {r[0]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    assert {x[4] for x in want.values()} == {"late", "unchanged", "backstop"}


def test_late_checks_revise_and_state_goes(spark, tmp_path):
    """A settling by two checks is taken back by a changed check between them that comes later; once final, nothing is left."""
    h = HOUR
    batches = [
        [(1, True, at(0), at(0), "a"), (1, False, at(3 * h), None, "a"), (1, False, at(6 * h), None, "a")],
        [(1, False, at(4 * h), None, "b")],
        [(9, False, at(100 * h), None, "x")],
        [(9, False, at(101 * h), None, "x")],
        [(1, False, at(101 * h), None, "a"), (9, False, at(102 * h), None, "x")],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = run(settling.settling(stream_of(spark, tmp_path, batches, SCHEMA), late="12 hours"), tmp_path, spark, "revised")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    own = [(r["n_checks"], r["n_revisions"], r["reason"], r["final"]) for r in got if r["subject"] == 1]
    assert own[0] == (2, 0, "unchanged", False)
    assert own[1][:3] == (3, 2, "provisional")
    assert own[-1] == (3, 2, "backstop", True)
    assert not any(r["subject"] == 9 for r in got)


def test_stream_gives_the_rows_of_the_batch_query(spark, tmp_path):
    """recheck() over users' events as observations, and the same as a stream in shuffled batches."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 12").select(F.col("user_id").alias("subject"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("sha256"))
    rows = [(r.subject, r.t % (40 * HOUR) + 1, r.sha256) for r in events.collect()]
    rows = list({(s, t): (s, t, x) for s, t, x in rows}.values())
    subjects = sorted({r[0] for r in rows})
    last = max(r[1] for r in rows)
    pairs = {s: settling.replay(0, 0, "view", [(t, x) for k, t, x in rows if k == s], last) for s in subjects}
    open_ = [s for s in subjects if pairs[s]["settled_at"] is None]
    caps = spark.createDataFrame([(s, 0, 0, "view") for s in open_], "subject long, captured long, ended long, sha256 string")
    seen = spark.createDataFrame([(s, t * 1000, x) for s, t, x in rows if s in open_], "subject long, checked long, sha256 string")
    batch = {r.subject: (r.n_checks, r.n_revisions, r.reason) for r in recheck(caps, seen, F.lit(last * 1000)).collect()}
    assert batch == {s: (pairs[s]["n_checks"], pairs[s]["n_revisions"], pairs[s]["reason"]) for s in open_} and batch
    random.Random(1).shuffle(rows)
    stream = [(s, False, at(t), None, x) for s, t, x in rows]
    half = len(stream) // 2
    cut = [stream[:half], [(s, True, at(0), at(0), "view") for s in subjects], stream[half:]]  # captures come after half of their checks
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = run(settling.settling(stream_of(spark, tmp_path, cut, SCHEMA), late="100 days"), tmp_path, spark, "rechecked")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    newest = {}
    for r in got:
        newest[r["subject"]] = (r["n_checks"], r["n_revisions"], r["reason"])
    own = {s: settling.replay(0, 0, "view", [(t, x) for k, t, x in rows if k == s], max(t for k, t, x in rows if k == s)) for s in subjects}
    assert newest == {s: (own[s]["n_checks"], own[s]["n_revisions"], own[s]["reason"]) for s in subjects}


def test_deferred_jobs_are_overtaken(spark, tmp_path, zone):
    m = lambda k: at(k * 60_000)
    requests = [
        [(1, "sync", "a", m(0), m(30)), (2, "sync", "b", m(1), None), (3, "sync", "c", m(2), m(10)), (4, "sync", "d", m(2), m(1))],
        [(5, "sync", "e", m(12), None), (1, "sync", "a2", m(13), m(20))],
        [(6, "sync", "f", m(25), m(26))],
        [(7, "sync", "g", m(40), None)],
        [(8, "sync", "h", m(41), m(500))],
        [(9, "sync", "i", m(42), None)],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = stream_of(spark, tmp_path, requests, "job_id long, kind string, payload string, at timestamp, run_after timestamp")
        got = run(settling.deferred(stream), tmp_path, spark, "deferred")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = [(r["job_id"], r["payload"]) for r in sorted(got, key=lambda r: r["delivered"])]
    assert order == [(2, "b"), (4, "d"), (3, "c"), (5, "e"), (1, "a2"), (6, "f"), (7, "g"), (9, "i")]  # 1 waited while 2 to 5 went; 8 still waits
    came = [r["job_id"] for r in got]
    assert came.index(5) < came.index(1)


def test_stale_jobs_in_any_zone(spark, tmp_path, zone):
    m = lambda k: ZERO + datetime.timedelta(minutes=k)
    beats = [[(1, m(0), False), (2, m(0), False), (3, m(0), False)], [(2, m(4), False), (3, m(4), True)], [(2, m(4.67), False)], [(9, m(8), False)], [(9, m(8.5), False)]]
    got = run(jobs.stale_jobs(stream_of(spark, tmp_path, beats, "job_id long, at timestamp, done boolean")), tmp_path, spark, "stale_zone")
    assert {(r["job_id"], r["attempts"]) for r in got} == {(1, 1)}
