"""Resolution of observations, chains, running totals, nested ranges and the store, against brute force."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.operators import closure, placing, resolution, state, temporal
from folioflow.sources import store

MEETING = "body_id long, starts_at string, title string, type string, is_cancelled boolean, is_continued boolean, portal_source_id long, portal_meeting_id long, template_id long"
COLUMNS = [c.split()[0] for c in MEETING.split(", ")]


def fold(stored, observed):
    """One upsert after the other, as each arrives."""
    rows = [dict(zip(["id", *COLUMNS], r)) | {"seen": 0} for r in stored]
    for o in sorted(observed):
        o = dict(zip(COLUMNS, o[1:]))
        found = None
        if o["portal_source_id"] is not None and o["portal_meeting_id"] is not None:
            found = next((r for r in rows if (r["portal_source_id"], r["portal_meeting_id"]) == (o["portal_source_id"], o["portal_meeting_id"])), None)
        if found is None:
            same = [r for r in rows if r["body_id"] == o["body_id"] and r["starts_at"] == o["starts_at"] and r["portal_source_id"] is None and r["portal_meeting_id"] is None]
            found = same[0] if len(same) == 1 else None
        if found is None:
            rows.append(o | {"id": None, "seen": 1})
            continue
        found |= {c: o[c] for c in ("starts_at", "title", "type")} | {c: found[c] or o[c] for c in ("is_cancelled", "is_continued")}
        found |= {c: found[c] if o[c] is None else o[c] for c in ("portal_source_id", "portal_meeting_id", "template_id")} | {"seen": found["seen"] + 1}
    return sorted(((r["id"], r["seen"], *[r[c] for c in COLUMNS]) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_meetings_resolve_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)

    def meeting(k, ids):
        return (rng.randrange(3), f"2026-0{rng.randrange(1, 4)}", rng.choice([None, f"t{k}"]), rng.choice(["regular", "special"]), rng.random() < 0.1, rng.random() < 0.1, *ids, rng.choice([None, k]))

    stored = [(1, *meeting(1, (1, 50))), (2, *meeting(2, (2, 51))), (3, *meeting(3, (1, None)))] + [(4 + k, *meeting(k, (None, None))) for k in range(6)]
    ids = lambda: rng.choice([(None, None), (None, None), (1, rng.randrange(48, 60)), (2, rng.randrange(48, 60)), (1, None), (None, 52)])
    observed = [(k, *meeting(k, ids())) for k in range(120)]
    observed += [(200 + k, *o[1:]) for k, o in enumerate(observed[:10])]  # repeats
    got = resolution.resolve_meetings(spark.createDataFrame(stored, "id long, " + MEETING), spark.createDataFrame(rng.sample(observed, len(observed)), "arrival long, " + MEETING))
    assert sorted((tuple(r) for r in got.select("id", "n_seen", *COLUMNS).collect()), key=str) == fold(stored, observed)
    assert got.select("row").distinct().count() == got.count()


def test_two_arrivals_contest_one_row(spark):
    """Two portals' ids for one unclaimed sitting in one batch: the first takes it, the second is another sitting."""
    stored = [(7, 1, "2026-09-08", "Council", "regular", False, False, None, None, None)]
    observed = [(1, 1, "2026-09-08", "Council A", "regular", False, False, 1, 10, None), (2, 1, "2026-09-08", "Council B", "regular", True, False, 2, 20, None), (3, 1, "2026-09-09", "Council A moved", "regular", False, False, 1, 10, 5)]
    got = resolution.resolve_meetings(spark.createDataFrame(stored, "id long, " + MEETING), spark.createDataFrame(observed, "arrival long, " + MEETING))
    assert sorted((tuple(r) for r in got.select("id", "n_seen", *COLUMNS).collect()), key=str) == fold(stored, observed)
    assert {(r.id, r.portal_source_id, r.starts_at) for r in got.collect()} == {(7, 1, "2026-09-09"), (None, 2, "2026-09-08")}
    none = spark.createDataFrame([], "arrival long, " + MEETING)
    assert resolution.resolve_meetings(spark.createDataFrame(stored, "id long, " + MEETING), none).count() == 1


VIDEO = ["source_id", "platform_id", "meeting_id", "title", "url", "readiness"]


def adopt(stored, listed):
    rows = [dict(zip(["id", "is_primary", *VIDEO], r)) | {"seen": 0} for r in stored]
    for _, *o in sorted(listed):
        o = dict(zip(VIDEO, o))
        known = [r for r in rows if r["platform_id"] == o["platform_id"]]
        found = next((r for r in known if r["source_id"] == o["source_id"]), known[0] if known else None)
        if found is None:
            rows.append(o | {"id": None, "is_primary": False, "seen": 1})
            found = rows[-1]
        else:
            found["seen"] += 1
            found["meeting_id"] = found["meeting_id"] if found["meeting_id"] is not None else o["meeting_id"]
            if o["meeting_id"] is not None:
                found["url"] = found["url"] if found["url"] is not None else o["url"]
            if found["readiness"] == "unknown":
                found["readiness"] = o["readiness"]
        if o["meeting_id"] is not None and found["meeting_id"] == o["meeting_id"] and not any(r["is_primary"] and r["meeting_id"] == o["meeting_id"] for r in rows):
            found["is_primary"] = True
    return sorted(((r["id"], r["seen"], r["is_primary"], *[r[c] for c in VIDEO]) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_videos_are_adopted_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    video = lambda: (rng.randrange(3), f"v{rng.randrange(14)}", rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "a", "b"]), rng.choice([None, "u1", "u2"]), rng.choice(["unknown", "live", "finished"]))
    stored = [(k, False, *video()) for k in range(9)]
    stored[0] = (0, True, 0, "v1", 1, "kept", None, "unknown")
    listed = [(k, *video()) for k in range(60)]
    got = resolution.adopt_videos(
        spark.createDataFrame(stored, "id long, is_primary boolean, source_id long, platform_id string, meeting_id long, title string, url string, readiness string"),
        spark.createDataFrame(listed, "arrival long, source_id long, platform_id string, meeting_id long, title string, url string, readiness string"),
    )
    assert sorted((tuple(r) for r in got.select("id", "n_seen", "is_primary", *VIDEO).collect()), key=str) == adopt(stored, listed)


# chains


def test_components_of_a_long_path(spark, monkeypatch):
    n = 100_000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rounds = []
    grand = closure._grand
    monkeypatch.setattr(closure, "_grand", lambda p, c, k: rounds.append(k) or grand(p, c, k))
    got = closure.components(edges).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (n, 0) and max(rounds) < 20


def test_components_match_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400), (500, None), (None, None)] + [(1000, 2000 + i) for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ends = sorted(find(x) for x in (a, b) if x is not None)
        if len(ends) == 2:
            root[ends[1]] = ends[0]
    got = {r["node"]: r["component"] for r in closure.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert closure.components(spark.createDataFrame([], "a long, b long")).count() == 0
    pairs = spark.createDataFrame([(1, 2), (3, 2), (8, 9)], "id long, previous_id long")
    assert sorted(r[0] for r in state.revision_group(pairs, [3, 77]).collect()) == [1, 2, 3, 77]


# running totals


def test_running_totals_of_one_large_day(spark):
    """All uses on one local day, over many ranges; and amounts of several groups, null ones too."""
    uses = spark.range(20_000).select("id", F.timestamp_seconds(F.lit(1_770_000_000) + F.pmod(F.xxhash64("id"), F.lit(40_000))).alias("at"))
    got = state.quota(uses, "at", ["id"], 15_000, "UTC")
    order = sorted((r["at"], r["id"]) for r in uses.collect())
    days = {}
    want = {}
    for at, i in order:
        days[at.date()] = days.get(at.date(), 0) + 1
        want[i] = days[at.date()]
    assert {r["id"]: r["used"] for r in got.collect()} == want
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, -3])) for i in range(500)]
    out = placing.running_total(spark.createDataFrame(rows, "g string, i long, x long"), ["g"], ["i"], F.col("x"))
    sums, want = {}, {}
    for g, i, x in rows:
        sums[g] = want[i] = sums.get(g, 0) + (x or 0)
    assert {r["i"]: r["total"] for r in out.collect()} == want


# ranges


def test_nested_ranges_are_swept(spark):
    rng = random.Random(6)
    ranges = [(k % 3, s, s + rng.choice([3, 20, 200, 900]), k) for k, s in enumerate(rng.randrange(1000) for _ in range(300))] + [(None, 0, 9, 900)]
    points = [(rng.choice([0, 1, 2, 3, None]), rng.randrange(-5, 1300), i) for i in range(800)]
    points += points[:5]
    got = temporal.latest_range(spark.createDataFrame(points, "k long, at long, i long"), spark.createDataFrame(ranges, "k long, s long, e long, r long"), "k", "at", "s", "e", "r")
    best = lambda k, at: min(((-s, r) for g, s, e, r in ranges if g == k and g is not None and s <= at < e), default=(None, None))[1]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((k, at, i, best(k, at)) for k, at, i in points), key=str)


def test_ten_thousand_ranges_in_one_key(spark):
    """Each range holds all that start later: the range a point lies in is told by how many have ended."""
    n = 10_000
    ranges = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), (2 * n - F.col("id")).alias("e"), F.col("id").alias("r"))
    points = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") % (2 * n + 50)).alias("at"), "id")
    got = temporal.latest_range(points, ranges, "k", "at", "s", "e", "r")
    want = F.when(F.col("at") < n, F.col("at")).when(F.col("at") < 2 * n, 2 * n - 1 - F.col("at"))
    assert got.where(~F.col("range_id").eqNullSafe(want)).count() == 0 and got.count() == 100_000


# the store


def files_of(root):
    return sorted(p.name for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_store_keeps_each_content_once(spark, tmp_path):
    root, rows_path = f"{tmp_path}/files", f"{tmp_path}/rows"
    blobs = [("page", "txt", b"one"), ("page", "txt", b"two"), ("page", "txt", b"one"), ("other", "txt", b"one"), ("page", "txt", None), ("page", "txt", b"")]
    frame = spark.createDataFrame(blobs, "kind string, ext string, data binary")
    name = lambda kind, data: f"{kind}-{hashlib.sha256(data).hexdigest()}.txt"
    want = sorted([name("page", b"one"), name("page", b"two"), name("other", b"one"), name("page", b"")])
    for _ in range(2):  # the second time nothing is written
        rows = store.store(frame.repartition(4), root, rows_path)
        assert sorted(r.rel_path for r in rows.collect()) == want and files_of(root) == want
    assert store.reconcile(rows, root).count() == 0
    with pytest.raises(Exception, match="no file may be named"):
        store.store(spark.createDataFrame([("../x", "txt", b"1")], "kind string, ext string, data binary"), root, rows_path)
    with pytest.raises(store.IntegrityError, match="asked for, or stored, as"):
        store.store(spark.createDataFrame([("page", "bin", b"one")], "kind string, ext string, data binary"), root, rows_path)
    (Path(root) / name("page", b"two")).write_bytes(b"changed")
    with pytest.raises(Exception, match="holds other bytes"):
        store.store(frame, root, rows_path)
    assert (Path(root) / name("page", b"two")).read_bytes() == b"changed" and not [f for f in files_of(root) if f.endswith(".tmp")]


def test_three_findings_and_citations(spark, tmp_path):
    root, rows_path = f"{tmp_path}/files", f"{tmp_path}/rows"
    data = [b"kept", b"gone", b"changed", b"again"]
    rows = store.store(spark.createDataFrame([("page", "txt", x) for x in data], "kind string, ext string, data binary"), root, rows_path)
    path = {r.sha256: Path(root) / r.rel_path for r in rows.collect()}
    sha = {x: hashlib.sha256(x).hexdigest() for x in data}
    path[sha[b"gone"]].unlink()
    path[sha[b"changed"]].write_bytes(b"something else")
    for p in Path(root).glob(".*.crc"):
        p.unlink()
    (Path(root) / "stray.txt").write_bytes(b"stray")
    (Path(root) / ".staged.tmp").write_bytes(b"half")
    (Path(root) / f"page-{'0' * 64}.txt").write_bytes(b"not zero")
    got = {(r.finding, r.rel_path) for r in store.reconcile(rows, root).collect()}
    assert got == {("missing", path[sha[b"gone"]].name), ("changed", path[sha[b"changed"]].name), ("unrecorded", "stray.txt"), ("changed", f"page-{'0' * 64}.txt")}
    cited = spark.createDataFrame([("page", sha[x]) for x in data] + [("page", "ff"), ("other", sha[b"kept"])], "kind string, sha256 string")
    told = {(r.kind, r.sha256): r.verified for r in store.verified(cited, rows, root).collect()}
    assert {k for k, v in told.items() if v} == {("page", sha[b"kept"]), ("page", sha[b"again"])} and len(told) == 6
    assert store.reconcile(rows, f"{tmp_path}/nowhere").where("finding = 'missing'").count() == 4


def test_a_task_that_fails_adds_no_rows(spark, tmp_path):
    root, rows_path = f"{tmp_path}/files", f"{tmp_path}/rows"
    good = spark.createDataFrame([("page", "txt", b"%d" % i) for i in range(20)], "kind string, ext string, data binary")
    bad = good.unionByName(spark.createDataFrame([("Bad Kind", "txt", b"x")], "kind string, ext string, data binary"))
    with pytest.raises(Exception, match="no file may be named"):
        store.store(bad, root, rows_path)
    assert not Path(rows_path).exists()
    assert store.store(good, root, rows_path).count() == 20 and len(files_of(root)) == 20
