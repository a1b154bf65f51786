"""Whole syncs that die and go on, exports that fail whole, offices before names, and videos' meetings, on literal cases and brute force."""

import csv
import io
import json
import random
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.operators import minutes, portal
from folioflow.sources import answers, exports
from folioflow.streaming import syncing

DOC = {"id": 5, "templateId": 7, "compileOutputType": 1, "templateName": "Agenda"}
FEED = {
    "one/1.json": [
        {"id": 1, "dateTime": "2026-09-08T19:00:00", "title": "City Council Regular Session", "videoUrl": "https://www.youtube.com/watch?v=abcdefghijk", "documentList": [DOC, DOC | {"id": 6, "compileOutputType": 3, "templateName": "HTML Agenda"}, DOC | {"id": 8, "compileOutputType": 2}]},
        {"id": 2, "dateTime": "2026-09-09T19:00:00", "title": "Dog Show", "videoUrl": "", "documentList": []},
        {"id": 3, "dateTime": "2026-09-10T19:00:00", "title": "Water Board Meeting", "videoUrl": "https://example.invalid/x", "documentList": [DOC | {"templateName": "Notice of Cancellation"}]},
    ],
    "one/2.json": [
        {"id": 1, "dateTime": "2026-09-08T20:00:00", "title": "City Council Regular Session POSTPONED", "videoUrl": "https://www.youtube.com/watch?v=abcdefghijk", "documentList": [DOC]},
        {"id": 4, "dateTime": "2026-09-11T19:00:00", "title": "Water Board Special Meeting", "videoUrl": "https://youtu.be/bbbbbbbbbbb", "documentList": []},
    ],
    "two/3.json": [{"id": 1, "dateTime": "2026-09-08T19:00:00", "title": "City Council", "videoUrl": "https://youtu.be/abcdefghijk", "documentList": []}],
}


class Dead(Exception):
    pass


@pytest.fixture()
def setting(spark, tmp_path):
    for name, rows in FEED.items():
        (tmp_path / "feed" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "feed" / name).write_text(json.dumps(rows))
    sources = spark.createDataFrame([(1, "one", 10, "Town", None), (2, "two", 10, "Town", None)], "source_id long, site string, area_id long, city string, body_id long")
    bodies = spark.createDataFrame([(10, 100, "City Council"), (10, 200, "Water Board")], "area_id long, body_id long, name string")
    return tmp_path, sources, bodies


def outcome(spark, folder):
    rows = lambda name, *drop: sorted((tuple(v for k, v in r.asDict().items() if k not in ("id", *drop)) for r in syncing.current_rows(spark, folder, name).collect()), key=str)
    return {name: rows(name) if name != "documents" and name != "videos" else rows(name, "meeting_id") for name in syncing.TABLES}


def batches(spark, feed):
    rows = answers.answers(spark, str(feed))
    return [rows.where(F.col("file").endswith(f"/{k}.json")) for k in (1, 2, 3)]


def test_sync_of_three_batches(spark, setting):
    tmp, sources, bodies = setting
    folder = f"{tmp}/out"
    for k, lists in enumerate(batches(spark, tmp / "feed")):
        assert syncing.sync_batch(lists, k, folder, sources, bodies)
        assert not syncing.sync_batch(lists, k, folder, sources, bodies)
    got = outcome(spark, folder)
    assert {(r.portal_source_id, r.portal_meeting_id, r.starts_at[:13], r.type, r.is_cancelled, r.is_continued) for r in syncing.current_rows(spark, folder, "meetings").collect()} == {
        (1, 1, "2026-09-08T20", "regular", False, True), (1, 3, "2026-09-10T19", "regular", True, False), (1, 4, "2026-09-11T19", "special", False, False), (2, 1, "2026-09-08T19", "regular", False, False),
    } and len(got["meetings"]) == 4
    videos = {r.platform_id: r for r in syncing.current_rows(spark, folder, "videos").collect()}
    assert set(videos) == {"abcdefghijk", "bbbbbbbbbbb"} and all(v.is_primary for v in videos.values()) and videos["abcdefghijk"].source_id == 1
    assert {(r.document_id, r.action) for r in syncing.current_rows(spark, folder, "documents").collect()} == {(5, "download"), (6, "read")}
    tally = sorted((r.batch, *[r[c] for c in ("source_id", "listed", "meetings_created", "meetings_updated", "cancelled", "continued", "videos_created", "videos_linked", "documents_queued", "agendas_to_read", "skipped")]) for r in syncing._table(spark, folder, "tally").collect())
    assert tally == [(0, 1, 3, 2, 0, 1, 0, 1, 0, 2, 1, 3), (1, 1, 2, 1, 1, 0, 1, 1, 1, 0, 0, 0), (2, 2, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0)]
    assert {r.reason for r in syncing.current_rows(spark, folder, "skips").collect()} == {"no body of the area is named by Dog Show", "no video's id can be read from https://example.invalid/x", "a document is compiled as 2"}


def test_a_sync_that_dies_between_writes_goes_on(spark, setting):
    """The second batch dies after one table, then after others; in the end all is as if it never had."""
    tmp, sources, bodies = setting
    lists = batches(spark, tmp / "feed")
    for k in (0, 1):
        syncing.sync_batch(lists[k], k, f"{tmp}/whole", sources, bodies)
        if k == 0:
            shutil.copytree(f"{tmp}/whole", f"{tmp}/died")
    before = outcome(spark, f"{tmp}/died")
    for dies_after in ("meetings", "documents", "tally"):

        def die(name):
            if name == dies_after:  # noqa: B023
                raise Dead(name)

        with pytest.raises(Dead):
            syncing.sync_batch(lists[1], 1, f"{tmp}/died", sources, bodies, wrote=die)
        assert outcome(spark, f"{tmp}/died") == before  # nothing of it counts yet
    assert syncing.sync_batch(lists[1], 1, f"{tmp}/died", sources, bodies)
    assert outcome(spark, f"{tmp}/died") == outcome(spark, f"{tmp}/whole") != before


def test_sync_as_a_stream(spark, setting):
    tmp, sources, bodies = setting
    spark.dataSource.register(answers.MeetingAnswers)
    stream = spark.readStream.format("meeting_answers").option("path", f"{tmp}/feed").option("maxFiles", "1").load()
    query = syncing.sync(stream, f"{tmp}/stream", sources, bodies, f"{tmp}/cp")
    query.processAllAvailable()
    query.stop()
    assert syncing.committed(spark, f"{tmp}/stream").count() == 3
    assert {(r.portal_source_id, r.portal_meeting_id, r.starts_at[:13]) for r in syncing.current_rows(spark, f"{tmp}/stream", "meetings").collect()} == {(1, 1, "2026-09-08T20"), (1, 3, "2026-09-10T19"), (1, 4, "2026-09-11T19"), (2, 1, "2026-09-08T19")}


# exports

ROWS = [(1, "a, \"b\"\nc", [1, 2], "2026-09-08T19:00:00"), (2, None, [], "2026-09-09T19:00:00"), (3, "ünï " * 40, None, "2026-09-10T19:00:00")]
SCHEMA = "id long, title string, xs array<long>, starts_at string"


def parts(path):
    return sorted(p for p in Path(path).iterdir())


@pytest.mark.parametrize("kind", exports.KINDS)
def test_exports_are_read_back(spark, tmp_path, kind):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("uid", F.concat(F.lit("m"), "id")).repartition(3, "id")
    exports.export(rows, f"{tmp_path}/x", kind)
    exports.export(rows.where("id = 1"), f"{tmp_path}/x", kind)  # beside the first
    text = []
    for p in parts(tmp_path / "x"):
        assert p.name.endswith(f".{kind}")
        text.append(zipfile.ZipFile(p).read("rows.jsonl").decode() if kind == "zip" else p.read_bytes().decode())
    if kind in ("jsonl", "zip"):
        got = [json.loads(x) for t in text for x in t.splitlines()]
        assert sorted((r["id"], r["title"], r["xs"], r["starts_at"]) for r in got) == sorted([*ROWS, ROWS[0]], key=lambda r: r[0])
    elif kind == "csv":
        got = [r for t in text for r in csv.DictReader(io.StringIO(t, newline=""))]
        assert sorted((int(r["id"]), r["title"] or None, json.loads(r["xs"] or "null")) for r in got) == sorted([r[:3] for r in [*ROWS, ROWS[0]]], key=lambda r: r[0])
    else:
        whole = "".join(text)
        assert whole.count("BEGIN:VEVENT") == 4 and whole.count("BEGIN:VCALENDAR") == len(text) and "SUMMARY:a\\, \"b\"\\nc\r\n" in whole
        assert all(len(x.encode()) <= 75 for x in whole.split("\r\n")) and ("ünï " * 40).strip() in whole.replace("\r\n ", "")


def test_a_failed_export_leaves_no_part(spark, tmp_path):
    good = spark.createDataFrame(ROWS, SCHEMA)
    exports.export(good, f"{tmp_path}/x", "jsonl")
    before = parts(tmp_path / "x")
    bad = good.repartition(3, "id").withColumn("title", F.when(F.col("id") == 2, F.raise_error(F.lit("broken row"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken row"):
        exports.export(bad, f"{tmp_path}/x", "jsonl")
    assert parts(tmp_path / "x") == before
    with pytest.raises(Exception, match="ics needs"):
        exports.export(good, f"{tmp_path}/x", "ics")
    exports.export(good.where("false"), f"{tmp_path}/none", "csv")
    assert not Path(tmp_path / "none").exists() or parts(tmp_path / "none") == []


# offices and links


def test_offices_before_names(spark):
    pages = [(1, "Mayor Susie Hidalgo-Fahring called it.\nMayor Pro Tem McCoy moved; council member Kalkhofer noted"), (1, "Council Member McCoy, Mayor  Jake O’Brien Smith"), (2, "Mayor\nMcCoy"), (2, "the mayor pro  tem Crist, said")]
    people = [(1, n) for n in ("Susie Hidalgo-Fahring", "Shiquita McCoy", "Diane Crist", "Kalkhofer", "Jake O’Brien", "")] + [(2, "Shiquita McCoy"), (2, "Diane Crist")]
    got = minutes.printed_offices(spark.createDataFrame(pages, "meeting_id long, text string"), spark.createDataFrame(people, "meeting_id long, name string"))
    assert {(r.meeting_id, r.name): r.office for r in got.collect()} == {
        (1, "Susie Hidalgo-Fahring"): "Mayor", (1, "Shiquita McCoy"): "Mayor Pro Tem", (1, "Diane Crist"): "Council Member", (1, "Kalkhofer"): "Council Member", (1, "Jake O’Brien"): "Mayor", (1, ""): "Council Member",
        (2, "Shiquita McCoy"): "Council Member", (2, "Diane Crist"): "Mayor Pro Tem",
    }


def test_videos_link_to_the_one_meeting(spark):
    rng = random.Random(2)
    kinds = {"Regular Session": "regular", "Study Session": "study", "Special Meeting": "special", "Meeting": None}
    days = [f"2026-09-{d:02d}" for d in range(1, 12)]
    meetings = [(k, rng.randrange(3), rng.choice(days) + "T19:00:00", "Board " + rng.choice(list(kinds))) for k in range(60)]
    videos = [(k, rng.choice([0, 1, 2, None]), "Board " + rng.choice(list(kinds)) + rng.choice(["", " September 4, 2026"]), rng.choice([*days, None, "20260905", "soon", "2026-09-03T02:00:00Z"])) for k in range(150)]
    kind = lambda t: kinds[t.removeprefix("Board ").split(" Sept")[0]]

    def link(body, title, published):
        if body is None:
            return None, "no body"
        text = "2026-09-04" if "September" in title else {"20260905": "2026-09-05", "soon": None}.get(published, published and published[:10])
        if text is None:
            return None, "no day"
        day = int(text[-2:])
        for reach in (0, 1):
            near = [m for m in meetings if m[1] == body and abs(int(m[2][8:10]) - day) <= reach]
            fits = [m for m in near if (kind(m[3]) or "regular") == (kind(title) or "regular")] or (near if kind(title) is None else [])
            if len(fits) == 1:
                return fits[0][0], "linked"
            if fits and reach == 0:
                return None, "several"
        return None, "several" if fits else "none"

    got = portal.link_videos(spark.createDataFrame(videos, "video_id long, body_id long, title string, published string"), spark.createDataFrame(meetings, "meeting_id long, body_id long, starts_at string, title string"))
    assert {r.video_id: (r.meeting_id, r.reason) for r in got.collect()} == {k: link(b, t, p) for k, b, t, p in videos}


def test_signals_of_a_listing(spark):
    rows = [("Council CANCELLED", ["Agenda"]), ("Council", ["Agenda", "Notice of Cancellation"]), ("Uncancelled talk", []), ("POSTPONED - Council", None), ("Continued Meeting", []), ("Study-Session", []), (None, None)]
    got = spark.createDataFrame(rows, "title string, templates array<string>").select(portal.cancelled_by(F.col("title"), F.col("templates")), portal.continued_by(F.col("title")), portal.meeting_type(F.col("title")))
    assert [tuple(r) for r in got.collect()] == [
        ("the title says cancelled", None, "regular"), ("a document is a Notice of Cancellation", None, "regular"), (None, None, "regular"), (None, "the title says postponed", "regular"), (None, "the title says continued", "regular"), (None, None, "study"), (None, None, "regular"),
    ]
