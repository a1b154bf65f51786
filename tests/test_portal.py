"""Titles and bodies, consent motions, and captions that change, on literal cases."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import captures, portal

TITLES = {
    "City Council Regular Session": "City Council", "City Council Pre-Session": "City Council", "Golf Course Advisory Board - CANCELLED": "Golf Course Advisory Board",
    "CANCELLED - Parks and Recreation Advisory Board": "Parks and Recreation Advisory Board", "SPECIAL WATER BOARD MEETING": "WATER BOARD", "Water Board POSTPONED to March 23": "Water Board",
    "Local Licensing Authority- CONTINUED TO DATE TBD": "Local Licensing Authority", "Transportation Advisory Board May Meeting": "Transportation Advisory Board", "Urban Renewal Authority (URA)": "Urban Renewal Authority",
    "Housing Board (XYZ)": "Housing Board (XYZ)", "VIRTUAL - Coffee Notice of Neighborhood Meeting": "VIRTUAL", "CANCELLED": "CANCELLED", "Senior Board 5/5/26": "Senior Board", "Library Board Meeting Oct. 19, 2026": "Library Board", "Sessionalia Club": "Sessionalia Club", "": "",
}


@pytest.mark.parametrize("title", TITLES)
def test_body_names(title):
    assert portal._body_name(title) == TITLES[title]


def test_titles_find_their_bodies(spark):
    bodies = spark.createDataFrame([(1, 10, "City Council"), (1, 11, "Planning and Zoning Commission"), (1, 12, "Historic Preservation Commission"), (1, 13, "Water Board"), (1, 14, "Water Commission"), (2, 20, "City Council")], "area_id long, body_id long, name string")
    asked = ["City Council - Study Session", "Planning & Zoning Commission", "Annual Retreat - Historic Preservation Commission", "Longmont Planning & Zoning", "Water", "Town Hall: Airport", "", "CANCELLED"]
    titles = spark.createDataFrame([(k, 1, "Longmont", 10, t) for k, t in enumerate(asked)], "title_id long, area_id long, city string, own_body_id long, title string")
    got = {r["title_id"]: r["body_id"] for r in portal.resolve_bodies(titles, bodies).collect()}
    assert got == {0: 10, 1: 11, 2: 12, 3: 11, 4: None, 5: None, 6: 10, 7: None}


@pytest.mark.parametrize(
    "text, want",
    [("the consent agenda", (True, [])), ("except items 9B and 9E", (True, ["9b", "9e"])), ("minus items B, E, B, and E", (True, ["9b", "9e"])), ("excluding nine A & 9.C", (True, ["9a", "9c"])), ("with the exception of that thing", (False, []))],
)
def test_exceptions(spark, text, want):
    x = spark.createDataFrame([(text, "9.")], "t string, s string").select(portal.excepted_items(portal.exception_clause(F.col("t")), F.col("s")).alias("x")).first()["x"]
    assert (x["readable"], list(x["keys"])) == want


def test_consent_motions(spark):
    items = spark.createDataFrame([(1, 0, "9.", "Consent Agenda"), (1, 1, "9.A", "a"), (1, 2, "9.B", "b"), (1, 3, "90.", "c"), (1, 4, "1.", "d")], "meeting_id long, item_no int, number string, title string")
    motions = spark.createDataFrame([(1, 1, "to approve the consent agenda except item 9B"), (1, 2, "to approve the Consent Agenda"), (1, 3, "to adjourn"), (1, 4, "the consent agenda excluding whatever")], "meeting_id long, ordinal int, text string")
    got = sorted(tuple(r)[1:] for r in portal.consent_coverage(motions, items).collect())
    assert got == [(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True)]


def test_captions_that_change(spark):
    stored = spark.createDataFrame([(1, "a")], "video_id long, sha256 string")
    seen = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "b", 7), (2, "c", 8)], "video_id long, sha256 string, seen long")
    fresh = captures.new_versions(seen, stored)
    assert sorted(tuple(r) for r in fresh.collect()) == [(1, "b", 6), (2, "c", 8)]
    rows = spark.createDataFrame([("motion", 1, 1, "a"), ("motion", 2, 1, "b"), ("label", 3, 1, "a")], "kind string, row_id long, video_id long, sha256 string")
    marks = spark.createDataFrame([("label", 3, "captions changed: b")], "kind string, row_id long, reason string")
    assert [tuple(r) for r in captures.stale_marks(fresh, rows, marks).collect()] == [("motion", 1, "captions changed: b")]


def test_caption_sources(spark):
    videos = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "video_id long, meeting_id long")
    transcripts = spark.createDataFrame([(2, 20, 1), (2, 21, 2)], "video_id long, transcript_id long, at long")
    got = sorted(tuple(r) for r in captures.caption_sources(videos, transcripts).collect())
    assert got == [(1, 21, 2, None), (2, 21, 2, None), (3, None, None, "no video of the meeting has captions"), (4, None, None, "no meeting is known")]


def test_recheck(spark):
    hour = 3_600_000_000
    caps = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 0, "a"), (3, 0, 0, "a")], "subject long, captured long, ended long, sha256 string")
    seen = spark.createDataFrame([(1, hour, "a"), (1, 2 * hour, "a"), (2, hour, "b"), (2, 2 * hour, "b")], "subject long, checked long, sha256 string")
    got = {r["subject"]: (r["n_checks"], r["n_revisions"], r["reason"]) for r in captures.recheck(caps, seen, F.lit(3 * hour)).collect()}
    assert got == {1: (2, 0, "unchanged"), 2: (2, 1, "provisional"), 3: (0, 0, "provisional")}
