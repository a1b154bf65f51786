"""Record and item numbers, and the alignment of an agenda with a transcript, on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import references
from folioflow.operators import alignment, temporal

ITEMS = [
    (1, 0, "1.", "Call to Order", 30), (1, 1, "8.", "Public Invited to be Heard - first call (3 minutes)", 160), (1, 2, "9.", "Consent Agenda", 260),
    (1, 3, "9.A", "O-2026-54, An Ordinance on Parking Permits", 300), (1, 4, "9.B", "R-2026-52 Budget Amendment", 585021),
    (1, 5, "10.", "Reports", 460), (1, 6, "10.A.1", "Water Storage Tank Replacement", None), (1, 7, "12.", "Adjournment Motion", 760),
]
LINES = [
    (1, 1, 0, 5000, "good evening everyone"), (1, 2, 60_000, 64_000, "we will move on to public invited"), (1, 3, 64_000, 68_000, "to be heard the first call"),
    (1, 4, 160_000, 164_000, "that is item 9 consent agenda"), (1, 5, 200_000, 205_000, "ordinance um 202654. on second reading"), (1, 6, 250_000, 255_000, "then resolution 2026-54 by mistake"),
    (1, 7, 300_000, 305_000, "item A1 please"), (1, 8, 358_000, 363_000, "now the reports of staff"), (1, 9, 655_000, 661_000, "we need an adjournment vote"), (1, 10, 700_000, 705_000, "item nine again"),
]
EXPECTED = {
    "1.": ("none", None, "shifted time outside the video"), "8.": ("spoken", 60_000, None), "9.": ("spoken", 160_000, None), "9.A": ("spoken", 200_000, None),
    "9.B": ("none", None, "published time outside the video"), "10.": ("none", None, "against the spoken order"), "10.A.1": ("spoken", 300_000, None), "12.": ("published", 660_000, None),
}


def frames(spark, items, lines, duration):
    return (
        spark.createDataFrame(items, "meeting_id long, item_no int, number string, title string, seconds long"),
        spark.createDataFrame(lines, "meeting_id long, line_id long, start_ms long, end_ms long, text string"),
        spark.createDataFrame([(1, duration)], "meeting_id long, duration_ms long"),
    )


@pytest.mark.parametrize(
    "text, want",
    [
        ("O-2026-54", [("ordinance", 2026, 54, "O-2026-54")]),
        ("with item A1, ordinance 2026-54,", [("ordinance", 2026, 54, "O-2026-54")]),
        ("ordinance um 20 26-58", [("ordinance", 2026, 58, "O-2026-58")]),
        ("resolution R202652", [("resolution", 2026, 52, "R-2026-52")]),
        ("2026-56, then 202657.", [(None, 2026, 56, "2026-56"), (None, 2026, 57, "2026-57")]),
        ("the resolution and the ordinance 2026-5", [("ordinance", 2026, 5, "O-2026-05")]),
        ("an ordinance that has far too many words 2026-123", [(None, 2026, 123, "2026-123")]),
        ("September 8th, 2026 and the 2027 budget", []),
        (None, []),
    ],
)
def test_identifiers(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(references.identifiers("t")).alias("i")).select("i.kind", "i.year", "i.number", references.canonical(F.col("i")).alias("c"))
    assert [tuple(r) for r in found.collect()] == want


@pytest.mark.parametrize(
    "text, want",
    [("agenda item 11", [["11"]]), ("Item A1, please", [["A", "1"]]), ("items 9C and, then, item twelve.", [["9", "C"], ["12"]]), ("item 9 items removed from consent", [["9"]]), ("three minutes an item of note", []), ("item 10 A 1 2", [["10", "A", "1"]])],
)
def test_item_references(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(references.item_references("t").alias("r")).first()["r"]
    assert [list(r["parts"]) for r in got] == want


def test_alignment(spark):
    got = {r["number"]: r for r in alignment.align(*frames(spark, ITEMS, LINES, 800_000)).collect()}
    assert {n: (r["method"], r["start_ms"], r["reason"]) for n, r in got.items()} == EXPECTED
    assert {n: r["end_ms"] for n, r in got.items() if r["start_ms"] is not None} == {"8.": 160_000, "9.": 200_000, "9.A": 300_000, "10.A.1": 660_000, "12.": 800_000}
    assert got["12."]["offset_s"] == 100 and got["12."]["said"] == "adjournment" and got["8."]["said"].startswith("move on to public invited")


def test_two_anchors_give_no_offset(spark):
    items = [x for x in ITEMS if x[2] != "9.A"]
    got = {r["number"]: (r["method"], r["reason"]) for r in alignment.align(*frames(spark, items, LINES, 800_000)).collect()}
    assert got["12."] == ("none", "no agreed offset") and got["9."] == ("spoken", None)


def test_no_lines_and_no_length(spark):
    got = alignment.align(*frames(spark, ITEMS, [], None)).collect()
    assert len(got) == len(ITEMS) and {r["method"] for r in got} == {"none"}


def chain(rows):
    """All chains, by definition."""
    best = ((0, 0), [])
    for mask in range(1 << len(rows)):
        own = [rows[i] for i in range(len(rows)) if mask >> i & 1]
        if all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(own, own[1:])):
            best = max(best, ((len(own), -sum(t for _, t in own)), own), key=lambda x: x[0])
    return best[0]


def test_chains_match_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        rows = sorted({(rng.randrange(6), rng.randrange(9)) for _ in range(rng.randrange(11))})
        got = [(x["item"], x["time"]) for x in temporal._chain([{"item": a, "time": b} for a, b in rows])]
        assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(got, got[1:])) and set(got) <= set(rows)
        assert (len(got), -sum(t for _, t in got)) == chain(rows)


def test_latest_range_with_ties_nested_ranges_and_equal_points(spark):
    ranges = spark.createDataFrame([("a", 0, 10, 9), ("a", 0, 10, 3), ("a", 2, 4, 5), ("a", 6, 6, 7), ("b", 0, 1, 1)], "k string, s long, e long, id long")
    for order in ("id", "-id"):
        points = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5), ("a", 5), ("a", 6), ("a", 10), ("b", 4), ("c", 0)], "k string, t long")
        got = temporal.latest_range(points, ranges.orderBy(F.expr(order)), "k", "t", "s", "e", "id").collect()
        assert sorted((r["k"], r["t"], r["range_id"] or 0) for r in got) == [("a", 1, 3), ("a", 3, 5), ("a", 5, 3), ("a", 5, 3), ("a", 6, 3), ("a", 10, 0), ("b", 4, 0), ("c", 0, 0)]
