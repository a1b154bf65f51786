"""Printed motions, votes of items, spoken votes and speakers, on literal cases."""

from pyspark.sql import functions as F

from folioflow.operators import minutes, speakers

PAGES = [
    ["City Council September 8, 2026", "MOTION", "Smith moved, seconded by Jones, to approve O-", "2026-54 on second reading", "and its exhibits", "Approved: Smith, Jones and", "Lee", "Dissented: None", "Carried: 3 – 0", "Some talk.", "Page 1"],
    ["City Council September 8, 2026", "Lee moved, seconded by Smith, to table item 9B", "Approved:", "Lee; Smith", "Dissented:", "Jones", "Carried: 2-1", "Jones moved, seconded by , to continue", "MOTION WITHDRAWN", "Approved:", "0 – 0", "The end of 2026."],
    ["MOTION", "Lee moved, seconded by Jones, to deny R-2026-52", "Lee moved, seconded by Jones, to be text here", "Failed: 1 – 2", "Smith moved, seconded by Lee, to approve O-2026-54", "Failed: 1 - 2"],
]
ITEMS = [(1, 0, "9.A", "O-2026-54, parking"), (1, 1, "9.B", "the budget"), (1, 2, "9.C", "R-2026-52, water"), (1, 3, "10.", "no number")]


def pages(spark):
    rows = [(1, p, k, t) for p, lines in enumerate(PAGES, 1) for k, t in enumerate(lines)]
    split = []
    for m, p, k, t in rows:  # labels stand on lines of their own
        head, sep, tail = t.partition(": ")
        split += [(m, p, 10 * k, head + ":"), (m, p, 10 * k + 1, tail)] if sep and head.lower() in minutes.LABELS else [(m, p, 10 * k, t)]
    return spark.createDataFrame(split, "meeting_id long, page int, line_no int, text string")


def test_motions(spark):
    got = minutes.motions(pages(spark)).orderBy("ordinal").collect()
    assert [(r["mover"], r["seconder"], r["result"], r["yes"], r["no"]) for r in got] == [("Smith", "Jones", "passed", 3, 0), ("Lee", "Smith", "tabled", 2, 1), ("Jones", "", "withdrawn", None, None), ("Lee", "Jones", "failed", 1, 2), ("Smith", "Lee", "failed", 1, 2)]
    assert got[0]["text"] == "to approve O-2026-54 on second reading and its exhibits"
    assert got[3]["text"] == "to deny R-2026-52 Lee moved, seconded by Jones, to be text here"
    assert [(r["approved"], r["dissented"]) for r in got[:3]] == [(["Smith", "Jones", "Lee"], []), (["Lee", "Smith"], ["Jones"]), ([], [])]
    assert [r["page"] for r in got] == [1, 2, 2, 3, 3]


def test_votes_of_items(spark):
    items = spark.createDataFrame(ITEMS, "meeting_id long, item_no int, number string, title string")
    got = {r["item_no"]: (r["ordinal"], r["result"]) for r in minutes.item_votes(minutes.motions(pages(spark)), items).collect()}
    assert got == {0: (5, "failed"), 1: (2, "tabled"), 2: (4, "failed")}


def test_spoken_votes(spark):
    items = spark.createDataFrame(ITEMS, "meeting_id long, item_no int, number string, title string")
    said = ["can i have a motion on ordinance 2026-54", "so moved", "by whom", "all in favor", "that carries unanimously", "a motion for item 9B and then also item 9C", "well", "yes", "that fails", "motion on item 10", "okay", "fine", "thanks", "motion again on 2026-54", "good", "sure", "denied"]
    lines = spark.createDataFrame([(1, k, 1000 * k, t) for k, t in enumerate(said)], "meeting_id long, line_id long, start_ms long, text string")
    got = {r["item_no"]: (r["start_ms"], r["result"]) for r in minutes.spoken_votes(lines, items).collect()}
    assert got == {0: (0, "passed"), 3: (9000, "failed")}


def test_namings(spark):
    text = "Thank you, Council Member McCoy. The motion was made by Council member Popkin, seconded by council member Koffer. The mayor is here. Mayor Port McCoy. Council Member Marcen, go ahead"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(speakers.namings("t")).alias("n")).select("n.kind", "n.spoken", "n.role").collect()
    assert [tuple(r) for r in got] == [("member", "Popkin", "mover"), ("member", "Koffer", "seconder"), ("mayor_pro_tem", "McCoy", None), ("member", "Marcen", None)]


def test_labels_of_runs(spark):
    said = [">> good evening. Council Member Smyth", ">> thank you all so much", "Mayor", ">> yes. Mayor Pro Tem Jonas", ">> fine. Mayor Lee", ">> last. Council Member Smyth"]
    lines = spark.createDataFrame([(1, k, 1000 * k, t) for k, t in enumerate(said)], "meeting_id long, line_id long, start_ms long, text string")
    officials = spark.createDataFrame([(1, 10, "Ann Smith"), (1, 11, "Bo Jones"), (1, 12, "Cy Vega")], "meeting_id long, person_id long, name string")
    holders = spark.createDataFrame([(1, "mayor", 12), (1, "mayor_pro_tem", 11)], "meeting_id long, kind string, person_id long")
    got = speakers.label_runs(lines, officials, holders).orderBy("run").collect()
    assert [(r["start_ms"], r["kind"], r["person_id"], r["method"]) for r in got] == [(1000, "member", 10, "sound"), (3000, "mayor", 12, "seat"), (4000, "mayor_pro_tem", 11, "seat"), (5000, "mayor", None, "unidentified")]


def test_cross_check(spark):
    said = [">> moved by Council Member Smyth and seconded by Council Member Jonas", ">> later. seconded by Council Member Smyth"]
    lines = spark.createDataFrame([(1, k, 1000 * k, t) for k, t in enumerate(said)], "meeting_id long, line_id long, start_ms long, text string")
    officials = spark.createDataFrame([(1, 10, "Ann Smith"), (1, 11, "Bo Jones")], "meeting_id long, person_id long, name string")
    printed = spark.createDataFrame([(1, 1, 0, 1000, "Smith", "Vega"), (1, 2, 1000, 2000, "Smith", "Smith")], "meeting_id long, ordinal int, start_ms long, end_ms long, mover string, seconder string")
    got = sorted((r["ordinal"], r["role"], r["agrees"]) for r in speakers.cross_check(lines, printed, officials).collect())
    assert got == [(1, "mover", True), (1, "seconder", False), (2, "seconder", True)]


def test_seat_intervals(spark):
    schema = "person_id long, body_id long, title string, start_date string, end_date string"
    seats = spark.createDataFrame([(1, 1, "Mayor", "2025-05-01", None), (2, 1, "Member", None, None), (3, 1, "Member", "2020-01-01", "2021-01-01")], schema)
    seen = spark.createDataFrame([(1, 1, "Mayor", "2024-01-01"), (1, 1, "Mayor", "2026-01-01"), (2, 1, "Member", "2026-01-01"), (3, 1, "Member", "2026-02-01")], "person_id long, body_id long, title string, on string")
    got = sorted(((r["person_id"], r["title"], r["start_date"], r["end_date"]) for r in speakers.seat_intervals(seats, seen).collect()), key=str)
    assert got == [(1, "Mayor", "2024-01-01", None), (2, "Member", "2026-01-01", None), (3, "Member", "2020-01-01", "2021-01-01"), (3, "Member", "2026-02-01", None)]
