"""Sentences, what they claim, and their checks, on literal cases."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import grounding


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("On Sept. 8 it met. The vote was 7-0.", ["On Sept. 8 it met.", "The vote was 7-0."]),
        ("Dr. Smith spoke. then left.  Mr. Jones vs. the town.", ["Dr. Smith spoke. then left.", "Mr. Jones vs. the town."]),
        ("no end mark", ["no end mark"]),
        ("  ", []),
        ("In the U.S. Senate. 5 stayed.", ["In the U.S. Senate. 5 stayed."]),
    ],
)
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(grounding.sentences(F.col("t"))).first()[0] == want


def test_what_a_sentence_claims(spark):
    text = "The “tall  tank” cost 1,200.50 for twenty years, 7 – 0 and O-2026-58. [E3] [E1] [E3]"
    row = spark.createDataFrame([(text,)], "t string").select(grounding.handles(F.col("t")), grounding.quotes(F.col("t")), grounding.tallies(F.col("t")), grounding.numbers(F.col("t")), grounding.numbers(F.col("t"), True)).first()
    assert row[0] == ["[E3]", "[E1]"] and row[1] == ["tall tank"] and row[2] == ["7-0"]
    assert row[3] == sorted(["1200.50", "20", "7", "0", "2026", "58"]) and row[4] == sorted(["1200.50", "20", "2026", "58"])


CASES = [
    ("Not found.", "not-found"), ("The tank leaks.", "no-handle"), ("The tank leaks [E9].", "unknown-handle"), ("It is \"very old\" [E1].", "quote-not-verbatim"),
    ("It is “quite old” [E1].", "ok"), ("It passed 7-0 [E1].", "tally-without-a-stored-vote"), ("It passed 6-1 [E2].", "tally-is-not-the-stored-vote"), ("It passed 7-0 [E2].", "ok"),
    ("It is 45 years old [E1].", "number-not-in-evidence"), ("It is forty years old [E1].", "ok"), ("McCoy moved it [E2].", "name-not-in-evidence"), ("Smith moved it [E2].", "ok"),
]


def test_checks_and_grounding(spark):
    answers = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)] + [(99, "Alone [E1].")], "answer_id long, text string")
    spans = [("[E1]", "video", "the tank is quite  old, 40 years", None, None), ("[E2]", "vote", "motion by Smith", 7, 0)]
    evidence = spark.createDataFrame([(k, *s) for k in range(len(CASES)) for s in spans], "answer_id long, handle string, kind string, text string, yes int, no int")
    roster = spark.createDataFrame([("Smith",), ("McCoy",)], "surname string")
    checked = grounding.check_sentences(answers, evidence, roster)
    got = {r["answer_id"]: r["code"] for r in checked.collect()}
    assert [got[k] for k in range(len(CASES))] == [c for _, c in CASES] and got[99] == "no-evidence"
    repaired = spark.createDataFrame([(1, 0, "The tank leaks [E1]."), (2, 0, "The tank leaks 5 times [E1]."), (3, 0, "It is \"very old\" [E2].")], "answer_id long, sentence_no int, sentence string")
    found = {r["answer_id"]: (r["text"], r["kept"], r["repaired"], r["removed"]) for r in grounding.ground(checked, repaired, evidence, roster).collect()}
    assert found[0] == ("Not found.", 1, 0, 0) and found[1] == ("The tank leaks [E1].", 0, 1, 0) and found[2] == found[3] == ("", 0, 0, 1)


def test_evidence_pack(spark):
    rows = lambda kind, n: spark.createDataFrame([(1, k, 10 * kind + k, f"t{k}") for k in range(n)], "meeting_id long, place int, source_id long, text string")
    got = grounding.evidence_pack(rows(1, 2), rows(2, 2), rows(3, 3), 5).orderBy("handle").collect()
    assert [(r["handle"], r["kind"], r["source_id"], r["dropped"]) for r in got] == [("[E1]", "video", 10, 2), ("[E2]", "video", 11, 2), ("[E3]", "record", 20, 2), ("[E4]", "record", 21, 2), ("[E5]", "vote", 30, 2)]
