"""Operators that SQL can't express, against brute force."""

import itertools
import random
import subprocess
import sys
from pathlib import Path

from folioflow.functions import names
from folioflow.operators import temporal

ROOT = Path(__file__).resolve().parent.parent


def test_longest_chain_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(6), rng.randrange(8)) for g in range(40) for _ in range(rng.randrange(1, 8))]
    got = {}
    for r in temporal.last_in_order(spark.createDataFrame(rows, "group long, item long, time long")).collect():
        got.setdefault(r["group"], []).append((r["item"], r["time"]))
    for g in {r[0] for r in rows}:
        own = sorted((i, t) for x, i, t in rows if x == g)
        fits = [c for n in range(1, len(own) + 1) for c in itertools.combinations(own, n) if all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(c, c[1:]))]
        want = max((len(c), -sum(t for _, t in c)) for c in fits)
        assert (len(got[g]), -sum(t for _, t in got[g])) == want
        assert tuple(got[g]) in fits


def test_longest_chain_of_no_rows(spark):
    assert temporal.last_in_order(spark.createDataFrame([], "group long, item long, time long")).count() == 0


def test_spoken_name_finds_its_official(spark):
    spoken = spark.createDataFrame([(1, 1, "Jon Smyth"), (1, 2, "Zzyzx Quorl"), (2, 3, "Jon Smyth")], "body_id long, spoken_id long, spoken string")
    known = spark.createDataFrame([(1, 10, "John Smith"), (1, 11, "Mary Baker")], "body_id long, person_id long, name string")
    got = {r["spoken_id"]: r for r in names.match_names(spoken, known).collect()}
    assert got[1]["person_id"] == 10 and got[1]["passed"]
    assert not got[2]["passed"]
    assert got[3]["person_id"] is None and got[3]["score"] == 0  # no official of that body


def test_entry_imports_without_a_session_and_without_the_training_part():
    code = "import sys; sys.modules['folioflow.llm'] = None\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
