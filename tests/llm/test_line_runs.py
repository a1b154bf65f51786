"""Repeated runs of lines, in planted passages and against brute force."""

import random

import pytest

from folioflow.llm import line_dedup


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("lines, n", [(2, 28), (3, 20), (4, 15), (5, 12), (6, 10), (10, 6)])
def test_a_wrapped_passage_goes_whole_from_all_documents_but_one(spark, lines, n):
    rng = random.Random(lines)
    rows, own = [], {}
    for family in range(20):
        passage = [words(rng, n) for _ in range(lines)]
        for copy in range(3):
            i = 3 * family + copy
            own[i] = [words(rng, rng.randrange(1, 12)) for _ in range(6)]
            rows.append((i, "\n".join([*own[i][:3], *passage, *own[i][3:]])))
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert texts[i] == (text if i % 3 == 0 else "\n".join(own[i]))


def removed(texts):
    """By all runs of lines: those that equal an earlier, not overlapping one lose their lines."""
    lines, first, out = [t.split("\n") for t in texts], {}, []
    count = lambda run: sum(x.count(" ") + 1 for x in run)
    for d, own in enumerate(lines):
        gone = set()
        for k in range(len(own)):
            for e in range(k + 1, len(own) + 1):
                run = tuple(own[k:e])
                if count(run) >= (line_dedup.LEAST_WORDS if e > k + 1 else line_dedup.PASSAGE_WORDS):
                    at = first.setdefault(run, (d, k))
                    if at[0] != d or k >= at[1] + len(run):
                        gone |= set(range(k, e))
        out.append("\n".join(x for i, x in enumerate(own) if i not in gone))
    return out


def test_runs_match_brute_force(spark):
    rng = random.Random(21)
    pool = [words(rng, n) for n in (1, 1, 1, 2, 2, 3, 4, 5, 6, 9, 12, 29, 30, 45)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "text", "n_chunks", "n_removed").collect()}
    assert [got[i]["text"] for i in range(60)] == removed(texts)
    assert all((r["n_removed"] > 0) == (r["text"] != texts[i]) and r["n_removed"] <= r["n_chunks"] for i, r in got.items())
