"""The kept full-text index against the search that reads texts, and how much of it a search reads."""

import random

import numpy as np
import pytest
from test_search_and_names import best_windows, tokens

from folioflow.functions.text import search_terms
from folioflow.operators import search, text_index
from pyspark.sql import functions as F

WORDS = "the of water tank budget and city park rare ünï".split()


def texts(rng, n, lengths=(1, 60)):
    weights = [30, 20, 8, 8, 4, 20, 5, 5, 0.4, 2]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.randrange(*lengths)))) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = texts(random.Random(2), 900) + [(900, None), (901, ""), (902, "___ --"), (903, "rare " * 300), (904, "of the " * 200), (905, "RARE Water_tank")] + [(906 + i, "the same text of the city") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("lang", F.col("doc_id") % 3)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    return docs, text_index.build(docs, ["doc_id"], str(tmp_path_factory.mktemp("index") / "docs"), ["lang"], partitions=5)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("q, k", [("water tank", 10), ("the of", 1), ("the of", 2000), ("rare", 10), ("rare water tank of", 10), ("the the of", 10), ("none here", 10), ("", 10), ("ünï city", 10), ("THE same", 50)])
def test_best_rows_are_those_of_the_whole_scan(corpus, q, k):
    docs, index = corpus
    terms = search.query_terms(q)
    want = rows(search.bm25(docs.select("doc_id", "text"), ["doc_id"], terms, k)) if terms else []
    assert rows(index.top(terms, k).select("doc_id", "score")) == want


@pytest.mark.parametrize("q", ["water tank", "the of", "rare", "none here", "", "city city", "of the of"])
def test_matches_are_those_of_the_whole_scan(corpus, q):
    docs, index = corpus
    terms = search.query_terms(q)
    words = search_terms(F.col("text"))
    assert sorted(rows(index.matching(terms).select("doc_id"))) == sorted(rows(docs.where(search.matches_all(words, terms)).select("doc_id")))
    assert sorted(rows(index.phrase(terms).select("doc_id"))) == sorted(rows(docs.where(search.matches_phrase(words, terms)).select("doc_id")))


def test_filters_come_before_the_cut(corpus):
    docs, index = corpus
    where = docs.where("lang = 1")
    want = rows(search.bm25(docs.select("doc_id", "text", "lang"), ["doc_id"], ["water", "tank"], 12, F.col("lang") == 1))
    assert rows(index.top(["water", "tank"], 12, where).select("doc_id", "score")) == want
    assert index.top(["water"], 0).count() == index.top([], 5).count() == 0


def test_no_text_is_read_and_filters_reach_the_scan(corpus):
    _, index = corpus
    for found in (index.matching(["water", "tank"]), index.phrase(["of", "the"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(term" in plan and "PartitionFilters: [bucket" in plan and "staged" not in plan and "text#" not in plan


def test_ten_times_the_rows_read_no_more_blocks(spark, tmp_path):
    """Long texts can't reach the scores of the short ones, so their blocks are passed over."""
    rng = random.Random(5)
    short = [(i, f"water tank {rng.choice(WORDS)}") for i in range(300)]
    read = []
    for n in (4_000, 40_000):
        long_ = [(1000 + i, "water tank " + " ".join(rng.choices(WORDS[4:8], k=60))) for i in range(n)]
        docs = spark.createDataFrame(short + long_, "doc_id long, text string").coalesce(1)
        index = text_index.build(docs, ["doc_id"], str(tmp_path / str(n)), partitions=4)
        assert rows(index.top(["water", "tank"], 10)) == rows(search.bm25(docs, ["doc_id"], ["water", "tank"], 10))
        read.append(index.blocks_read)
        assert index._postings.count() > n // text_index.BLOCK
    assert read[1] <= read[0] < 60


def test_line_search_by_index_matches_brute_force(spark, tmp_path):
    rng = random.Random(4)
    lines = [(t, i, 1000 * (i // 2), " ".join(rng.choice(WORDS[:8]) for _ in range(rng.randrange(1, 6)))) for t in range(6) for i in range(12)]
    frame = spark.createDataFrame(lines, "transcript_id long, id long, start_ms long, text string")
    index = text_index.index_lines(frame, str(tmp_path / "lines"))
    for q in ("water tank", "of the", "budget", "none here", ""):
        got = [(r["transcript_id"], r["last_id"], r["span"]) for r in text_index.search_lines(index, q, 8).collect()]
        assert got == (best_windows(lines, q, 8) if tokens(q) else []), q
    some = spark.createDataFrame([(1,), (4,)], "transcript_id long")
    assert rows(text_index.search_lines(index, "of the", 5, some)) == rows(search.search_lines(frame, "of the", 5, some))


def test_empty_corpus(spark, tmp_path):
    index = text_index.build(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], str(tmp_path / "none"))
    assert index.top(["a"], 5).count() == index.matching(["a"]).count() == index.phrase(["a", "b"]).count() == 0


def test_numbers_are_packed_without_loss():
    rng = random.Random(1)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62] + [rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(500)])
    data, starts = text_index.packed(values)
    assert (text_index.unpacked(data.tobytes()) == values).all() and starts[-1] == len(data)
    assert len(text_index.unpacked(b"")) == 0
