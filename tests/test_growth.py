"""Steps that have to grow with their input only: what is broadcast, sent to the driver, or met pair by pair."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.functions import names, times
from folioflow.operators import closure, minutes, portal, text_index
from folioflow.sources import answers
from folioflow.sources.cuts import Cuts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_consent_items_are_not_broadcast(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "meetings"))
    meetings = spark.read.parquet(str(tmp_path / "meetings"))
    motions = meetings.select(F.col("id").alias("meeting_id"), F.lit(1).alias("ordinal"), F.lit("the consent agenda except B").alias("text"))
    items = meetings.select(F.col("id").alias("meeting_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("item_no")).withColumn("number", F.concat(F.lit("9."), F.char(64 + F.col("item_no")))).withColumn("number", F.when(F.col("item_no") == 0, "9.").otherwise(F.col("number"))).withColumn("title", F.when(F.col("item_no") == 0, "Consent Agenda").otherwise("x"))
    got = portal.consent_coverage(motions, items)
    assert "Broadcast" not in plan(got) and plan(got).count("ArrowEvalPython") == 1
    assert got.groupBy("covered").count().orderBy("covered").collect() == [(False, 1000), (True, 5000)]


def test_equal_names_of_a_body_meet_once(spark):
    spoken = spark.range(3000).select(F.lit(1).alias("body_id"), F.col("id").alias("spoken_id"), F.lit("Jahn Smyth").alias("spoken"))
    officials = spark.range(3000).select(F.lit(1).alias("body_id"), (F.col("id") + 7).alias("person_id"), F.when(F.col("id") % 2 == 0, "John Smith").otherwise("Ann Baker").alias("name"))
    assert names._keys_of(names._sounding(officials, "person_id", names.known_variants(F.col("name"))), "known", "kk").count() == 4
    got = names.match_names(spoken, officials)
    assert got.count() == 3000 and got.select("person_id", "passed").distinct().collect() == [(7, False)]
    assert got.where("score <> runner_up").isEmpty()


def test_small_answers_share_partitions(spark, tmp_path):
    for k in range(600):
        site = tmp_path / f"site={k % 2}"
        site.mkdir(exist_ok=True)
        (site / f"{k:04d}.json").write_text(f'[{{"id": {k}, "dateTime": "2026-01-02T03:04:05"}}]')
    got = answers.answers(spark, str(tmp_path), "health")
    assert got.rdd.getNumPartitions() == 60  # 600 files by ten
    assert got.where("ok and meetings_found = 1").count() == 600
    assert answers.answers(spark, str(tmp_path)).where("site = '1'").count() == 300
    assert [(r["site"], r["n"], r["top"]) for r in answers.answers(spark, str(tmp_path)).groupBy("site").agg(F.countDistinct("list_no").alias("n"), F.max("list_no").alias("top")).orderBy("site").collect()] == [("0", 300, 299), ("1", 300, 299)]


def test_a_duration_tries_its_pattern_once(spark):
    x = spark.createDataFrame([("P1DT2H3M4S", "1:02:03.004"), ("P", "=1,2,3,4"), ("PT5S\n", "02:03,004\r\n"), (None, "1:2:3.004")], "iso string, at string")
    got = x.select(times.iso_seconds(F.col("iso")).alias("s"), times.clock_ms(F.col("at")).alias("ms"))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(") == 2 and "regexp_extract(" not in text and "RLIKE" not in text
    assert [tuple(r) for r in got.collect()] == [(93784, 3723004), (None, None), (5, 123004), (None, None)]


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    plans, write = [], Cuts.write
    monkeypatch.setattr(Cuts, "write", lambda self, name, df: plans.append(plan(df)) or write(self, name, df))
    got = closure.components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where("component = 0").count() == 201
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_lines_of_minutes_are_sorted_once(spark):
    pages = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(["MOTION", "Ann moved, seconded by Bo, to adjourn", "Carried: 7 - 0"])], "meeting_id long, page int, line_no int, text string")
    got = minutes.motions(pages)
    window_sorts = [x for x in plan(got).splitlines() if "Sort [meeting_id" in x and ("pos" in x or "line_no" in x)]
    assert len(window_sorts) == 1
    assert [(r["mover"], r["result"], r["yes"]) for r in got.collect()] == [("Ann", "passed", 7)]


def test_spoken_lines_without_a_word_of_motions_go_no_further(spark, monkeypatch):
    plans, write = [], Cuts.write
    monkeypatch.setattr(Cuts, "write", lambda self, name, df: plans.append(plan(df)) or write(self, name, df))
    lines = spark.createDataFrame([(1, k, k * 1000, "a motion on item 9A" if k == 0 else "that carries" if k == 26 else "yes") for k in range(40)], "meeting_id long, line_id long, start_ms long, text string")
    items = spark.createDataFrame([(1, 0, "9.A", "x")], "meeting_id long, item_no int, number string, title string")
    assert [(r["item_no"], r["result"], r["motion"]) for r in minutes.spoken_votes(lines, items).collect()] == [(0, "passed", "a motion on item 9A yes yes")]
    assert len(plans) == 1 and "collect_list" not in plans[0]


def test_a_text_is_told_apart_where_it_is_read(spark, monkeypatch):
    rows = [(1, ["b", "a", "b"]), (2, None), (3, []), (4, ["a"]), (None, ["c", "c"])]
    want = {(1, 3, "b", (0, 2)), (1, 3, "a", (1,)), (4, 1, "a", (0,)), (None, 2, "c", (0, 1))}
    batch = pa.table({"did": pa.array([r[0] for r in rows], pa.int64()), "tokens": pa.array([r[1] for r in rows], pa.list_(pa.string()))}).to_batches()[0]
    for held in (1, 3, 1 << 20):
        monkeypatch.setattr(text_index, "HELD_TOKENS", held)
        got = [(x["did"], x["size"], x["term"], tuple(x["places"])) for b in text_index._held([batch]) for x in b.to_pylist()]
        assert len(got) == 4 and set(got) == want
