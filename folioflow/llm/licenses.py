"""Operator 8: licence scan by a positional index of rare words. DataFrame functions only."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table
from folioflow.llm.licence_texts import LICENCES

#: Phrases whose places are counted, and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The rarest words of a licence that a file is looked up by, and the share of their weight that must be met.
RAREST = 8
LEAST_SCORE = 0.5
#: Words that a key phrase may start before or after the template's place.
SLACK = 3

#: Licence notices: label, wording in words, and the phrase that must stand there for the label to hold.
TEMPLATES = [(label, " ".join(re.findall("[0-9a-z]+", text.lower())), phrase) for label, text, phrase in LICENCES]
KEYS = list(dict.fromkeys([*PHRASES, *(k for _, _, k in TEMPLATES)]))
VOCABULARY = sorted({w for t in [*KEYS, *(t for _, t, _ in TEMPLATES)] for w in t.split()})
#: Words of a bin in which the places of templates and key phrases meet.
BIN = 2 * SLACK + max(len(t.split()) for _, t, _ in TEMPLATES)
#: The only character beyond ASCII whose lower case is an ASCII letter; another letter takes its place.
KELVIN, OTHER = "K", "å"


def words(text: Column) -> Column:
    """Words of digits, ASCII letters in lower case, and all characters beyond ASCII (whose case is of no account here)."""
    low = F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER)))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    One pass counts words and notes each file's licence words; over all documents that gives their IDF. A file is looked up
    by its own highest-IDF words: for each licence, the RAREST of its words that the file has (so a licence in a file with
    others loses nothing). Where these can reach LEAST_SCORE of the weight, their places in the file meet the licence's
    postings, and equal (place - offset) add up. A label holds if a place gets LEAST_SCORE and the licence's key phrase
    stands whole within its span. Phrases are looked up by all their words. score: 1 with a phrase of PHRASES, else
    the best score of a label that holds, else 0. Overlapping places all count.

    Null text is empty; rows without doc_id are scanned like others; repeated rows each give the same row; an empty table
    gives an empty result; extra columns are ignored; texts of any length are scanned whole."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licenses")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_key"), "text")
    split = rows.withColumn("_words", words(F.col("text")))
    counted = scratch.write("counted", split.select("doc_id", "_id", "_key", F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", _array(VOCABULARY)).alias("_found")))
    in_docs = {r["w"]: r["n"] for r in counted.select(F.explode("_found").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    n_docs = counted.count()
    weight = {w: math.log1p((1 + n_docs) / (1 + in_docs.get(w, 0))) for w in VOCABULARY}

    wanted = F.filter(F.array(*_lookups(weight)), lambda x: x["rare"].isNotNull())
    asked = scratch.write("asked", counted.select("_id", "_key", F.explode(wanted).alias("ask")).select("_id", "_key", "ask.*").distinct())
    places = F.filter(F.transform(words(F.col("text")), lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda x: x["w"].isin(VOCABULARY))
    again = rows.join(asked.select("_id", "_key").distinct(), ["_id", "_key"], "left_semi").select("_id", "_key", places.alias("places"))
    again = again.groupBy("_id", "_key").agg(F.first("places").alias("places"))  # equal rows are looked at once
    met = asked.join(F.broadcast(_items(spark, weight)), "item").join(again, ["_id", "_key"])
    starts = lambda p: F.transform(F.filter("places", lambda x: x["w"] == p["w"]), lambda x: F.struct((x["pos"] - p["at"]).alias("start"), p["weight"].alias("weight")))
    own = F.filter("postings", lambda p: F.array_contains("rare", p["w"]))
    hits = met.select("_id", "_key", "item", F.explode(F.flatten(F.transform(own, starts))).alias("hit"))
    hits = hits.groupBy("_id", "_key", "item", F.col("hit.start").alias("start")).agg(F.count("*").alias("n"), F.sum("hit.weight").alias("sum"))
    told = scratch.write("told", hits.join(F.broadcast(_items(spark, weight).drop("postings")), "item").where("key and n = size or not key and sum >= least"))
    scratch.drop("asked")

    keys = told.where("key")
    span = F.sequence(F.floor((F.col("start") - SLACK) / BIN), F.floor((F.col("start") + F.col("size") + SLACK) / BIN))
    near = told.where("not key").select("_id", "_key", "start", "size", "label", "needs", F.round(F.least(F.lit(1.0), F.col("sum") / F.col("total")), 6).alias("score"), F.explode(span).alias("bin"))
    held = near.join(keys.select("_id", "_key", F.col("item").alias("needs"), F.col("start").alias("place"), F.floor(F.col("start") / BIN).alias("bin")), ["_id", "_key", "needs", "bin"])
    held = held.where(F.col("place").between(F.col("start") - SLACK, F.col("start") + F.col("size") + SLACK))
    extra = held.groupBy("_id", "_key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    base = keys.where("label is not null").groupBy("_id", "_key").agg(F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"), F.collect_set("label").alias("own"))
    whole = counted.join(base, ["_id", "_key"], "left").join(extra, ["_id", "_key"], "left")
    none = F.array().cast("array<string>")
    own, more = F.coalesce("own", none), F.coalesce("more", none)
    return whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _array(found: list[str]) -> Column:
    return F.array(*map(F.lit, found))


def _rare_first(text: str, weight: dict[str, float]) -> list[str]:
    return sorted(set(text.split()), key=lambda w: (-weight[w], w))


def _lookups(weight: dict[str, float]) -> list[Column]:
    """For each phrase and licence, struct<item, rare>: the words of column _found that it is looked up by; null rare: not at all."""
    out = []
    for k in KEYS:
        own = F.when(F.size(F.array_intersect(_array(sorted(set(k.split()))), F.col("_found"))) == len(set(k.split())), _array(sorted(set(k.split()))))
        out.append(F.struct(F.lit(f"key:{k}").alias("item"), own.alias("rare")))
    for _, t, k in TEMPLATES:
        ordered = _rare_first(t, weight)
        rare = F.slice(F.array_intersect(_array(ordered), F.col("_found")), 1, RAREST)
        known = F.create_map(*[F.lit(x) for w in ordered for x in (w, weight[w])])
        reached = F.aggregate(rare, F.lit(0.0), lambda a, w: a + F.element_at(known, w)) >= LEAST_SCORE * _total(t, weight) - 1e-9
        out.append(F.struct(F.lit(f"text:{t}").alias("item"), F.when(reached, rare).alias("rare")))
    return out


def _total(text: str, weight: dict[str, float]) -> float:
    return float(sum(weight[w] for w in _rare_first(text, weight)[:RAREST]))


def _items(spark: SparkSession, weight: dict[str, float]) -> DataFrame:
    """item, key, size, total, least (weight that must be met), label, needs, postings of phrases and licences. A fixed small table."""

    def postings(t: str) -> list[tuple[str, int, float]]:
        return [(w, i, weight[w] / t.split().count(w)) for i, w in enumerate(t.split())]

    keys = [(f"key:{k}", True, len(k.split()), 0.0, 0.0, PHRASES.get(k), None, postings(k)) for k in KEYS]
    own = [(f"text:{t}", False, len(t.split()), _total(t, weight), LEAST_SCORE * _total(t, weight) - 1e-9, label, f"key:{k}", postings(t)) for label, t, k in TEMPLATES]
    names = ("item", "key", "size", "total", "least", "label", "needs")
    rows = [dict(zip(names, r)) | {"postings": [dict(zip(("w", "at", "weight"), p)) for p in r[-1]]} for r in keys + own]
    schema = "array<struct<item:string,key:boolean,size:int,total:double,least:double,label:string,needs:string,postings:array<struct<w:string,at:int,weight:double>>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("i")).select("i.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
