"""Pairs of buckets above WORK, against brute force."""

import random

from pyspark.sql import functions as F

from folioflow.llm import near_dedup
from folioflow.llm.common import Scratch


def test_pairs_of_large_buckets_are_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "WORK", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    rows = []
    for family in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(12):
            own = list(base)
            for k in rng.sample(range(100), 2):
                own[k] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs, scratch = spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")
    sets = scratch.write("sets", near_dedup.sketches(docs).select("doc_id", "text_key", F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "regs"))
    keys = {r["node"]: [bytes(r["regs"][k : k + near_dedup.ROWS]) for k in range(0, len(r["regs"]), near_dedup.ROWS)] for r in sets.collect()}
    met = [(n, b, hash((b, k)) & (1 << 62) - 1) for n, own in keys.items() for b, k in enumerate(own)]
    buckets = spark.createDataFrame(met, "node long, band int, key long")
    got = {(r["a"], r["b"]) for r in near_dedup._apart_in_buckets(docs, buckets, spark.createDataFrame([], "node long, comp long"), sets, scratch).collect()}
    size = {}
    for own in keys.values():
        for k in enumerate(own):
            size[k] = size.get(k, 0) + 1
    shingles = {i: near_dedup.shingle_set(t) for i, t in rows}
    first = lambda a, b: next((k for k in enumerate(keys[a]) if keys[b][k[0]] == k[1]), None)
    want = {(a, b) for a in keys for b in keys if a > b and near_dedup.alike(shingles[a], shingles[b]) and first(a, b) and size[first(a, b)] > 2}
    assert want and got == want
