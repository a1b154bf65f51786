"""The quality classifier against expectation-maximisation row by row and a regression in plain loops."""

import math
import random

import pytest

from folioflow.llm import quality
from folioflow.llm.quality import ABSTAIN, BAD, GOOD


def posteriors(rows, rounds=60):
    """P(good) of each row, by EM over rows instead of over patterns."""
    p = [0.05 if BAD in r else 0.95 for r in rows]
    for _ in range(rounds):
        mass = {c: sum(x if c == GOOD else 1 - x for x in p) for c in (BAD, GOOD)}
        prior = {c: (mass[c] + 1) / (len(rows) + 2) for c in mass}
        chance = []
        for j in range(len(rows[0])):
            seen = {(c, v): 1 + sum((x if c == GOOD else 1 - x) for x, r in zip(p, rows) if r[j] == v) for c in (BAD, GOOD) for v in (BAD, GOOD)}
            chance.append({(c, v): seen[c, v] / (seen[c, BAD] + seen[c, GOOD]) for c, v in seen})
        told = []
        for r in rows:
            log = {c: math.log(prior[c]) + sum(math.log(chance[j][c, v]) for j, v in enumerate(r) if v != ABSTAIN) for c in (BAD, GOOD)}
            told.append(1 / (1 + math.exp(max(-50, min(50, log[BAD] - log[GOOD])))))
        p = told
    return p


def features(text):
    words = text.split()
    sums = {}
    for a, w in zip([None, *words], words):
        for s in quality._slots(w) + [quality.STUTTER] * (a == w):
            sums[s] = sums.get(s, 0) + 1
    return {s: n / (len(words) + quality.PRIOR_WORDS) for s, n in sums.items()}


def trained(rows):
    """Weights by slot and bias: full-batch Adam, one weight after the other."""
    weights, bias, m, v = {}, 0.0, {}, {}
    n = {True: sum(p >= 0.5 for p, _ in rows), False: sum(p < 0.5 for p, _ in rows)}
    slots = sorted({s for _, f in rows for s in f})
    for step in range(1, quality.STEPS + 1):
        slope = dict.fromkeys([*slots, "bias"], 0.0)
        for p, f in rows:
            z = sum(weights.get(s, 0.0) * x for s, x in f.items()) + bias
            gap = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * 0.5 / max(1, n[p >= 0.5])
            slope["bias"] += gap
            for s, x in f.items():
                slope[s] += gap * x
        for s in [*slots, "bias"]:
            g = slope[s] + (1e-6 * weights.get(s, 0.0) if s != "bias" else 0)
            m[s], v[s] = 0.9 * m.get(s, 0.0) + 0.1 * g, 0.99 * v.get(s, 0.0) + 0.01 * g * g
            move = 0.3 * (m[s] / (1 - 0.9**step)) / (math.sqrt(v[s] / (1 - 0.99**step)) + 1e-6)
            if s == "bias":
                bias -= move
            else:
                weights[s] = weights.get(s, 0.0) - move
    return weights, bias


def corpus():
    rng = random.Random(7)
    prose = "the of and to in is that for it was on are with as this from house water river small people time year work".split()
    good = [" ".join(rng.choice(prose) for _ in range(rng.randrange(30, 60))) for _ in range(25)]
    junk = [" ".join(rng.choice(["BUY", "NOW!!", "@@##", "http://x.y", "|", "||", "$$$", "win", "WIN"]) for _ in range(rng.randrange(20, 40))) for _ in range(15)]
    stuck = [" ".join(["again"] * 30 + [rng.choice(prose)] * 10) for _ in range(5)]
    texts = [*good, *junk, *stuck, None, "", "two words", good[0], junk[0]]
    return [(i, t) for i, t in enumerate(texts)] + [(3, good[3]), (None, junk[1])]


def test_classifier_matches_plain_loops(spark):
    rows = corpus()
    known = quality._Known(quality.traits)
    p = posteriors([quality.votes(t or "", known) for _, t in rows])
    model, told = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["key"]): r["posterior"] for r in told.collect()}
    keys = {t: k for t, k in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").distinct().collect()}
    want = {(i, keys[t or ""]): x for (i, t), x in zip(rows, p)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    distinct = {(i, t or ""): x for (i, t), x in zip(rows, p)}
    weights, bias = trained([(x, features(t)) for (_, t), x in distinct.items()])
    assert model.bias == pytest.approx(bias, abs=1e-6)
    assert max(abs(model.weights[s] - w) for s, w in weights.items()) < 1e-6 and sum(model.weights != 0) == sum(w != 0 for w in weights.values())
    scores = quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, t), r in zip(rows, scores):
        z = sum(weights.get(s, 0.0) * x for s, x in features(t or "").items()) + bias
        assert r["doc_id"] == i and r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))) if (t or "").split() else 0.0, abs=1e-6)
        assert r["keep"] == (r["score"] >= 0.5)


def test_every_document_trains_the_classifier(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 12)  # 52 rows: five blocks, one a step
    monkeypatch.setattr(quality, "STEPS", 10)
    rows = corpus()
    model, told = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert told.count() == len(rows)
    used = {s for _, t in rows for s in features(t or "")}
    assert {s for s in range(quality.SLOTS) if model.weights[s]} == used
