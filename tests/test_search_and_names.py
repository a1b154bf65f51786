"""Line search and name matching against brute force."""

import math
import random
import re

from folioflow.functions import names
from folioflow.operators import search


def tokens(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t)]


def best_windows(lines, q, limit):
    """Every window of one to three lines, BM25 over all windows, cut, then one hit a mention."""
    terms, windows = tokens(q), []
    for t in sorted({x[0] for x in lines}):
        own = sorted((s, i, x) for g, i, s, x in lines if g == t)
        for last in range(len(own)):
            for span in range(1, min(3, last + 1) + 1):
                windows.append((t, own[last][1], span, last - span + 1, last, " ".join(x for _, _, x in own[last - span + 1 : last + 1])))
    words = [tokens(w[5]) for w in windows]
    mean = sum(map(len, words)) / len(words)
    scored = []
    for w, own in zip(windows, words):
        if all(x in own for x in terms):
            score = 0.0
            for x in terms:
                n = sum(x in o for o in words)
                idf = max(1e-6, math.log((len(words) - n + 0.5) / (n + 0.5)))
                score -= idf * own.count(x) * 2.2 / (own.count(x) + 1.2 * (0.25 + 0.75 * len(own) / mean))
            scored.append((round(score, 6), w[:3], w))
    cut = [(s, w) for s, _, w in sorted(scored)[: 6 * limit]]
    hits = []
    for t in {w[0] for _, w in cut}:
        taken = []
        for s, w in sorted((x for x in cut if x[1][0] == t), key=lambda x: (f" {' '.join(terms)} " not in f" {' '.join(tokens(x[1][5]))} ", x[1][2], x[0], x[1][3])):
            if all(w[4] < a or b < w[3] for a, b in taken):
                taken.append((w[3], w[4]))
                hits.append((f" {' '.join(terms)} " not in f" {' '.join(tokens(w[5]))} ", w[2], s, w[0], w[3], w[1]))
    return [(h[3], h[5], h[1]) for h in sorted(hits)[:limit]]


def test_line_search_matches_brute_force(spark):
    rng = random.Random(4)
    lines = [(t, i, 1000 * (i // 2), " ".join(rng.choice("the of water tank budget and city park".split()) for _ in range(rng.randrange(1, 6)))) for t in range(6) for i in range(12)]
    frame = spark.createDataFrame(lines, "transcript_id long, id long, start_ms long, text string")
    for q in ("water tank", "of the", "budget", "none here", ""):
        got = [(r["transcript_id"], r["last_id"], r["span"]) for r in search.search_lines(frame, q, 8).collect()]
        assert got == (best_windows(lines, q, 8) if tokens(q) else []), q


CLASSES = {c: k for k, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def key(name):
    low = [c for c in name.lower() if c.isalpha()]
    return "".join(low[:1] + [CLASSES[c] for c in low[1:] if c in CLASSES])


def winkler(a, b):
    if a == b:
        return 1.0
    reach, used, mine = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [x for x, u in zip(b, used) if u]
    half = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (len(mine) / len(a) + len(mine) / len(b) + (len(mine) - half) / len(mine)) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_names_match_brute_force(spark):
    rng = random.Random(5)
    syllables = "mar cy mc coy sing hi dal go fah ring pop kin kof fer jo nes zab row ski".split()
    name = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))).capitalize() for _ in range(2))
    known = [(b, 10 * b + k, name() + (f"-{name().split()[0]}" if k % 3 == 0 else "")) for b in range(3) for k in range(7)]
    said = [(rng.randrange(4), k, name() if k % 2 else "".join(rng.choice([c, c, "a"]) for c in known[k % len(known)][2])) for k in range(40)]
    got = {r["spoken_id"]: r for r in names.match_names(spark.createDataFrame(said, "body_id long, spoken_id long, spoken string"), spark.createDataFrame(known, "body_id long, person_id long, name string")).collect()}
    sound = lambda n: CLASSES.get(n.lower()[:1], n.lower()[:1])
    for body, i, text in said:
        words = text.split()
        ours = {" ".join(words[:k]) for k in range(1, len(words) + 1)} | set(words)
        scores = []
        for _, person, full in (x for x in known if x[0] == body):
            last = full.split()[-1]
            theirs = {full, last, *last.split("-")}
            if compared := [winkler(key(a), key(b)) for a in ours for b in theirs if a and b and sound(a) == sound(b)]:
                scores.append((-max(compared), person))
        scores.sort()
        top, second = (-scores[0][0] if scores else 0.0), (-scores[1][0] if len(scores) > 1 else 0.0)
        assert abs(got[i]["score"] - top) < 1e-4 and abs(got[i]["runner_up"] - second) < 1e-4
        assert got[i]["person_id"] == (scores[0][1] if scores else None)
        assert got[i]["passed"] == (top >= 0.72 and top - second >= 0.05)
