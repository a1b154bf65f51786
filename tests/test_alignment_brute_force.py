"""The whole alignment against its definition, item by item and line by line, on random meetings."""

import random
import re
import statistics

import pytest

from folioflow.functions.references import _identifiers, _references
from folioflow.operators import alignment, temporal

WORDS = "budget water parking ordinance storage replacement council library zoning airport reports adjournment public consent".split()


def words(text):
    return list(dict.fromkeys(w.lower() for w in re.findall("[A-Za-z']+", text)))


def significant(text):
    return [w for w in words(text) if len(w) > 4]


def parts(number):
    return [str(int(p)) if p.isdigit() else p.upper() for p in re.split(r"[.\s]+", number.strip()) if p]


def answers_to(number):
    own = parts(number)
    tails = [own[k:] for k in range(len(own))]
    return [t for t in tails if len(t) > 1 or not t[0].isdigit() or len(own) == 1]


def direct(item, line):
    """The strongest (rule, said) by which a line names an item."""
    _, no, number, title, _ = item
    found = []
    own = {}
    for i in _identifiers(title):
        own.setdefault((i["year"], i["number"]), i["kind"])
    for i in _identifiers(line[4]):
        key = i["year"], i["number"]
        if key in own and (i["kind"] is None or own[key] is None or own[key] == i["kind"]):
            if i["letter"] is None or set(words(line[4])) & set(significant(title)):
                found.append((alignment.SPOKEN_NUMBER if i["letter"] is None else alignment.WRITTEN_NUMBER, i["text"]))
    found += [(alignment.ITEM_NUMBER, r["text"]) for r in _references(line[4]) if r["parts"] in answers_to(number)]
    title_words = significant(title)
    if len(title_words) >= 2 and set(title_words) <= set(words(line[4])):
        found.append((alignment.TITLE, line[4].strip()))
    return min(found, default=None)


def readings(title):
    plain = re.sub(r"\([^)]*\)", " ", title)
    sides = dict.fromkeys([plain, *re.split(r"\s-\s|[–—]", plain)])
    return [s for s in map(significant, sides) if len(s) >= 2]


def announced(items, lines):
    """(item, start): said, of titles read on after a cue."""
    stretches = []
    for line in lines:
        m = re.search(alignment.CUE, line[4])
        if m and stretches:
            stretches[-1][1].append((line[2], line[1], line[4][: m.start()]))
        if m:
            stretches.append((line[2], [(line[2], line[1], line[4][m.start() :])]))
        elif stretches:
            stretches[-1][1].append((line[2], line[1], line[4]))
    out = {}
    for since, pieces in stretches:
        near = sorted((a, b, t.strip()) for a, b, t in pieces if a <= since + alignment.ANNOUNCED_MS)
        heard = {w for _, _, t in near for w in words(t)}
        for item in items:
            ws = next((r for r in readings(item[3]) if set(r) <= heard), None)
            if ws:
                k = next(k for k, (_, _, t) in enumerate(near) if set(ws) & set(words(t)))
                key = item[1], near[k][0]
                said = " ".join(t for _, _, t in near[k:])
                out[key] = min(out.get(key, said), said)
    return out


def aligned(items, lines, duration):
    lines = sorted(lines, key=lambda x: (x[2], x[1]))
    found = {}
    for item in items:
        for line in lines:
            if (e := direct(item, line)) is not None:
                key = item[1], line[2]
                found[key] = min(found.get(key, e), e)
    for key, said in announced(items, lines).items():
        found.setdefault(key, (alignment.TITLE, said))
    chain = {x["item"]: x["time"] for x in temporal._chain([{"item": a, "time": b} for a, b in sorted(found)])}
    differences = [i[4] - chain[i[1]] / 1000 for i in items if i[1] in chain and i[4] is not None]
    centre = max(differences, key=lambda c: (sum(abs(c - d) <= alignment.TOLERANCE_S for d in differences), -c), default=None)
    close = [d for d in differences if abs(d - centre) <= alignment.TOLERANCE_S]
    offset = round(statistics.median(close)) if len(close) >= alignment.LEAST_ANCHORS else None
    video = duration if duration is not None else lines[-1][3] if lines else 0
    out = {}
    for _, no, _, title, seconds in items:
        spoken = chain.get(no)
        shifted = (seconds - offset) * 1000 if spoken is None and seconds is not None and offset is not None else None
        mention = None
        if shifted is not None:
            said = {w for line in lines if max(line[2], line[3]) >= shifted - alignment.MENTION_MS and line[3] >= shifted - alignment.MENTION_MS and line[2] <= shifted + alignment.MENTION_MS for w in words(line[4])}
            mention = " ".join(sorted(said & set(significant(title)))) or None
        earlier = max((n for n in chain if n < no), default=None)
        later = min((n for n in chain if n > no), default=None)
        reason = None
        if spoken is None:
            if seconds is None:
                reason = "no published time"
            elif seconds < 0 or seconds * 1000 >= video:
                reason = "published time outside the video"
            elif offset is None:
                reason = "no agreed offset"
            elif shifted < 0 or shifted >= video:
                reason = "shifted time outside the video"
            elif mention is None:
                reason = "not mentioned near its time"
            elif (earlier is not None and shifted < chain[earlier]) or (later is not None and shifted > chain[later]):
                reason = "against the spoken order"
        start = spoken if spoken is not None else shifted if reason is None else None
        method = "spoken" if spoken is not None else "published" if start is not None else "none"
        out[no] = [method, start, None, found[no, spoken][1] if spoken is not None else mention if method == "published" else None, offset if method == "published" else None, reason]
    timed = sorted((v[1], no) for no, v in out.items() if v[1] is not None)
    for k, (start, no) in enumerate(timed):
        out[no][2] = timed[k + 1][0] if k + 1 < len(timed) else max(video, start)
    return {no: tuple(v) for no, v in out.items()}


def meeting(rng, n_items, n_lines):
    items, lines = [], []
    for k in range(n_items):
        number = rng.choice([f"{k + 1}.", f"{k // 2 + 1}.{'AB'[k % 2]}", f"{k + 1}.A.{rng.randrange(1, 4)}"])
        title = " ".join(rng.sample(WORDS, rng.randrange(1, 4)))
        title = rng.choice([title, f"O-2026-{10 + k}, {title}", f"{title} - {' '.join(rng.sample(WORDS, 2))} (notes)", f"resolution 2026-{10 + k}"])
        items.append((1, k, number, title, rng.choice([None, 40 * k + 100, 40 * k + 100, 40 * k + 100 + rng.randrange(-20, 20), 99_999, -5])))
    for j in range(n_lines):
        item = items[min(n_items - 1, j * n_items // n_lines)]
        text = rng.choice([
            " ".join(rng.sample(WORDS, 3)), f"item {item[2].rstrip('.').replace('.', ' ')} please", f"we move on to {item[3]}", f"next item is {' '.join(item[3].split()[:2])}",
            f"then {item[3].split(',')[0]} again", f"ordinance um 2026-{10 + rng.randrange(n_items)}", "thank you", "", f"the next item will be the {rng.choice(WORDS)}", " ".join(item[3].split()[-2:]),
        ])
        lines.append((1, j, 40_000 * j * n_items // n_lines + rng.randrange(0, 3) * 4000, 40_000 * j * n_items // n_lines + 9000, text))
    return items, lines


@pytest.mark.parametrize("seed", range(5))
def test_alignment_matches_its_definition(spark, seed):
    rng = random.Random(seed)
    meetings, want = {}, {}
    for m in range(6):
        items, lines = meeting(rng, rng.randrange(3, 12), rng.randrange(6, 50))
        duration = rng.choice([None, 40_000 * len(items) + 60_000])
        meetings[m] = [(m, *i[1:]) for i in items], [(m, *x[1:]) for x in lines], (m, duration)
        want |= {(m, no): v for no, v in aligned(items, lines, duration).items()}
    got = alignment.align(
        spark.createDataFrame([i for x, _, _ in meetings.values() for i in x], "meeting_id long, item_no int, number string, title string, seconds long"),
        spark.createDataFrame([i for _, x, _ in meetings.values() for i in x], "meeting_id long, line_id long, start_ms long, end_ms long, text string"),
        spark.createDataFrame([v for _, _, v in meetings.values()], "meeting_id long, duration_ms long"),
    )
    found = {(r["meeting_id"], r["item_no"]): (r["method"], r["start_ms"], r["end_ms"], r["said"], r["offset_s"], r["reason"]) for r in got.collect()}
    assert found == want
    assert {v[0] for v in want.values()} >= {"spoken", "none"}


def test_each_feature_is_computed_once(spark):
    """The steps' plans together hold few exchanges, and each text function is planned once for items and once for lines."""
    items, lines = meeting(random.Random(3), 8, 30)
    frames = (
        spark.createDataFrame(items, "meeting_id long, item_no int, number string, title string, seconds long"),
        spark.createDataFrame(lines, "meeting_id long, line_id long, start_ms long, end_ms long, text string"),
        spark.createDataFrame([(1, None)], "meeting_id long, duration_ms long"),
    )
    plans = []
    write = alignment.Cuts.write

    def seen(self, name, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, name, df)

    alignment.Cuts.write = seen
    try:
        plans.append(alignment.align(*frames)._jdf.queryExecution().executedPlan().toString())
    finally:
        alignment.Cuts.write = write
    assert sum(p.count("Exchange hashpartitioning") for p in plans) < 40
    assert sum(p.count("ArrowEvalPython") for p in plans) <= 4
