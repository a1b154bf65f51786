"""Near duplicates, line chunks, leaks, quality and the pipeline, against brute force and planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import decontaminate, line_dedup, near_dedup, quality
from folioflow.llm.common import Scratch

SF = "/root/testdata/sf0.001"
CLASHES = "node key band size head kept _id _key _chunks n_removed N_CHUNKS _lines _h _g _w _at _big _starts _wrong _gone _dup _seeds row i k chosen n score keep text_key regs set_id first_id own".split()


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(rng):
    """Families in which a text is near some members only, so that buckets hold several components."""
    rows = []
    for family in range(5):
        base = words(rng, 80 + 30 * family)
        for k in range(25):
            own = list(base)
            for _ in range(k // 4):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((" ".join(own)))
    rows += [" ".join(words(rng, 60)) for _ in range(30)] + [rows[0]] * 6 + [None, "", " \n ", "two words", "TWO  words", "a b c d e", "z " * 30_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("work", [near_dedup.WORK, 60])
def test_near_copies_match_brute_force(spark, monkeypatch, work):
    monkeypatch.setattr(near_dedup, "WORK", work)
    monkeypatch.setattr(near_dedup, "BLOCK", 512 if work > 60 else 8)
    rows = copies(random.Random(11))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_near_copies_of_odd_rows(spark):
    text = " ".join(words(random.Random(1), 30))
    got = near_dedup.near_duplicates(frame(spark, [(None, text), (4, text), (4, "another text"), (9, text)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted([(-1, 26, None, True), (4, 26, 4, True), (4, 1, 4, True), (9, 26, 4, False)], key=lambda r: r)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in near_dedup.link_components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 60)} | {101: 100, 102: 100}


def test_sketches_merge():
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (400, 300))
    both = near_dedup.registers(np.union1d(a, b))
    assert (both == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()


def test_repeated_passages_stay_once(spark):
    rng = random.Random(8)
    passage, block = " ".join(words(rng, 60)), "\n".join(" ".join(words(rng, 6)) for _ in range(12))
    own = {i: [" ".join(words(rng, 9)) for _ in range(6)] for i in range(12)}
    rows = [(i, "\n".join([*own[i][:3], passage if i % 2 else block, *own[i][3:]])) for i in own] + [(20, None), (21, ""), (None, passage), (30, "short\nlines"), (31, "short\nlines")]
    out = line_dedup.without_repeats(frame(spark, rows)).collect()
    texts = {r["doc_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and texts[20] is None and texts[21] == "" and texts[30] == texts[31] == "short\nlines"
    assert sum(passage in (t or "") for t in texts.values()) == 1
    left = [sum(line in (t or "") for t in texts.values()) for line in block.split("\n")]
    assert set(left) == {1}
    assert out[0].asDict().keys() == {"doc_id", "text", *CLASHES} and all(r[c] == "x" for r in out for c in CLASHES)
    for i in own:
        assert all(line in texts[i] for line in own[i])
    assert line_dedup.without_repeats(frame(spark, [])).count() == 0


def test_chunks_joined_are_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in line_dedup.with_chunks(docs).collect():
        starts = [s - 1 for s in r["_starts"]] + [len(r["_lines"])]
        assert starts == sorted(set(starts)) and starts[0] == 0
        assert "\n".join("\n".join(r["_lines"][a:b]) for a, b in zip(starts, starts[1:])) == (r["text"] or "")


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 40))) for i in range(8)]
    rows, want = [], set()
    for i in range(40):
        body = [f"c{rng.randrange(3000)}" for _ in range(200)]
        if i < 24:
            item, text = items[i % 8][0], items[i % 8][1].split()
            if i >= 8:  # a paraphrase: words changed and put in
                for _ in range(5):
                    text[rng.randrange(40)] = f"c{rng.randrange(3000)}"
                text.insert(10, "indeed")
            body[50:50] = text
            want.add((i, item))
        rows.append((i, " ".join(body)))
    rows += [(50, None), (51, ""), (52, "\n")]
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = decontaminate.leaks(frame(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.leaks(frame(spark, rows), bench.where("false")).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(100):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.in_order(a, b) == table[-1][-1]


def test_quality_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, n = found.agg(F.sum((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right / n > 0.8


def test_quality_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30))) for i in range(5)] + [(10, None), (11, ""), (None, "text without id"), (12, "twice"), (12, "twice"), (13, "w " * 50_000)]
    got = quality.classify(frame(spark, rows)).collect()
    assert len(got) == len(rows) and not any(r["keep"] for r in got if r["doc_id"] in (10, 11))
    assert quality.classify(frame(spark, [])).count() == 0


def test_pipeline_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    kept = [r["doc_id"] for r in out]
    assert len(kept) == len(set(kept)) and set(kept) < ids and len(kept) > len(ids) / 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_with_odd_rows(spark):
    """Null ids, repeated ids and rows, null and empty texts, columns of the library's own names, and an empty table."""
    rng = random.Random(12)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = lambda n: " ".join(rng.choice("the of and to in is that for it was on are with as this from house water river small people time year work".split()) for _ in range(n))
    body = [prose(60) for _ in range(6)]
    rows = [(1, body[0]), (2, body[0]), (2, body[1]), (3, body[2]), (3, body[2]), (3, body[2]), (None, body[3]), (None, body[3]), (None, f"{body[4]} {item}"), (5, f"{body[4]} {item}"), (5, body[5]), (6, None), (7, ""), (8, "")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    steps = dict(corpus_pipeline.STAGES)
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] or 0, r[1] or ""))
    assert told(steps["near_dedup"](spark, docs, SF)) == order([(1, body[0]), (2, body[1]), (3, body[2]), (None, body[3]), (None, body[3]), rows[8], rows[9], (5, body[5]), (6, None), (7, "")])
    assert told(steps["decontamination"](spark, docs, SF)) == order([r for r in rows if item not in (r[1] or "")])
    lines = told(steps["line_dedup"](spark, docs, SF))
    assert len(lines) == len(rows) and [t for i, t in lines if i == 6] == [None]
    kept = told(steps["quality_classifier"](spark, docs, SF))
    assert not any(i in (6, 7, 8) for i, _ in kept) and set(kept) <= {(i, t) for i, t in rows}
    encoded = steps["bpe_encoding"](spark, docs, SF).collect()
    assert len(encoded) == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
