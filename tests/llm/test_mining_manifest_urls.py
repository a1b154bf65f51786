"""Hard negatives, the Merkle manifest and URL verdicts against SQL and brute force, with nulls, ties, repeated rows and odd values."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from compare import spark_bag, sql_bag, views
from pyspark.sql import functions as F

from folioflow.llm import hard_negatives, merkle, url_filter
from folioflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle", "op13_url_filter"])
def test_queries_match_sql(spark, name):
    assert spark_bag(QUERIES[name](spark, SF)) == sql_bag(views(SF), ORACLES[name])


# hard negatives


def mined(rows, positives, negatives):
    """By brute force over rows (vec_id, label, vector), anchors being those whose vec_id is divisible by 3."""
    held = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    fit = [(i, lab, [held(math.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, q) in enumerate(fit):
        if anchor is None or anchor % 3:
            continue
        score = lambda v: min(max(sum(x * y for x, y in zip(q, v)), hard_negatives.LEAST), hard_negatives.MOST)  # noqa: B023, E731
        told = sorted(((-score(v), i is None, i or 0, lab) for k, (i, lab, v) in enumerate(fit) if k != a))
        for p, none, i, _ in [r for r in told if r[3] == label][:positives]:
            fits = [r for r in told if r[3] != label and 30 * -p <= 100 * -r[0] <= 90 * -p][:negatives]
            out += [(anchor, None if none else i, n, None if r[1] else r[2], -p, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in ("rid", "cell", "q", "is_row", "rank", "score", "n")})


@pytest.mark.parametrize("block, scale", [(7, 1.0), (4096, 3e6), (7, 1e30)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 5 if block == 7 else 1 << 15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    rng = random.Random(3)
    values = [0.0, 0.25, -0.5, 0.75, 1.0]
    rows = [(i, rng.randrange(3), [rng.choice(values) * scale for _ in range(4)]) for i in range(60)]
    rows += rows[:8] + [(None, 1, [scale] * 4), (None, 2, [scale, scale, 0.0, scale]), (61, None, [1.0] * 4), (63, 1, None), (66, 1, [1.0, None, 1.0, 1.0]), (69, 2, [1.0, math.nan, 1.0, 1.0]), (72, 2, [math.inf, 1.0, 1.0, 1.0]), (75, 1, []), (78, 2, [scale, scale])]
    try:
        got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 3 == 0, positives=4, negatives=6)
        assert sorted((tuple(r) for r in got.collect()), key=str) == mined(rows, 4, 6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hard_negatives_of_few_rows(spark):
    mine = lambda rows: hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 3 == 0).collect()
    assert mine([]) == mine([(1, 1, [1.0])]) == mine([(3, 1, [1.0])]) == mine([(3, 1, [1.0]), (4, 1, [1.0])]) == []
    assert [tuple(r) for r in mine([(3, 1, [1.0]), (4, 1, [1.0]), (5, 2, [0.5])])] == [(3, 4, 1, 5, 65536, 32768)]


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """Root and, for each node, its siblings by level."""
    paths, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(s, min(s + 8, len(nodes))) for s in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    paths[leaf].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, under = [sha("".join(nodes[k] for k in run)) for run in runs], [sum((under[k] for k in run), []) for run in runs]
    return nodes[0], paths


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def manifest(rows):
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = own, tree([leaf(r, r[4]) for r in own])
    root, above = tree([trees[lang][1][0] for lang in order])
    for lang, up in zip(order, above):
        own, (subroot, paths) = trees[lang]
        for r, path in zip(own, paths):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for a, b in path + up:
                node = sha("".join([*a, node, *b]))
            out.append((r[0], leaf(r, r[4]), subroot, root, sha("".join("".join(a + b) for a, b in path + up)), node, node == root))
    return sorted(out, key=str)


def documents(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumns({c: F.lit("x") for c in ("g", "pos", "n", "node", "block", "more", "tie", "at", "part", "root")}).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_matches_brute_force(spark, monkeypatch, tmp_path, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(5)
    rows = [(i, rng.choice(["web", None, ""]), "hot" if i < 150 else f"l{i % 11}é", i % 7 or None, rng.choice(["Text A", "ünï Ç", "", "lower", None])) for i in range(240)]
    rows += [(300, "s", None, 1, "Lone")] + [(None, None, "hot", None, t) for t in ("B", "A", "A")] + rows[:3] + [(3, "other", "hot", 9, "Same id")] + [(301, "s", "long", 1, "Word " * 40_000)]
    got = merkle.op12_merkle(spark, documents(spark, tmp_path, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 9, 65])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    got = merkle.op12_merkle(spark, documents(spark, tmp_path, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == (manifest(rows) if rows else [])


def test_any_change_is_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaves = docs.select("doc_id", "lang", merkle.leaf_of().alias("leaf"), merkle.leaf_of(F.concat("text", F.lit("!"))).alias("more"))
    out = merkle.manifest(leaves).select((merkle.climbed("leaf", "siblings", "places") == F.col("root")).alias("same"), (merkle.climbed("more", "siblings", "places") == F.col("root")).alias("other"))
    assert {tuple(r) for r in out.collect()} == {(True, False)}


# URLs

URLS = [
    "http://example.org/es/1", "http://EXAMPLE.org/es/1", "http://example.org/ES/1", "https://sub.example.org/en/100", "http://notexample.org/es/", "http://example.org", "http://example.org?x=1", "http://org/", "org/", "ftp://a.com/fr/x",
    "http://a.com/fr", "http://a.com/de/?q#f", "http://com/de/", "http://a.com./de/", "http://a.com:80/de/", "http://x.net/a/?b=1&a=2&utm_source=q", "http://www.x.net:443/a?a=2&b=1#top", "http://x.net/a", "x://y://z.org/es/", "http:///es/", "://", "", None,
    "no address", "http://a.b.c.d.e.example.org/en/1", "http://ünï.org/es/", "http://spam.net/é?ß", "http://h" + "." * 3000 + "org/" + "p" * 50_000, "http://example.org/en/1\n2", "http://example.org/es/1",
]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(rows, rules, listed):
    out = []
    for i, url in rows:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, says) for says, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, says = max(fits)[2:] if fits else (None, "block" if url in listed else "allow")
        out.append((i, host, path, rule, says))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [256, 2])
def test_verdicts_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)
    rows = list(enumerate(URLS)) + [(None, URLS[0]), (100, "http://many.example.org/en/1")] + [(200 + i, "http://many.example.org/en/1") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rid", "row", "key", "rule", "asked", "best", "VERDICT")})
    rules = url_filter.RULES + [("allow", "example.org", "/es/"), ("block", "", "/"), ("allow", "many.example.org", "/en/")]
    table = spark.createDataFrame([*rules, ("block", None, "/"), (None, "a.com", "/")], "verdict string, host string, path string")
    listed = spark.createDataFrame([("x.net/a?a=2&b=1",), ("spam.net/é?ß",), (None,)], "url string")
    want = judged(rows, [r for r in rules if r != ("allow", "example.org", "/es/")], {URLS[15], URLS[16], "http://spam.net/é?ß"})
    got = url_filter.judge(pages, table, listed)
    assert sorted((tuple(r) for r in got.select("row.page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    assert got.select("row.*").columns == pages.columns
    bare = url_filter.judge(pages, table.where("false"), listed.where("false")).collect()
    assert len(bare) == len(rows) and {(r.rule, r.verdict) for r in bare} == {(None, "allow")}
    assert url_filter.judge(pages.where("false"), table, listed).count() == 0


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    found = url_filter.bloom_filter(keys)
    h = lambda df: np.array([r[0] for r in df.select(url_filter._hashes(F.col("key"))).collect()])
    own, other = h(keys), h(spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key")))
    assert url_filter.may_hold(found, own[:, 0], own[:, 1]).all()
    assert url_filter.may_hold(found, other[:, 0], other[:, 1]).mean() < 0.02
    assert found.shape == (2048, 8)
