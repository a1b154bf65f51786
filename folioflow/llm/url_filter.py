"""Operator 13: verdicts on URLs. A blocked Bloom filter of all listed keys passes possible hits to an exact hash join.

Keys are rules (host and path) and canonical URLs. A URL has few possible keys: its host's last labels with its path's
beginning, for the numbers of labels and characters that rules have, and its canonical form. Only what passes the filter is
joined, so rows that no list knows meet no shuffle but the last."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table

#: A block has 8 words of 32 bits; a key sets one bit of each. The filter has at most MOST_BLOCKS (8 MB), and BITS bits a key below that.
WORDS, BITS, MOST_BLOCKS = 8, 16, 1 << 18
#: A key with at least this share of all possible hits is joined by broadcast; there are at most so many of them.
HOT = 256
#: Fixed values of the query: the rules, and words of hosts whose URLs make its list.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
JUNK = ["spam", "pills", "casino", "lottery"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty if there's none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www. and a default port, path without a closing slash, parameters sorted and without those that only track."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    params = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    told = F.array_sort(F.filter(params, lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")) & ~F.startswith(p, F.lit("ref="))))
    return F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(told, "&"))).otherwise(F.lit("")))


def listed_keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, is_rule, host, rule, verdict: rules (verdict, host, path) and canonical URLs (url) to block. Of rules for one place, block wins."""
    usable = rules.where("host is not null and path is not null and verdict is not null and host <> ''")
    by_rule = usable.select(F.concat(F.lit("^"), "host", "path").alias("key"), F.lit(True).alias("is_rule"), "host", F.concat("host", "path").alias("rule"), "verdict")
    by_url = listed.where("url is not null").select(F.concat(F.lit("="), "url").alias("key"), F.lit(False).alias("is_rule"), F.lit("").alias("host"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    return by_rule.unionByName(by_url).groupBy("key").agg(F.first("is_rule").alias("is_rule"), F.max("host").alias("host"), F.first("rule").alias("rule"), F.max("verdict").alias("verdict"))


def _hashes(key: Column) -> Column:
    """Two hashes of a key: the first tells the block, the second the bits."""
    return F.array(F.xxhash64(key), F.xxhash64(F.lit(1), key))


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """A blocked Bloom filter (blocks x WORDS of 32 bits) of the column key, merged by OR in Spark; its size is bounded by MOST_BLOCKS."""
    n = keys.count()
    blocks = 1
    while blocks < min(MOST_BLOCKS, n * BITS / (32 * WORDS)):
        blocks *= 2
    h = keys.select(_hashes(F.col("key")).alias("h")).select(F.pmod(F.col("h")[0], F.lit(blocks)).alias("block"), F.col("h")[1].alias("b"))
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("b", 5 * w).bitwiseAND(F.lit(31)).cast("int"))).alias(f"w{w}") for w in range(WORDS)]
    found = h.groupBy("block").agg(*words).toArrow()
    out = np.zeros((blocks, WORDS), np.uint32)
    if found.num_rows:
        out[found.column("block").to_numpy()] = np.stack([found.column(f"w{w}").to_numpy().astype(np.uint32) for w in range(WORDS)], 1)
    return out


def may_hold(found: np.ndarray, h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the filter passes keys with these hashes; it passes all that it was made of."""
    bits = (b.astype(np.uint64)[:, None] >> np.arange(0, 5 * WORDS, 5, dtype=np.uint64)) & np.uint64(31)
    words = found[np.mod(h, len(found))]
    return ((words >> bits.astype(np.uint32)) & np.uint32(1)).all(1)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """row (struct: the columns of pages), host, path, rule, verdict for every row of pages (url and any other columns).

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the longest wins, then the one
    with the longer host. Where none fits, rule is null and the verdict is block if the canonical URL is in listed (url), else allow.
    Every possible hit is joined with the list on the whole key, so verdicts don't depend on the filter's size or luck.

    A null url, or one without ://, has an empty host and path: no rule fits, and it's allowed. Rules with a null or without host are
    passed over; of several verdicts for one place block wins. Repeated rows each give a row; an empty table gives an empty
    result, empty lists allow all. Columns of any name stay in row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    keys = scratch.write("keys", listed_keys(rules, listed))
    labels = lambda c: F.size(F.split(c, r"\."))
    shapes = keys.where("is_rule").select(labels("host").alias("k"), (F.length("rule") - F.length("host")).alias("n")).distinct().collect()  # one row a pair of numbers that rules have
    url = F.col("row.url")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = scratch.write("rows", rows.select("rid", "row", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), F.concat(F.lit("="), canonical(url)).alias("whole")))
    possible = [F.when((labels("host") >= s.k) & (F.length("path") >= s.n) & (F.col("host") != ""), F.concat(F.lit("^"), F.substring_index("host", ".", -s.k), F.substring("path", 1, s.n))) for s in shapes]
    asked = rows.select("rid", F.filter(F.array(F.when(F.col("host") != "", F.col("whole")), *possible), lambda k: k.isNotNull()).alias("asked"))
    asked = asked.where(F.size("asked") > 0)
    told = spark.sparkContext.broadcast(bloom_filter(keys.select("key")))

    @F.arrow_udf("array<boolean>")
    def passes(h: pa.Array, b: pa.Array) -> pa.Array:
        held = may_hold(told.value, h.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(held))

    first, second = F.transform("asked", lambda k: _hashes(k)[0]), F.transform("asked", lambda k: _hashes(k)[1])
    passed = asked.withColumn("held", passes(first, second)).select("rid", F.arrays_zip("asked", "held").alias("z"))
    hits = scratch.write("hits", passed.select("rid", F.explode(F.filter("z", lambda z: z["held"])).alias("z")).select("rid", F.col("z.asked").alias("key")))

    total = hits.count()
    hot = scratch.write("hot", hits.groupBy("key").count().where(F.col("count") * HOT >= total).select("key"))  # at most HOT keys
    few = keys.join(F.broadcast(hot), "key", "left_semi")
    rest = hits.join(F.broadcast(hot), "key", "left_anti").join(keys.hint("shuffle_hash"), "key")
    exact = rest.unionByName(hits.join(F.broadcast(few), "key"))
    best = exact.groupBy("rid").agg(F.max(F.struct("is_rule", F.length("key").alias("size"), F.length("host").alias("host_size"), "rule", F.col("verdict").alias("says"))).alias("best"))
    return rows.join(best, "rid", "left").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit("allow")).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists all pages at hosts that hold a word of JUNK; judges every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    junk = F.lit(False)
    for word in JUNK:
        junk = junk | F.contains(host_of(F.col("url")), F.lit(word))
    listed = pages.where(junk).select(canonical(F.col("url")).alias("url")).distinct()
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules, listed).select("row.page_id", "host", "path", "rule", "verdict")


_SQL_REST = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
OP13_SQL = rf"""
WITH cut AS (SELECT page_id, url, coalesce({_SQL_REST}, '') AS rest FROM pages),
parts AS (
  SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS params
  FROM cut),
whole AS (
  SELECT *, row_number() OVER () AS rid, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/$', '')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM whole WHERE {" OR ".join(f"contains(host, '{w}')" for w in JUNK)}),
rules(says, rule_host, rule_path) AS (VALUES {", ".join(map(str, RULES))}),
best AS (
  SELECT rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says
  FROM whole JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM whole LEFT JOIN best USING (rid)
"""
