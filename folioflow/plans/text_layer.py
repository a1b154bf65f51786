"""Search, text and name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import names, text, times
from folioflow.operators import search, temporal
from folioflow.plans.common import Registry, read

R = Registry()

_LINES = "lines AS (SELECT conv_id AS transcript_id, turn AS id, turn * 1000 AS start_ms, text FROM conversations)"
_WINDOWS = f"""{_LINES}, l AS (SELECT *, row_number() OVER w - 1 AS pos, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2 FROM lines WINDOW w AS (PARTITION BY transcript_id ORDER BY start_ms, id)),
windows AS (SELECT transcript_id, id AS last_id, span, pos - span + 1 AS first_pos, pos AS last_pos,
  CASE span WHEN 1 THEN text WHEN 2 THEN t1 || ' ' || text ELSE t2 || ' ' || t1 || ' ' || text END AS text
  FROM l CROSS JOIN (VALUES (1), (2), (3)) AS s(span) WHERE pos >= span - 1)"""


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def line_search_sql(terms: list[str], limit: int, where: str = "true") -> str:
    """Common table expressions up to hits: BM25 over all windows, the cut, then in each transcript one hit a mention, taken greedily in order."""
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS c{i}" for i, t in enumerate(terms))
    part = " ".join(f"- greatest(1e-6, ln((docs - d{i} + 0.5) / (d{i} + 0.5))) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"""{_WINDOWS}, wt AS (SELECT *, {_tokens("text")} AS w FROM windows), wc AS (SELECT *, len(w) AS n, {counts} FROM wt),
ws AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in range(len(terms)))} FROM wc),
wr AS (SELECT transcript_id, last_id, span, first_pos, last_pos, text, contains(' ' || array_to_string(w, ' ') || ' ', ' {" ".join(terms)} ') AS phrase, round(0.0 {part}, 6) AS score
  FROM wc, ws WHERE {" AND ".join(f"c{i} > 0" for i in range(len(terms)))} AND {where} ORDER BY score, transcript_id, last_id, span LIMIT {6 * limit}),
wk AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY phrase DESC, span, score, first_pos) AS place FROM wr),
chosen AS (SELECT DISTINCT transcript_id, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken FROM wk
  UNION ALL SELECT c.transcript_id, min(k.place), list_append(any_value(c.taken), {{'a': arg_min(k.first_pos, k.place), 'b': arg_min(k.last_pos, k.place)}})
  FROM chosen c JOIN wk k ON k.transcript_id = c.transcript_id AND k.place > c.place AND len(list_filter(c.taken, lambda t: NOT (k.last_pos < t.a OR t.b < k.first_pos))) = 0 GROUP BY c.transcript_id),
hits AS (SELECT wk.* FROM chosen JOIN wk ON wk.transcript_id = chosen.transcript_id AND wk.place = chosen.place ORDER BY phrase DESC, span, score, wk.transcript_id, first_pos LIMIT {limit})"""


LINE_HITS = "SELECT transcript_id, last_id, CAST(span AS INT) AS span, first_pos, last_pos, phrase, score FROM hits"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("id"), (F.col("turn") * 1000).alias("start_ms"), "text")


@R.add(f"WITH {_WINDOWS} SELECT transcript_id, last_id, CAST(span AS INT) AS span, first_pos, last_pos, md5(text) AS digest FROM windows")
def search_windows_123(spark: SparkSession, d: str) -> DataFrame:
    """[WN2, WN4, JN12, SO1, FT3]"""
    return search.windows(_lines(spark, d)).withColumn("digest", F.md5("text")).drop("text")


@R.add(f"SELECT doc_id FROM documents WHERE list_has_all({_tokens('text')}, ['the', 'of'])")
def search_and_match(spark: SparkSession, d: str) -> DataFrame:
    """[FT1, FT4, FT5]"""
    return read(spark, d, "documents").where(search.matches_all(text.search_terms(F.col("text")), search.query_terms("the OF"))).select("doc_id")


@R.add(f"WITH {_WINDOWS} SELECT transcript_id, last_id, CAST(span AS INT) AS span FROM windows WHERE contains(' ' || array_to_string({_tokens('text')}, ' ') || ' ', ' of the ')")
def search_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """[FT6, FT2] A phrase that may go over the end of a line."""
    w = search.windows(_lines(spark, d))
    return w.where(search.matches_phrase(text.search_terms(F.col("text")), ["of", "the"])).select("transcript_id", "last_id", "span")


@R.add(f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'with')) AS c0, len(list_filter(w, lambda x: x = 'from')) AS c1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM c)
SELECT doc_id, round(-greatest(1e-6, ln((docs - d0 + 0.5) / (d0 + 0.5))) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * n / mean))
 - greatest(1e-6, ln((docs - d1 + 0.5) / (d1 + 0.5))) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE c0 > 0 AND c1 > 0 ORDER BY 2, 1 LIMIT 50""")
def bm25_topk_docs(spark: SparkSession, d: str) -> DataFrame:
    """[FT7, FT9, SL1] One pass for all counts, then TakeOrdered: no shuffle of documents."""
    return search.bm25(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"], ["with", "from"], 50)


@R.add(f"WITH RECURSIVE {line_search_sql(['of', 'the'], 50)} {LINE_HITS}")
def search_one_hit_per_mention(spark: SparkSession, d: str) -> DataFrame:
    """[FT10, SL7, JN3] Best windows for a question, one a mention, tightest and phrase first."""
    return search.search_lines(_lines(spark, d), "of the", 50)


@R.add("""SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\u00A0]+', ' ', 'g'))) AS plain, md5(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents""".replace("\\u00A0", " "))
def text_fold(spark: SparkSession, d: str) -> DataFrame:
    """[ST1, ST15]"""
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(text.collapse_space(t)).alias("plain"), F.md5(text.fold_name(t)).alias("folded"))


@R.add("""SELECT conv_id, turn, len(w) AS n_words, array_to_string(list_filter(list_distinct_ordered, lambda x: length(x) > 4), ' ') AS words FROM
  (SELECT conv_id, turn, w, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]) AS list_distinct_ordered
   FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM conversations))""")
def significant_words(spark: SparkSession, d: str) -> DataFrame:
    """[ST5, ST6, SO6]"""
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(text.spoken_words(t)).cast("long").alias("n_words"), F.array_join(text.significant_words(t), " ").alias("words"))


@R.add("""WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT l.source, md5(line) AS line, count(*) AS pages FROM l JOIN n ON n.source = l.source WHERE line <> '' GROUP BY l.source, line, n HAVING count(*) >= greatest(2, ceil(n * 0.2))""")
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    """[AG14] Lines on a fifth of a source's pages. Digests of lines are shuffled, not lines; each page counts a line once."""
    docs = read(spark, d, "documents")
    lines = docs.select("source", F.explode(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))).alias("line")).select("source", F.md5("line").alias("line"))
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    return lines.groupBy("source", "line").agg(F.count("*").alias("pages")).join(n, "source").where("pages >= greatest(2, ceil(n * 0.2))").drop("n")


@R.add("""SELECT s_suppkey, s_name, substr(l, 1, 1) || translate(regexp_replace(substr(l, 2), '[^bfpvcgjkqsxzdtlmnr]', '', 'g'), 'bfpvcgjkqsxzdtlmnr', '111122222222334556') AS key,
translate(substr(l, 1, 1), 'bfpvcgjkqsxzdtlmnr', '111122222222334556') AS sound FROM (SELECT *, regexp_replace(lower(s_name), '[^\\p{L}]', '', 'g') AS l FROM supplier)""")
def phonetic_key(spark: SparkSession, d: str) -> DataFrame:
    """[ST13]"""
    return read(spark, d, "supplier").select("s_suppkey", "s_name", names.phonetic_key(F.col("s_name")).alias("key"), names.initial_class(F.col("s_name")).alias("sound"))


@R.add()
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """[JN17, ST14] All part names, misspelt, against the true ones of the same brand and size."""
    body = F.concat_ws("-", "p_brand", "p_size").alias("body_id")
    p = read(spark, d, "part")
    officials = p.select(body, F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))
    spoken = p.select(body, F.col("p_partkey").alias("spoken_id"), F.translate("p_name", "aei", "eia").alias("spoken"))
    return names.match_names(spoken, officials)


@R.add("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    """Host and path of addresses."""
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))


@R.add("""SELECT doc_id, array_to_string(list_filter(['the', 'license', 'rights reserved'], lambda p: regexp_matches(text, '(?i)\\b' || p || '\\b')), ',') AS keywords,
array_to_string(list_filter(['draft', 'idiot'], lambda p: regexp_matches(text, '(?i)\\b' || p || '\\b')), ',') AS skips FROM documents""")
def classifier_keywords(spark: SparkSession, d: str) -> DataFrame:
    """[FLT6, UD6] Keywords and skip phrases found as whole words; a skip phrase outweighs keywords."""
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.array_join(text.matched_phrases(t, ["the", "license", "rights reserved"]), ",").alias("keywords"), F.array_join(text.matched_phrases(t, ["draft", "idiot"]), ",").alias("skips"))


@R.add("""SELECT conv_id, turn, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS cue, printf('%02d:%02d:%02d.%03d', turn * 61234 // 3600000, turn * 61234 // 60000 % 60, turn * 61234 // 1000 % 60, turn * 61234 % 1000) AS at FROM conversations""")
def caption_sink(spark: SparkSession, d: str) -> DataFrame:
    """[SRC20, ST4, DT6] Lines as caption cues."""
    return read(spark, d, "conversations").select("conv_id", "turn", text.escape_markup(F.col("text")).alias("cue"), times.clock(F.col("turn") * 61234).alias("at"))


@R.add("""SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'license')""")
def whole_row_filter(spark: SparkSession, d: str) -> DataFrame:
    """[FLT5] A term anywhere in a row."""
    return read(spark, d, "documents").where(F.contains(F.lower(F.concat_ws(" ", "source", "lang", "text")), F.lit("license"))).select("doc_id")


@R.add("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) // 3600000000 AS hours FROM events""")
def stamps_and_ages(spark: SparkSession, d: str) -> DataFrame:
    """[DT1, DT2, DT3]"""
    ts = F.col("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", times.stamp(ts).alias("stamp"), times.elapsed_hours(F.to_timestamp(F.lit("2030-01-01T00:00:00Z")), ts).alias("hours"))


@R.add()
def longest_ordered_chain(spark: SparkSession, d: str) -> DataFrame:
    """[SL6] Order lines as agenda items and their ship days as times; one function call an order."""
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("item"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("time"))
    return temporal.last_in_order(x)


@R.add("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '(\\.|!|\\?)\\s+'), lambda s: s <> '')) AS sentences, array_to_string(string_split(text, chr(10))[1:2], '|') AS head FROM documents""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """[ST26, SL4] Sentences by end marks and white space, and the first lines."""
    t = F.col("text")
    parts = F.filter(F.split(t, r"(\.|!|\?)\s+"), lambda s: s != "")
    return read(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("sentences"), F.array_join(F.slice(F.split(t, "\n"), 1, 2), "|").alias("head"))


@R.add("""WITH n AS (SELECT n_name, n_nationkey FROM nation), v AS (SELECT a.n_name AS a, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS pos FROM nation a)
SELECT a, pos FROM v""")
def dense_positions(spark: SparkSession, d: str) -> DataFrame:
    """[WN4]"""
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return read(spark, d, "nation").select(F.col("n_name").alias("a"), (F.row_number().over(w) - 1).cast("long").alias("pos"))
