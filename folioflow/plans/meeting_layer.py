"""Sources, alignment and search over the driver's tables: files are made from the tables, read, and must give the tables' rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import references, text
from folioflow.operators import alignment, grounding, minutes, search, speakers
from folioflow.plans import text_layer
from folioflow.plans.common import Registry, read
from folioflow.sources import agendas, captions, listings, tables

R = Registry()


@R.add()
def align_agenda(spark: SparkSession, d: str) -> DataFrame:
    """[CX1] Each conversation as a transcript; its questions' first six words are the agenda, published 100 s early."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = c.select("meeting_id", F.col("turn").alias("line_id"), (F.col("turn") * 60_000).alias("start_ms"), (F.col("turn") * 60_000 + 50_000).alias("end_ms"), "text")
    title = F.array_join(F.slice(F.split(text.collapse_space(F.col("text")), " "), 1, 6), " ")
    asked = c.where("role = 'user'").select("meeting_id", F.col("turn").cast("int").alias("item_no"), F.concat(F.col("turn") + 1, F.lit(".")).alias("number"), title.alias("title"), (F.col("turn") * 60 + 100).alias("seconds"))
    videos = lines.groupBy("meeting_id").agg((F.max("end_ms") + 200_000).alias("duration_ms"))
    return alignment.align(asked, lines, videos)


@R.add("""WITH o AS (SELECT o_orderkey, 2000 + o_orderkey % 80 AS y, 10 + o_custkey % 90 AS n, o_orderkey % 5 AS form FROM orders)
SELECT o_orderkey, CASE form WHEN 0 THEN 'ordinance' WHEN 1 THEN 'resolution' WHEN 2 THEN 'ordinance' WHEN 3 THEN 'resolution' END AS kind, CAST(y AS INT) AS year, CAST(n AS INT) AS number,
CASE form WHEN 0 THEN 'O-' WHEN 1 THEN 'R-' WHEN 2 THEN 'O-' WHEN 3 THEN 'R-' ELSE '' END || y || '-' || n AS canonical, (1 + n % 12) || '/' || chr(CAST(65 + n % 6 AS INT)) AS item FROM o""")
def record_numbers(spark: SparkSession, d: str) -> DataFrame:
    """[ST7, ST8, ST9] Numbers in all five forms, and the item cited after them."""
    y, n, form = 2000 + F.col("o_orderkey") % 80, 10 + F.col("o_custkey") % 90, F.col("o_orderkey") % 5
    split = F.concat(F.lit("ordinance um 20 "), F.substring(y.cast("string"), 3, 2), F.lit("-"), n)
    said = F.when(form == 0, F.concat(F.lit("O-"), y, F.lit("-"), n)).when(form == 1, F.concat(F.lit("see R"), y, n)).when(form == 2, split).when(form == 3, F.concat(F.lit("the resolution "), y, F.lit("-"), n)).otherwise(F.concat(F.lit("and "), y, n, F.lit(".")))
    told = F.concat(said, F.lit(" under agenda item "), 1 + n % 12, F.lit(" "), F.char(65 + n % 6))
    found = read(spark, d, "orders").select("o_orderkey", F.explode(references.identifiers(told)).alias("i"), references.item_references(told).alias("r"))
    return found.select("o_orderkey", "i.kind", "i.year", "i.number", references.canonical(F.col("i")).alias("canonical"), F.array_join(F.col("r")[0]["parts"], "/").alias("item"))


_SAID = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@R.add(f"""SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, turn * 61234 AS start_ms, turn * 61234 + 5000 AS end_ms, md5({_SAID}) AS digest
FROM conversations WHERE {_SAID} <> ''""")
def caption_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """[SRC5, SRC20] Conversations written as WebVTT files and read again."""
    said = text.collapse_space(F.coalesce("text", F.lit("")))
    lines = read(spark, d, "conversations").where(said != "").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), (F.col("turn") * 61234).alias("start_ms"), (F.col("turn") * 61234 + 5000).alias("end_ms"), said.alias("text"))
    files = captions.to_web_captions(lines, "path").select("path", F.encode("content", "UTF-8").alias("content"))
    return captions.caption_lines(files, captions.web_captions).select("path", F.col("line").cast("long").alias("line"), "start_ms", "end_ms", F.md5("text").alias("digest"))


@R.add("""SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber * 1000 AS start_ms, l_linenumber * 1000 + l_partkey AS end_ms, l_returnflag || ' ' || l_linestatus AS text, l_linenumber * 1000 + l_suppkey AS second_ms FROM lineitem""")
def timed_text_lines(spark: SparkSession, d: str) -> DataFrame:
    """[SRC4] Each order's lines as a timedtext file, with empty paragraphs between them."""
    start = F.col("l_linenumber") * 1000
    p = F.concat(F.lit('<p t="'), start, F.lit('" d="'), F.col("l_partkey"), F.lit('"><s>'), F.col("l_returnflag"), F.lit('</s><s t="'), F.col("l_suppkey"), F.lit('"> '), F.col("l_linestatus"), F.lit('</s></p><p t="0" d="1" a="1"> </p>'))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.struct("l_linenumber", p.alias("p")).alias("x"))
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    files = whole.select("path", F.encode(F.concat(F.lit('<timedtext format="3"><body>'), F.array_join(F.transform("xs", lambda x: x["p"]), ""), F.lit("</body></timedtext>")), "UTF-8").alias("content"))
    return captions.caption_lines(files, captions.timed_text).select("path", "start_ms", "end_ms", "text", F.col("words")[1]["start_ms"].alias("second_ms"))


@R.add(f"""WITH s AS (SELECT conv_id, turn, role, {_SAID} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS path, line, turn * 1500 AS start_ms, turn * 1500 + 1250 AS end_ms, md5(said) AS digest, role AS speaker FROM s WHERE said <> '' AND role <> 'system'""")
def speech_lines(spark: SparkSession, d: str) -> DataFrame:
    """[SRC6] Conversations as speech-to-text documents; the system's turns are hidden."""
    s = F.struct((F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1.25).alias("end"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("speaker"), (F.col("role") == "system").alias("hidden"))
    docs = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.struct("turn", s.alias("s")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    value = docs.select("path", F.to_json(F.struct(F.transform("xs", lambda x: x["s"]).alias("segments"))).alias("value"))
    return captions.spoken_json(value).select("path", F.col("line").cast("long").alias("line"), "start_ms", "end_ms", F.md5("text").alias("digest"), "speaker")


@R.add("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS item_no FROM lineitem)
SELECT l_orderkey AS page_id, item_no, CASE WHEN item_no = 0 THEN '3.' ELSE '3.A' || item_no END AS number, l_returnflag || ' & ' || l_linestatus AS title,
CASE WHEN l_partkey % 3 > 0 THEN l_suppkey END AS seconds, CASE WHEN l_partkey % 3 = 0 THEN 'missing' WHEN l_suppkey > 50 THEN 'outside_video' ELSE 'usable' END AS time_status FROM l""")
def html_agenda_items(spark: SparkSession, d: str) -> DataFrame:
    """[SRC8] Each order as an HTML agenda: its first line is the section, the others are the section's items."""
    time = F.when(F.col("l_partkey") % 3 > 0, F.col("l_suppkey").cast("string")).otherwise("soon")
    title = F.concat(F.col("l_returnflag"), F.lit("&nbsp; &amp; "), F.col("l_linestatus"))
    section = F.concat(F.lit('<div data-sectionid="1" data-videolocation="'), time, F.lit('"><td class="number-cell-section">3.</td><td class="section-heading">'), title, F.lit('<br class="paragraph-break">a note</td>'))
    item = F.concat(F.lit('<div class="meeting-item" data-videolocation="'), time, F.lit('"><td class="number-cell">'), F.lit("A"), F.col("k"), F.lit('.</td><td class="agenda-item">'), title, F.lit('<span class="item_contents">draft</span></td></div>'))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    rows = read(spark, d, "lineitem").withColumn("k", place).select(F.col("l_orderkey").alias("page_id"), F.struct("k", F.when(F.col("k") == 0, section).otherwise(item).alias("h")).alias("x"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("page_id", F.concat(F.array_join(F.transform("xs", lambda x: x["h"]), ""), F.lit("</div>")).alias("html"))
    return agendas.html_agendas(pages, "page_id", "html", F.lit(50).cast("long")).withColumn("item_no", F.col("item_no").cast("long"))


@R.add("""WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n, sum(l_suppkey) FILTER (l_returnflag <> 'R') AS templates FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS meeting_id, o_orderpriority AS title, n, coalesce(templates, 0) AS templates FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def portal_listing(spark: SparkSession, d: str) -> DataFrame:
    """[SRC7] Orders as a portal's answers, in two lists that overlap: no time, no meeting; no template, no document."""
    doc = F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("templateId"))
    docs = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(doc).alias("documentList"))
    entry = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("dateTime"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  ")).alias("title"), "documentList")
    lists = read(spark, d, "orders").join(docs, "o_orderkey").groupBy(F.floor(F.col("o_orderkey") / 500).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    both = lists.select(F.lit(0).alias("list_no"), "value").unionByName(lists.select(F.lit(1).alias("list_no"), F.replace("value", F.lit('"title":"'), F.lit('"title":"again')).alias("value")))
    found = listings.portal_meetings(both)
    return found.select("meeting_id", "title", F.size("documents").cast("long").alias("n"), F.aggregate(F.transform("documents", lambda x: x["templateId"]), F.lit(0).cast("long"), lambda a, b: a + b).alias("templates"))


@R.add("""SELECT event_id, CAST(value > 50 AS BOOLEAN) AS flag, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """[SRC1] 0/1 columns as booleans, JSON as maps."""
    e = read(spark, d, "events").select("event_id", (F.col("value") > 50).cast("int").alias("flag"), "props")
    got = tables.typed(e, ["flag"], {"props": "map<string,bigint>"})
    return got.select("event_id", "flag", F.col("props")["k"].alias("k"))


@R.add("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def row_by_key(spark: SparkSession, d: str) -> DataFrame:
    """[SRC2] One row by its key."""
    orders = read(spark, d, "orders")
    return tables.row_of(orders, "o_orderkey", orders.agg(F.max("o_orderkey")).first()[0]).select("o_orderkey", "o_totalprice")


_PAGES = """pt AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents), pc AS (SELECT doc_id, text, lang, len(w) AS n,
  len(list_filter(w, lambda x: x = 'to')) AS c0, len(list_filter(w, lambda x: x = 'on')) AS c1 FROM pt), ps AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM pc),
pr AS (SELECT doc_id, text, round(-greatest(1e-6, ln((docs - d0 + 0.5) / (d0 + 0.5))) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * n / mean)) - greatest(1e-6, ln((docs - d1 + 0.5) / (d1 + 0.5))) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
  FROM pc, ps WHERE c0 > 0 AND c1 > 0 AND lang <> 'de' ORDER BY score, doc_id LIMIT 40)"""


@R.add(f"""WITH RECURSIVE {text_layer.line_search_sql(["to", "on"], 40, "transcript_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")}, {_PAGES},
both_ AS (SELECT 0 AS kind, row_number() OVER (ORDER BY phrase DESC, span, score, transcript_id, first_pos) AS place, transcript_id, last_id, CAST(span AS INT) AS span, CAST(NULL AS BIGINT) AS id, score, text FROM hits
  UNION ALL SELECT 1, row_number() OVER (ORDER BY score, doc_id), NULL, NULL, NULL, doc_id, score, text FROM pr)
SELECT row_number() OVER (ORDER BY kind, place) AS position, CASE kind WHEN 0 THEN 'line' ELSE 'page' END AS origin, transcript_id, last_id, span, id, score, sha256(text) AS sha256 FROM both_ ORDER BY kind, place LIMIT 40""")
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """[FT9, FT11, FT12, SL8] Windows of lines, one a mention, then pages, cut at the limit together; filters come before each ranking's cut."""
    c = read(spark, d, "conversations")
    lines = c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("id"), (F.col("turn") * 1000).alias("start_ms"), "text")
    area = lines.select("transcript_id").distinct().join(c.where("role = 'system'").select(F.col("conv_id").alias("transcript_id")), "transcript_id", "left_anti")
    pages = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("area"), "text")
    hits = search.unified(lines, pages, "to on", 40, area, F.col("area") != "de")
    return hits.select(F.col("position").cast("long").alias("position"), "origin", "transcript_id", "last_id", "span", "id", "score", "citation.sha256")


@R.add("""WITH o AS (SELECT o_orderkey, o_custkey, 1 + o_custkey % 7 AS y, o_orderkey % 3 AS n, o_orderkey % 4 AS form FROM orders)
SELECT o_orderkey AS meeting_id, CAST(1 AS INT) AS ordinal, 'Member ' || (o_custkey % 50) AS mover, CASE form WHEN 0 THEN 'passed' WHEN 1 THEN 'tabled' WHEN 2 THEN 'failed' ELSE 'withdrawn' END AS result,
CASE form WHEN 1 THEN 'to table item ' ELSE 'to approve O-2026-' END || (10 + o_custkey % 90) AS text, CASE WHEN form < 3 THEN CAST(y AS INT) END AS yes, CASE WHEN form < 3 THEN CAST(n AS INT) END AS no FROM o""")
def printed_motions(spark: SparkSession, d: str) -> DataFrame:
    """[ST22, AG14] Each order as a page of minutes with one motion, its number broken over two lines."""
    c, form = F.col("o_custkey"), F.col("o_orderkey") % 4
    number = 10 + c % 90
    said = F.when(form == 1, F.concat(F.lit("to table\nitem "), number)).otherwise(F.concat(F.lit("to approve O-\n2026-"), number))
    count = F.concat(1 + c % 7, F.lit(" – "), F.col("o_orderkey") % 3)
    outcome = F.when(form == 2, F.concat(F.lit("Failed: "), count)).when(form == 3, "MOTION WITHDRAWN").otherwise(F.concat(F.lit("Carried: "), count))
    page = F.concat(F.lit("MOTION\nMember "), c % 50, F.lit(" moved, seconded by Lee, "), said, F.lit("\nApproved:\nA, B\nand C\nDissented:\nNone\n"), outcome, F.lit("\nPage 3"))
    pages = read(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.lit(1).alias("page"), F.posexplode(F.split(page, "\n")).alias("line_no", "text"))
    return minutes.motions(pages).select("meeting_id", "ordinal", "mover", "result", "text", "yes", "no")


@R.add("""WITH m AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, o_custkey, o_orderkey % 3 AS form FROM orders),
d AS (SELECT o_custkey, max(ordinal) AS ordinal FROM m WHERE form < 2 GROUP BY o_custkey)
SELECT d.o_custkey AS meeting_id, CAST(d.ordinal AS INT) AS ordinal, CASE form WHEN 0 THEN 'passed' ELSE 'failed' END AS result FROM d JOIN m ON m.o_custkey = d.o_custkey AND m.ordinal = d.ordinal""")
def votes_of_items(spark: SparkSession, d: str) -> DataFrame:
    """[CX5, WN15, JN18] A customer's orders as motions on one ordinance: the last decided one is the item's vote."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    form = F.col("o_orderkey") % 3
    read_ = read(spark, d, "orders").select(F.col("o_custkey").alias("meeting_id"), place.alias("ordinal"), F.concat(F.lit("to approve ordinance 2026-54 as in "), F.col("o_orderkey")).alias("text"), F.when(form == 0, "passed").when(form == 1, "failed").otherwise("withdrawn").alias("result"), F.lit(None).cast("int").alias("yes"), F.lit(None).cast("int").alias("no"))
    items = read_.select("meeting_id", F.lit(0).alias("item_no"), F.lit("9.A").alias("number"), F.lit("O-2026-54, parking").alias("title")).distinct()
    return minutes.item_votes(read_, items).select("meeting_id", "ordinal", "result")


@R.add("""SELECT conv_id AS meeting_id, count(*) FILTER (turn > lo AND NOT (role = 'system')) AS handed FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND before <> 'system' GROUP BY conv_id HAVING count(*) FILTER (turn > lo AND NOT (role = 'system')) > 0""")
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    """[CX3, ST25, WN5, WN6] Turns as runs; each turn but the system's hands the floor on to its mayor: labels of each conversation's runs."""
    c = read(spark, d, "conversations")
    call = F.when(F.col("role") == "system", ">> quiet").otherwise(">> go on. Mayor")
    lines = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("line_id"), (F.col("turn") * 1000).alias("start_ms"), call.alias("text"))
    officials = c.select(F.col("conv_id").alias("meeting_id"), F.lit(1).alias("person_id"), F.lit("Ann Smith").alias("name")).distinct()
    holders = officials.select("meeting_id", F.lit("mayor").alias("kind"), "person_id")
    labels = speakers.label_runs(lines, officials, holders).where("method = 'seat'")
    runs_ = labels.join(lines.where("text <> '>> quiet'").select("meeting_id", "start_ms"), ["meeting_id", "start_ms"], "left_semi")
    return runs_.groupBy("meeting_id").agg(F.count("*").alias("handed"))


@R.add("""WITH t AS (SELECT conv_id * 1000 + turn AS answer_id, turn % 5 AS form FROM conversations)
SELECT answer_id, CASE form WHEN 0 THEN 'ok' WHEN 1 THEN 'no-handle' WHEN 2 THEN 'unknown-handle' WHEN 3 THEN 'number-not-in-evidence' ELSE 'quote-not-verbatim' END AS code FROM t""")
def ground_codes(spark: SparkSession, d: str) -> DataFrame:
    """[ST26, ST27, ST29] Sentences about each turn, checked against its words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "), r"(?i)\\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|(?:twen|thir|for|fif|six|seven|eigh|nine)ty)\\b", "x"))
    t = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), (F.col("turn") % 5).alias("form"), F.concat(F.lit("So it is. "), plain).alias("text"))
    said = F.when(F.col("form") == 0, 'They said "So it is." [E1].').when(F.col("form") == 1, "They said so.").when(F.col("form") == 2, "They said so [E2].").when(F.col("form") == 3, "They said so 987654 times [E1].").otherwise('They said "never, never" [E1].')
    evidence = t.select("answer_id", F.lit("[E1]").alias("handle"), F.lit("video").alias("kind"), "text", F.lit(None).cast("int").alias("yes"), F.lit(None).cast("int").alias("no"))
    return grounding.check_sentences(t.select("answer_id", said.alias("text")), evidence).select("answer_id", "code")


@R.add("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), e AS (
SELECT conv_id, 0 AS k, turn AS place, conv_id * 1000 + turn AS source_id FROM conversations UNION ALL SELECT page_id, 1, 0, page_id FROM pages UNION ALL SELECT item_id, 2, 0, item_id FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, place, source_id) AS n, count(*) OVER (PARTITION BY conv_id) AS whole FROM e)
SELECT conv_id AS meeting_id, '[E' || n || ']' AS handle, CASE k WHEN 0 THEN 'video' WHEN 1 THEN 'record' ELSE 'vote' END AS kind, source_id, greatest(0, whole - 4) AS dropped FROM r WHERE n <= 4""")
def evidence_packs(spark: SparkSession, d: str) -> DataFrame:
    """[ST31] Lines, pages and votes of one number as a pack of four, with what the cut dropped."""
    lines = read(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("place"), (F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), "text")
    pages = read(spark, d, "pages").select(F.col("page_id").alias("meeting_id"), F.lit(0).cast("long").alias("place"), F.col("page_id").alias("source_id"), F.col("html").alias("text"))
    votes = read(spark, d, "benchmark").select(F.col("item_id").alias("meeting_id"), F.lit(0).cast("long").alias("place"), F.col("item_id").alias("source_id"), "text")
    return grounding.evidence_pack(lines, pages, votes, 4).select("meeting_id", "handle", "kind", "source_id", "dropped")
