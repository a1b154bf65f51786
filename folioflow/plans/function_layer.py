"""Queries that apply single functions and state rules to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text, times
from folioflow.operators import search, state
from folioflow.plans.common import Registry, read
from folioflow.plans.text_layer import _WINDOWS

R = Registry()

NOW = "2025-01-01 00:00:00"


@R.add("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('france', 'kenya', 'peru', 'nation_3', 'nation_7')")
def case_blind_lookup(spark: SparkSession, d: str) -> DataFrame:
    """[FLT8] Names without regard to case."""
    return read(spark, d, "nation").where(F.lower("n_name").isin("france", "kenya", "peru", "nation_3", "nation_7")).select("n_nationkey", "n_name")


@R.add("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'provisional' WHEN value > 50 THEN 'settled under churn' ELSE 'settled' END AS state,
CASE WHEN value > 100 THEN 'length' WHEN user_id % 97 > 80 THEN 'size' END AS refusal FROM events""")
def state_words(spark: SparkSession, d: str) -> DataFrame:
    """[FLT11, FLT13]"""
    e = read(spark, d, "events")
    return e.select("event_id", times.state_word(F.col("event_type") == "click", F.col("value") > 50).alias("state"), times.refusal(F.col("value"), F.col("user_id") % 97, 100, 80).alias("refusal"))


@R.add("""SELECT o_orderkey, CASE WHEN b = 'live' THEN 'live' WHEN b = 'upcoming' THEN 'upcoming' WHEN b = 'none' AND s > 0 THEN 'finished'
  WHEN l = 'is_upcoming' THEN 'upcoming' WHEN l = 'is_live' THEN 'live' WHEN l IN ('was_live', 'not_live') THEN 'finished' ELSE 'unknown' END AS readiness
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'upcoming' WHEN 2 THEN 'none' WHEN 3 THEN 'strange' END AS b,
  CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 - 1 END AS s, CASE o_custkey % 4 WHEN 0 THEN 'post_live' WHEN 1 THEN 'was_live' WHEN 2 THEN 'is_live' END AS l FROM orders)""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """[FLT12]"""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    broadcast = word(k % 5, "live", "upcoming", "none", "strange", None)
    return read(spark, d, "orders").select("o_orderkey", times.readiness(broadcast, F.when(c % 3 > 0, c % 3 - 1), word(c % 4, "post_live", "was_live", "is_live", None)).alias("readiness"))


@R.add("""SELECT d.doc_id, d.source, l.quality, p.url FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id WHERE length(d.text) < 500""")
def gaps_with_titles(spark: SparkSession, d: str) -> DataFrame:
    """[JN14] Gaps with what two other tables say of them: one join each instead of a lookup a gap."""
    gaps = read(spark, d, "documents").where(F.length("text") < 500).select("doc_id", "source")
    pages = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return gaps.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(pages, "doc_id", "left")


@R.add("""WITH p AS (SELECT conv_id, turn, text, length(text) % 3 AS k FROM conversations),
t AS (SELECT *, trim(coalesce(text, '')) || CASE WHEN k = 0 THEN '-' WHEN k = 1 THEN ' 2' ELSE '' END AS piece FROM p),
u AS (SELECT *, CASE WHEN turn % 2 = 1 THEN 'th ' || piece ELSE piece END AS said FROM t),
w AS (SELECT conv_id, turn, said, lag(said) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u)
SELECT conv_id, md5(string_agg(CASE WHEN before IS NULL THEN said WHEN before LIKE '%-' OR (regexp_matches(before, '[0-9]$') AND regexp_matches(said, '^(st|nd|rd|th)\\b')) THEN said ELSE ' ' || said END, '' ORDER BY turn)) AS digest
FROM w GROUP BY conv_id""")
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """[AG15] A conversation's lines as one text; hyphens and ordinal endings join tight."""
    c = read(spark, d, "conversations")
    k = F.length("text") % 3
    piece = F.concat(F.trim(F.coalesce("text", F.lit(""))), F.when(k == 0, "-").when(k == 1, " 2").otherwise(""))
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("th "), piece)).otherwise(piece)
    listed = c.select("conv_id", F.struct("turn", said.alias("said")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select("conv_id", F.md5(text.join_lines(F.transform("xs", lambda x: x["said"]))).alias("digest"))


@R.add(f"WITH {_WINDOWS} SELECT transcript_id, last_id, CAST(span AS INT) AS span, first_pos, last_pos, md5(text) AS digest FROM windows WHERE transcript_id IN (SELECT conv_id FROM conversations WHERE length(text) > 500)")
def touched_windows(spark: SparkSession, d: str) -> DataFrame:
    """[WN3] Windows of the transcripts that changed (here: those with a line of over 500 signs), by a semi join; others aren't made anew."""
    lines = read(spark, d, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("id"), (F.col("turn") * 1000).alias("start_ms"), "text")
    changed = lines.where("length(text) > 500").select("transcript_id")
    return search.touched_windows(lines, changed).withColumn("digest", F.md5("text")).drop("text")


@R.add("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey + 7 * (1 + o_custkey % 3) AS b FROM orders), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT both_.b FROM reach JOIN both_ ON both_.a = reach.id) SELECT id FROM reach""")
def revision_group(spark: SparkSession, d: str) -> DataFrame:
    """[SO8] Everything that a chain of revisions reaches from one record."""
    k = F.col("o_custkey")
    edges = read(spark, d, "orders").select(k.alias("id"), (k + 7 * (1 + k % 3)).alias("previous_id")).distinct()
    return state.revision_group(edges, [1])


@R.add("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, w, len(w) AS n, list_transform(w, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))) AS f FROM t),
p AS (SELECT *, least(nullif(list_position(f, 'with'), 0), nullif(list_position(f, 'from'), 0)) AS first FROM f),
s AS (SELECT *, greatest(1, least(coalesce(first, 1) - 7, n - 11)) AS low FROM p)
SELECT doc_id, CASE WHEN low > 1 THEN ' ... ' ELSE '' END || array_to_string(w[low:low + 11], ' ') || CASE WHEN low + 12 <= n THEN ' ... ' ELSE '' END AS snippet FROM s""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """[FT8] Twelve words around the first match, more before it than after."""
    return read(spark, d, "documents").select("doc_id", search.snippet(F.col("text"), ["with", "from"]).alias("snippet"))


@R.add("""SELECT doc_id, md5(trim(regexp_replace(translate(text || ' “x” ‘y’', '‘’‚‛“”„‟', repeat(chr(39), 4) || repeat(chr(34), 4)), '[\\s ]+', ' ', 'g'))) AS straight,
md5(replace(replace(text, 'the', '***'), 'key', '***')) AS redacted, regexp_matches(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)') AS says FROM documents""")
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    """[ST2, ST28, ST32]"""
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(text.straighten(F.concat(t, F.lit(" “x” ‘y’")))).alias("straight"), F.md5(text.redact(t, ["key", "the"])).alias("redacted"), text.has_word(t, F.lit("license")).alias("says"))


@R.add("""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS plain,
'x' || chr(CAST(page_id % 500 + 200 AS INT)) || 'y' || chr(CAST(page_id % 90 + 33 AS INT)) || '&#;' AS numeric FROM pages WHERE NOT regexp_matches(html, '&(amp;)?#([0-9]+|[xX][0-9a-fA-F]+);')""")
def stripped_markup(spark: SparkSession, d: str) -> DataFrame:
    """[ST3] Pages without markup; numeric references of both kinds."""
    p = read(spark, d, "pages").where(~F.col("html").rlike("&(amp;)?#([0-9]+|[xX][0-9a-fA-F]+);"))
    n = F.concat(F.lit("x&#"), F.col("page_id") % 500 + 200, F.lit(";y&#x"), F.hex(F.col("page_id") % 90 + 33), F.lit(";&#;"))
    return p.select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("plain"), text.strip_markup(n).alias("numeric"))


_NUMBER = "(l_linenumber + l_partkey % 12) || CASE l_suppkey % 4 WHEN 0 THEN '.' WHEN 1 THEN '.a' WHEN 2 THEN '.B.0' || l_linenumber ELSE '' END"


@R.add(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_NUMBER} AS number, (1 + l_partkey % 12) || '.' AS section FROM lineitem),
p AS (SELECT *, list_transform(list_filter(regexp_split_to_array(trim(number), '[.\\s]+'), lambda y: y <> ''), lambda y: CASE WHEN regexp_matches(y, '^[0-9]+$') THEN CAST(CAST(y AS BIGINT) AS VARCHAR) ELSE upper(y) END) AS parts,
  CAST(CAST(replace(section, '.', '') AS BIGINT) AS VARCHAR) AS head FROM x)
SELECT l_orderkey, l_linenumber, array_to_string(parts, '/') AS parts, lower(regexp_replace(number, '[^A-Za-z0-9]', '', 'g')) AS key, len(parts) > 1 AND parts[1] = head AS under FROM p""")
def item_numbers(spark: SparkSession, d: str) -> DataFrame:
    """[ST10, ST11]"""
    x = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_NUMBER} AS number", "(1 + l_partkey % 12) || '.' AS section")
    n = F.col("number")
    return x.select("l_orderkey", "l_linenumber", F.array_join(text.number_parts(n), "/").alias("parts"), text.number_key(n).alias("key"), text.is_under(n, F.col("section")).alias("under"))


#: The kinds that part types name, in the order in which they are looked for.
KINDS = {"promo": "special", "small": "study", "standard": "regular", "economy": "work", "brass": "executive"}


@R.add("""SELECT p_partkey, CASE WHEN contains(t, 'promo') THEN 'special' WHEN contains(t, 'small') THEN 'study' WHEN contains(t, 'standard') THEN 'regular'
WHEN contains(t, 'economy') THEN 'work' WHEN contains(t, 'brass') THEN 'executive' ELSE 'regular' END AS kind FROM (SELECT p_partkey, lower(p_type) AS t FROM part)""")
def record_kinds(spark: SparkSession, d: str) -> DataFrame:
    """[ST17]"""
    return read(spark, d, "part").select("p_partkey", text.first_needle(F.col("p_type"), KINDS, "regular").alias("kind"))


@R.add("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text || chr(10) || 'Page ' || (doc_id % 40) || '  ' || chr(10) || 'page  7' || chr(10) || 'Page 9 of 10', '(?im)^Page[ \\t]+(\\d+)[ \\t]*$', 1), lambda n: CAST(CAST(n AS INT) AS VARCHAR)), ',') AS footers FROM documents""")
def footers(spark: SparkSession, d: str) -> DataFrame:
    """[ST21]"""
    page = F.concat(F.col("text"), F.lit("\nPage "), F.col("doc_id") % 40, F.lit("  \npage  7\nPage 9 of 10"))
    return read(spark, d, "documents").select("doc_id", F.array_join(text.footer_numbers(page), ",").alias("footers"))


@R.add("""WITH v AS (SELECT p_partkey, (2020 + p_size % 7) || '.0' || (p_size % 9) || CASE WHEN p_partkey % 5 = 0 THEN '.beta' WHEN p_partkey % 7 = 0 THEN '.1' ELSE '' END AS v FROM part),
k AS (SELECT p_partkey, list_transform(string_split(regexp_extract(v, '^(\\d+(\\.\\d+)*)', 1), '.'), lambda x: CAST(x AS BIGINT)) AS k FROM v)
SELECT p_partkey, array_to_string(k, '.') AS key, k > [2023, 4] AS newer FROM k""")
def versions(spark: SparkSession, d: str) -> DataFrame:
    """[ST33]"""
    v = F.expr("(2020 + p_size % 7) || '.0' || (p_size % 9) || CASE WHEN p_partkey % 5 = 0 THEN '.beta' WHEN p_partkey % 7 = 0 THEN '.1' ELSE '' END")
    return read(spark, d, "part").select("p_partkey", F.array_join(text.version_key(v), ".").alias("key"), text.is_newer(v, F.lit("2023.04")).alias("newer"))


_TITLE = "CASE o_orderkey % 4 WHEN 0 THEN 'Council ' || {long} WHEN 1 THEN 'Board - ' || {turned} || ' study' WHEN 2 THEN 'Meeting ' || CASE WHEN year(o_orderdate) < 2000 THEN {long} ELSE {short} || ' and ' || {short} END ELSE 'From ' || {long} || ' to January 1, 2001' END"


@R.add(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 OR CAST(o_orderdate AS DATE) = DATE '2001-01-01' THEN CAST(o_orderdate AS DATE) END AS day,
{_TITLE.format(long="strftime(o_orderdate, '%B %-d, %Y')", turned="strftime(o_orderdate, '%-d %B %Y')", short="strftime(o_orderdate, '%-m/%-d/%y')")} AS title FROM orders""")
def title_days(spark: SparkSession, d: str) -> DataFrame:
    """[DT4] The one day that a title names in any of three forms."""
    day = lambda form: f"date_format(o_orderdate, '{form}')"
    titled = F.expr(_TITLE.format(long=day("MMMM d, yyyy"), turned=day("d MMMM yyyy"), short=day("M/d/yy")))
    return read(spark, d, "orders").select("o_orderkey", times.title_day(titled).alias("day"), titled.alias("title"))


@R.add("""SELECT l_orderkey, l_linenumber, s AS seconds, CASE WHEN l_linenumber > 6 THEN NULL ELSE s END AS iso_seconds, s * 1000 + l_partkey % 1000 AS clock_ms,
CASE WHEN s // 3600 > 0 AND s // 60 % 60 > 0 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s // 3600 > 0 THEN (s // 3600) || 'h' ELSE (s // 60) || 'm' END AS spoken,
CASE WHEN l_linenumber > 6 THEN 3600.0 ELSE s * 1.5 + 600 END AS timeout, least(30.0 * pow(2, greatest(0, l_linenumber - 1)), 600.0) AS wait
FROM (SELECT *, l_suppkey * 61 % 20000 AS s FROM lineitem)""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """[DT5, DT7, DT11, DT12, DT17]"""
    x = read(spark, d, "lineitem").withColumn("s", F.col("l_suppkey") * 61 % 20000)
    s, known = F.col("s"), F.col("l_linenumber") <= 6
    iso = F.when(known, F.format_string("PT%dH%dM%dS", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise("P1Y")
    at = F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.col("l_partkey") % 1000)
    wait = times.backoff_seconds(F.col("l_linenumber"), 30.0, 600.0)
    return x.select("l_orderkey", "l_linenumber", s.alias("seconds"), times.iso_seconds(iso).alias("iso_seconds"), times.clock_ms(at).alias("clock_ms"), times.spoken_duration(s).alias("spoken"), times.transcription_timeout(F.when(known, s)).alias("timeout"), wait.alias("wait"))


@R.add("""WITH u AS (SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS day, event_id, ts FROM events),
spent AS (SELECT day, event_id, ts, count(*) OVER (PARTITION BY day ORDER BY ts, event_id) AS used FROM u)
SELECT event_id, used, used > 20 AS blocked, CASE WHEN used > 20 THEN epoch_us(timezone('America/Los_Angeles', CAST(day + 1 AS TIMESTAMP))) // 1000000 END AS until FROM spent""")
def quota_days(spark: SparkSession, d: str) -> DataFrame:
    """[DT9, DT19] Units used in each Pacific day; over the limit, the block ends at the next Pacific midnight."""
    return state.quota(read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")), "at", ["event_id"], 20)


@R.add(f"""WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS state, o_orderpriority AS kind, o_custkey % 50 AS payload, 0 AS attempts,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS run_after, o_orderdate AS heartbeat FROM orders)
SELECT id, CASE WHEN state = 'running' THEN 'stale' ELSE 'due' END AS why, CASE WHEN state = 'running' THEN attempts + 1 ELSE attempts END AS attempts FROM j
WHERE state = 'queued' AND (run_after IS NULL OR run_after <= TIMESTAMP '2001-01-01') OR state = 'running' AND heartbeat < TIMESTAMP '2001-01-01' - INTERVAL 300 SECOND""")
def jobs_to_start(spark: SparkSession, d: str) -> DataFrame:
    """[FLT9, SM1, SM2] Jobs that are due, and those whose heartbeat has stopped."""
    jobs, now = _jobs(spark, d), F.lit("2001-01-01").cast("timestamp")
    late = state.stale(jobs.withColumn("heartbeat", F.unix_micros("heartbeat")), F.unix_micros(now), 300_000_000)
    return state.due(jobs, now).select("id", F.lit("due").alias("why"), "attempts").union(late.select("id", F.lit("stale"), "attempts"))


@R.add("""WITH j AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS state, o_orderpriority AS kind, o_custkey AS payload FROM orders WHERE o_totalprice > 300000)
SELECT DISTINCT kind, payload FROM (SELECT o_orderpriority AS kind, o_custkey AS payload FROM orders) w
WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.kind = w.kind AND j.payload = w.payload AND j.state IN ('queued', 'running'))""")
def requests_to_add(spark: SparkSession, d: str) -> DataFrame:
    """[CX19] Requests without an active job of the same kind and payload."""
    jobs = _jobs(spark, d).withColumn("payload", F.col("customer"))
    return state.new_requests(jobs.select("kind", "payload").distinct(), jobs.where("price > 300000"))


@R.add("""WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS state, o_orderpriority AS kind FROM orders),
busy AS (SELECT kind, count(*) AS n FROM j WHERE state = 'running' GROUP BY kind)
SELECT min(id) AS id FROM j WHERE state = 'queued' AND kind IN (SELECT kind FROM busy WHERE n < (SELECT avg(n) FROM busy))""")
def next_startable(spark: SparkSession, d: str) -> DataFrame:
    """[SL5] The oldest queued job of a kind that isn't full (as many as the mean running)."""
    jobs = _jobs(spark, d)
    busy = jobs.where("state = 'running'").groupBy("kind").agg(F.count("*").alias("n"))
    free = busy.join(busy.agg(F.avg("n").alias("most")), F.col("n") < F.col("most")).select("kind")
    return jobs.where("state = 'queued'").join(free, "kind", "left_semi").agg(F.min("id").alias("id"))


@R.add("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL ELSE v END AS video, CASE page_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'handle' WHEN 2 THEN 'user' ELSE 'url' END AS kind,
CASE page_id % 4 WHEN 0 THEN 'UC' || v || v WHEN 3 THEN url ELSE 'name' || page_id END AS value FROM (SELECT page_id, url, substr(md5(url), 1, 11) AS v FROM pages WHERE NOT contains(url, 'youtu'))""")
def video_addresses(spark: SparkSession, d: str) -> DataFrame:
    """[ST19, ST20] Video ids and channels in all forms of address."""
    p = read(spark, d, "pages").where(~F.col("url").contains("youtu")).withColumn("v", F.substring(F.md5("url"), 1, 11))
    v, k = F.col("v"), F.col("page_id")
    address = F.when(k % 5 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), v)).when(k % 5 == 1, F.concat(F.lit("youtu.be/"), v, F.lit("?x=1"))).when(k % 5 == 2, F.concat(F.lit("https://m.youtube.com/live/"), v, F.lit("/a"))).when(k % 5 == 3, F.concat(F.lit("http://youtube.com/Embed/"), v)).otherwise(F.concat(F.lit("https://notyoutube.com/watch?v="), v))
    home = F.lit("https://www.youtube.com/")
    origin = F.when(k % 4 == 0, F.concat(home, F.lit("channel/UC"), v, v)).when(k % 4 == 1, F.concat(home, F.lit("@name"), k)).when(k % 4 == 2, F.concat(home, F.lit("user/name"), k)).otherwise(F.col("url"))
    return p.select("page_id", text.video_id(address).alias("video"), text.channel_of(origin).alias("c")).select("page_id", "video", "c.kind", "c.value")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    state_ = F.when(k % 3 == 0, "queued").when(k % 3 == 1, "running").otherwise("done")
    return read(spark, d, "orders").select(k.alias("id"), state_.alias("state"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 50).alias("payload"), F.lit(0).alias("attempts"), F.when(k % 2 == 0, at).alias("run_after"), at.alias("heartbeat"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
