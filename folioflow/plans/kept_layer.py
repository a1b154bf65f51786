"""Queries over what is kept: a full-text index, a store of files, saved answers; and the resolution of observations to rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import closure, minutes, portal, reports, resolution, search, text_index
from folioflow.plans import text_layer
from folioflow.plans.common import Registry, read
from folioflow.sources import answers, store
from folioflow.sources.cuts import Cuts, shared_dir

R = Registry()
_INDEXES: dict[tuple[str, str, str], text_index.TextIndex] = {}


def _index(spark: SparkSession, d: str, name: str) -> text_index.TextIndex:
    """The index of the documents or of the windows of lines, built at its first use in an application and kept."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/{key[0]}/index-{name}-{hashlib.md5(d.encode()).hexdigest()}"
        if name == "documents":
            _INDEXES[key] = text_index.build(read(spark, d, "documents").select("doc_id", "text", "lang"), ["doc_id"], path, ["lang"])
        else:
            _INDEXES[key] = text_index.index_lines(text_layer._lines(spark, d), path)
    return _INDEXES[key]


@R.add(text_layer.R.oracles["bm25_topk_docs"])
def indexed_topk_docs(spark: SparkSession, d: str) -> DataFrame:
    """[FT1, FT7, FT9, SL1] The answers of bm25_topk_docs, from postings taken by their bounds."""
    return _index(spark, d, "documents").top(["with", "from"], 50).select("doc_id", "score")


@R.add(text_layer.R.oracles["search_and_match"])
def indexed_and_match(spark: SparkSession, d: str) -> DataFrame:
    """[FT1, FT5] The answers of search_and_match, from postings."""
    return _index(spark, d, "documents").matching(search.query_terms("the OF")).select("doc_id")


@R.add(text_layer.R.oracles["search_phrase_match"])
def indexed_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """[FT2, FT3, FT6] The answers of search_phrase_match, from the places in postings of windows."""
    return _index(spark, d, "windows").phrase(["of", "the"]).select("transcript_id", "last_id", "span")


@R.add(f"WITH RECURSIVE {text_layer.line_search_sql(['to', 'on'], 30, 'transcript_id % 3 <> 0')} {text_layer.LINE_HITS}")
def indexed_line_search(spark: SparkSession, d: str) -> DataFrame:
    """[FT3, FT10, SL7] Windows of the transcripts that count, one a mention, from postings."""
    area = text_layer._lines(spark, d).select("transcript_id").where("transcript_id % 3 <> 0")
    return text_index.search_lines(_index(spark, d, "windows"), "to on", 30, area)


_SEEN = """o AS (SELECT o_orderkey AS arrival, o_orderkey % 10 = 0 AS is_stored, o_custkey % 5 AS body_id, strftime(o_orderdate, '%Y-%m') AS starts_at, o_orderpriority AS title, o_orderstatus AS type,
  o_totalprice > 450000 AS is_cancelled, o_totalprice < 20000 AS is_continued, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END AS src,
  CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE o_custkey % 700 END AS pid, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 90 END AS template_id FROM orders)"""


@R.add(f"""WITH {_SEEN},
fixed AS (SELECT *, row_number() OVER (PARTITION BY src, pid ORDER BY arrival) AS n FROM o WHERE is_stored), st AS (SELECT * FROM fixed WHERE src IS NULL OR pid IS NULL OR n = 1),
ob AS (SELECT o.*, k.arrival AS known FROM o LEFT JOIN st k ON k.src = o.src AND k.pid = o.pid WHERE NOT o.is_stored),
ev AS (SELECT min(arrival) AS arrival, arg_min(body_id, arrival) AS body_id, arg_min(starts_at, arrival) AS starts_at, true AS claims, 'p|' || src || '|' || pid AS own FROM ob WHERE src IS NOT NULL AND pid IS NOT NULL AND known IS NULL GROUP BY src, pid
  UNION ALL SELECT arrival, body_id, starts_at, NOT (src IS NULL AND pid IS NULL), 'o|' || arrival FROM ob WHERE src IS NULL OR pid IS NULL),
un AS (SELECT body_id, starts_at, count(*) AS n_open, min(arrival) AS open_id FROM st WHERE src IS NULL AND pid IS NULL GROUP BY ALL),
pl AS (SELECT ev.*, coalesce(n_open, 0) AS n_open, open_id, lag(claims) OVER w AS before, coalesce(sum(claims::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS turn
  FROM ev LEFT JOIN un USING (body_id, starts_at) WINDOW w AS (PARTITION BY body_id, starts_at ORDER BY arrival)),
de AS (SELECT own, CASE WHEN n_open >= 2 OR (claims AND NOT coalesce(NOT before, n_open = 1)) THEN own WHEN turn = 0 AND n_open = 1 THEN 's|' || open_id ELSE 'k|' || body_id || '|' || starts_at || '|' || turn END AS "row" FROM pl),
al AS (SELECT 's|' || arrival AS "row", arrival AS id, -1 AS moment, * EXCLUDE (arrival, is_stored, n) FROM st
  UNION ALL SELECT coalesce(de."row", 's|' || known), NULL, arrival, * EXCLUDE (arrival, is_stored, known, own, "row") FROM (SELECT *, CASE WHEN src IS NOT NULL AND pid IS NOT NULL THEN 'p|' || src || '|' || pid ELSE 'o|' || arrival END AS own FROM ob) q LEFT JOIN de ON de.own = q.own)
SELECT "row", max(id) AS id, max(id) IS NULL AS created, count(*) FILTER (moment >= 0) AS n_seen, arg_min(body_id, moment) AS body_id, arg_max(starts_at, moment) AS starts_at, arg_max(title, moment) AS title, arg_max(type, moment) AS type,
 bool_or(is_cancelled) AS is_cancelled, bool_or(is_continued) AS is_continued, arg_max(src, moment) FILTER (src IS NOT NULL) AS portal_source_id, arg_max(pid, moment) FILTER (pid IS NOT NULL) AS portal_meeting_id, arg_max(template_id, moment) FILTER (template_id IS NOT NULL) AS template_id FROM al GROUP BY "row" """)
def meeting_resolution(spark: SparkSession, d: str) -> DataFrame:
    """[CX12, AG12, AG13] Orders as listings of sittings, a tenth of them stored already: claims by a portal's id, by body and month, or new rows."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(
        k.alias("arrival"), (F.col("o_custkey") % 5).alias("body_id"), F.date_format("o_orderdate", "yyyy-MM").alias("starts_at"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("type"),
        (F.col("o_totalprice") > 450000).alias("is_cancelled"), (F.col("o_totalprice") < 20000).alias("is_continued"), F.when(k % 7 != 0, 1 + k % 2).alias("portal_source_id"),
        F.when(k % 7 >= 3, F.col("o_custkey") % 700).alias("portal_meeting_id"), F.when(k % 4 == 0, F.col("o_custkey") % 90).alias("template_id"),
    )
    held = o.where("arrival % 10 = 0")
    ids = ["portal_source_id", "portal_meeting_id"]
    twice = held.where("portal_source_id is not null and portal_meeting_id is not null").groupBy(*ids).agg(F.min("arrival").alias("first"))
    stored = held.join(twice, ids, "left").where("first is null or first = arrival").drop("first").withColumnRenamed("arrival", "id")
    return resolution.resolve_meetings(stored, o.where("arrival % 10 <> 0"))


@R.add("""WITH v AS (SELECT event_id AS k, event_id % 3 AS source_id, 'v' || (user_id * 7 + event_id % 11) AS platform_id, CASE WHEN value > 40 THEN event_id % 500 END AS meeting_id, event_type = 'view' AS is_primary,
  event_type AS title, CASE WHEN event_id % 5 < 2 THEN 'u' || event_id % 9 END AS url, CASE event_type WHEN 'click' THEN 'unknown' ELSE event_type END AS readiness FROM events),
st AS (SELECT * FROM v WHERE k % 4 = 0), ls AS (SELECT * FROM v WHERE k % 4 <> 0),
se AS (SELECT ls.*, coalesce((SELECT min(k) FROM st WHERE st.platform_id = ls.platform_id AND st.source_id = ls.source_id), (SELECT min(k) FROM st WHERE st.platform_id = ls.platform_id)) AS id FROM ls),
al AS (SELECT 's|' || k AS "row", k AS id, -1 AS moment, source_id, platform_id, meeting_id, is_primary, title, url, readiness FROM st
  UNION ALL SELECT coalesce('s|' || id, 'v|' || platform_id), id, k, source_id, platform_id, meeting_id, false, title, url, readiness FROM se),
me AS (SELECT "row", max(id) AS id, count(*) FILTER (moment >= 0) AS n_seen, bool_or(is_primary) AS was_primary, min(moment) < 0 AS was, arg_min(source_id, moment) AS source_id, arg_min(platform_id, moment) AS platform_id, arg_min(title, moment) AS title,
  arg_min(coalesce(url, '-'), moment) AS own_url, arg_min(url, moment) FILTER (url IS NOT NULL AND (moment < 0 OR meeting_id IS NOT NULL)) AS attached_url, arg_min(meeting_id, moment) FILTER (meeting_id IS NOT NULL) AS meeting_id,
  arg_min(readiness, moment) FILTER (readiness <> 'unknown') AS sure, arg_min(readiness, moment) AS first_readiness FROM al GROUP BY "row"),
ch AS (SELECT arg_min(al."row", moment) AS "row" FROM al JOIN me ON me."row" = al."row" AND me.meeting_id = al.meeting_id WHERE moment >= 0 AND al.meeting_id NOT IN (SELECT meeting_id FROM st WHERE is_primary AND meeting_id IS NOT NULL) GROUP BY al.meeting_id)
SELECT "row", id, id IS NULL AS created, n_seen, source_id, platform_id, meeting_id, was_primary OR "row" IN (SELECT "row" FROM ch) AS is_primary, title,
 CASE WHEN was THEN attached_url ELSE coalesce(nullif(own_url, '-'), attached_url) END AS url, coalesce(sure, first_readiness) AS readiness FROM me""")
def video_adoption(spark: SparkSession, d: str) -> DataFrame:
    """[CX16] Events as listings of videos by three sources, a quarter of them stored already."""
    k = F.col("event_id")
    v = read(spark, d, "events").select(
        k.alias("k"), (k % 3).alias("source_id"), F.concat(F.lit("v"), F.col("user_id") * 7 + k % 11).alias("platform_id"), F.when(F.col("value") > 40, k % 500).alias("meeting_id"), (F.col("event_type") == "view").alias("is_primary"),
        F.col("event_type").alias("title"), F.when(k % 5 < 2, F.concat(F.lit("u"), k % 9)).alias("url"), F.when(F.col("event_type") == "click", "unknown").otherwise(F.col("event_type")).alias("readiness"),
    )
    stored = v.where("k % 4 = 0").withColumnRenamed("k", "id")
    return resolution.adopt_videos(stored, v.where("k % 4 <> 0").withColumnRenamed("k", "arrival").drop("is_primary"))


@R.add("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey + 7 * (1 + o_custkey % 3) AS b FROM orders WHERE o_custkey % 11 <> 0), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON both_.a = reach.other) SELECT node, min(other) AS component FROM reach GROUP BY node""")
def chain_components(spark: SparkSession, d: str) -> DataFrame:
    """[SO8] All chains of revisions at once, each by its smallest record."""
    k = F.col("o_custkey")
    return closure.components(read(spark, d, "orders").where("o_custkey % 11 <> 0").select(k.alias("a"), (k + 7 * (1 + k % 3)).alias("b")).distinct())


def _stored_pages(spark: SparkSession, d: str, cuts: Cuts, where: str) -> DataFrame:
    pages = read(spark, d, "pages").where(where).select(F.lit("page").alias("kind"), F.lit("html").alias("ext"), F.encode(F.col("html"), "UTF-8").alias("data"))
    return store.store(pages, f"{cuts.folder}/files", f"{cuts.folder}/rows")


@R.add("""SELECT DISTINCT 'page' AS kind, sha256(html) AS sha256, 'page-' || sha256(html) || '.html' AS rel_path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE html IS NOT NULL""")
def stored_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """[SRC17] Pages as files named by their content, in two runs that overlap: each once."""
    cuts = Cuts(spark, "store")
    _stored_pages(spark, d, cuts, "page_id % 3 <> 0")
    return _stored_pages(spark, d, cuts, "page_id % 3 <> 1")


@R.add("""WITH f AS (SELECT DISTINCT sha256(html) AS sha FROM pages WHERE page_id % 2 = 0 AND html IS NOT NULL), r AS (SELECT DISTINCT sha256(html) AS sha FROM pages WHERE page_id % 3 = 0 AND html IS NOT NULL)
SELECT CASE WHEN f.sha IS NULL THEN 'missing' ELSE 'unrecorded' END AS finding, 'page-' || coalesce(f.sha, r.sha) || '.html' AS rel_path, coalesce(r.sha, f.sha) AS told, f.sha AS found FROM f FULL JOIN r ON f.sha = r.sha WHERE f.sha IS NULL OR r.sha IS NULL""")
def store_findings(spark: SparkSession, d: str) -> DataFrame:
    """[SRC18] Files of some pages against rows of others."""
    cuts = Cuts(spark, "store")
    _stored_pages(spark, d, cuts, "page_id % 2 = 0")
    rows = read(spark, d, "pages").where("page_id % 3 = 0 and html is not null").select(F.sha2("html", 256).alias("sha256")).distinct()
    return store.reconcile(rows.withColumn("rel_path", F.concat(F.lit("page-"), F.col("sha256"), F.lit(".html"))), f"{cuts.folder}/files")


@R.add("""SELECT page_id, page_id % 2 = 0 OR sha256(html) IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0) AS verified FROM pages WHERE html IS NOT NULL""")
def verified_citations(spark: SparkSession, d: str) -> DataFrame:
    """[DT14] Citations of pages, of which half are stored, against the files' own digests."""
    cuts = Cuts(spark, "store")
    rows = _stored_pages(spark, d, cuts, "page_id % 2 = 0")
    cited = read(spark, d, "pages").where("html is not null").select("page_id", F.lit("page").alias("kind"), F.sha2("html", 256).alias("sha256"))
    return store.verified(cited, rows, f"{cuts.folder}/files").select("page_id", "verified")


def _saved_orders(spark: SparkSession, d: str) -> str:
    """Orders as saved answers of three portals, pages of at most 500 keys, each as a file."""
    doc = F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("templateId"))
    docs = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(doc).alias("documentList"))
    entry = F.struct((F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("id"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("dateTime"), F.col("o_orderpriority").alias("title"), "documentList")
    lists = read(spark, d, "orders").join(docs, "o_orderkey").groupBy((F.col("o_orderkey") % 3).alias("site"), F.floor(F.col("o_orderkey") / 500).alias("page")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value"))
    path = f"{Cuts(spark, 'answers').folder}/saved"
    lists.repartition("site", "page").select("site", "value").write.option("maxRecordsPerFile", 1).partitionBy("site").text(path)
    return path


@R.add("""WITH o AS (SELECT o_orderkey % 3 AS site, o_orderkey - o_orderkey % 2 AS id, count(*) FILTER (l_returnflag <> 'R') AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey)
SELECT site, id AS meeting_id, n AS documents FROM o""")
def adapter_meetings(spark: SparkSession, d: str) -> DataFrame:
    """[UD2, SRC7] Meetings of three portals' saved answers, with how many documents each has."""
    found = answers.listed_meetings(spark, _saved_orders(spark, d))
    return found.select(F.col("site").cast("long").alias("site"), "meeting_id", F.size("documents").cast("long").alias("documents"))


@R.add("""SELECT o_orderkey % 3 AS site, true AS ok, count(DISTINCT o_orderkey) AS meetings FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey % 3""")
def adapter_health(spark: SparkSession, d: str) -> DataFrame:
    """[UD2] What each portal's saved answers hold."""
    health = answers.answers(spark, _saved_orders(spark, d), "health")
    return health.groupBy(F.col("site").cast("long").alias("site")).agg(F.min("ok").alias("ok"), F.sum("meetings_found").alias("meetings"))


@R.add("""WITH o AS (SELECT o_orderkey % 20 AS meeting_id, o_custkey % 60 AS who, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS rank FROM orders WHERE o_custkey % 60 < 40),
m AS (SELECT DISTINCT meeting_id FROM (SELECT o_orderkey % 20 AS meeting_id FROM orders)), p AS (SELECT unnest(range(60)) AS who), b AS (SELECT meeting_id, who, max(rank) AS rank FROM o GROUP BY ALL)
SELECT m.meeting_id, 'Ann Q' || p.who AS name, CASE b.rank WHEN 3 THEN 'Mayor' WHEN 2 THEN 'Mayor Pro Tem' ELSE 'Council Member' END AS office FROM m CROSS JOIN p LEFT JOIN b ON b.meeting_id = m.meeting_id AND b.who = p.who""")
def printed_offices(spark: SparkSession, d: str) -> DataFrame:
    """[ST23] Orders as lines of minutes that print offices before full names or last words of names."""
    k, who = F.col("o_orderkey"), F.col("o_custkey") % 60
    form = F.element_at(F.array(*map(F.lit, ("Mayor", "mayor pro  tem", "Councilwoman", "Council Member", "the major"))), (k % 5 + 1).cast("int"))
    line = F.concat(F.lit("Then "), form, F.lit(" "), F.when(k % 2 == 0, "Ann Q").otherwise("Q"), who, F.lit(", noted it"))
    o = read(spark, d, "orders")
    people = o.select((k % 20).alias("meeting_id")).distinct().select("meeting_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda w: F.concat(F.lit("Ann Q"), w))).alias("name"))
    return minutes.printed_offices(o.where(who < 40).select((k % 20).alias("meeting_id"), line.alias("text")), people)


@R.add("""WITH m AS (SELECT o_orderkey AS meeting_id, o_custkey % 40 AS body_id, o_orderdate::DATE AS day, CASE o_orderkey % 3 WHEN 0 THEN 'study' WHEN 1 THEN 'special' ELSE 'regular' END AS kind FROM orders),
v AS (SELECT event_id, user_id % 40 AS body_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (DATE '1995-01-01' + CAST(event_id * 7 % 2400 AS INT)) END AS day, event_id % 4 = 3 AS free, CASE event_id % 4 WHEN 0 THEN 'study' WHEN 1 THEN 'special' ELSE 'regular' END AS kind FROM events),
j AS (SELECT event_id, v.day, free, meeting_id, m.day = v.day AS same, m.kind = v.kind AS alike FROM v LEFT JOIN m ON m.body_id = v.body_id AND abs(date_diff('day', m.day, v.day)) <= 1),
n AS (SELECT event_id, any_value(day) AS day, [list(meeting_id) FILTER (same AND alike), list(meeting_id) FILTER (same AND free), list(meeting_id) FILTER (alike), list(meeting_id) FILTER (free AND meeting_id IS NOT NULL)] AS steps FROM j GROUP BY event_id),
f AS (SELECT event_id, day, list_filter(steps, lambda s: s IS NOT NULL AND len(s) > 0)[1] AS s FROM n)
SELECT event_id AS video_id, CASE WHEN len(s) = 1 THEN s[1] END AS meeting_id, CASE WHEN day IS NULL THEN 'no day' WHEN len(s) = 1 THEN 'linked' WHEN s IS NULL THEN 'none' ELSE 'several' END AS reason FROM f""")
def video_meetings(spark: SparkSession, d: str) -> DataFrame:
    """[JN16, ST17, DT4] Events as videos of bodies' sittings, orders as the sittings: by day and kind, one or none."""
    k, e = F.col("o_orderkey"), F.col("event_id")
    kind = lambda n, *titles: F.element_at(F.array(*map(F.lit, titles)), (n + 1).cast("int"))
    meetings = read(spark, d, "orders").select(k.alias("meeting_id"), (F.col("o_custkey") % 40).alias("body_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("starts_at"), kind(k % 3, "Study Session", "Joint Meeting", "Council Regular Session").alias("title"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (e * 7 % 2400).cast("int"))
    named = F.concat(kind(e % 4, "Workshop", "Special", "Regular Session", "Council"), F.when(e % 3 == 0, F.date_format(day, " MMMM d, yyyy")).otherwise(""))
    title = F.when(e % 10 == 0, kind(e % 4, "Workshop", "Special", "Regular Session", "Council")).otherwise(named)
    published = F.when(e % 10 == 0, None).when(e % 3 == 0, "2001-01-01").when(e % 3 == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy-MM-dd'T'01:02:03'Z'"))
    videos = read(spark, d, "events").select(e.alias("video_id"), (F.col("user_id") % 40).alias("body_id"), title.alias("title"), published.alias("published"))
    return portal.link_videos(videos, meetings)


@R.add("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 25 AS body_id, o_orderdate AS took, CASE o_orderstatus WHEN 'P' THEN 'P' WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' END AS state FROM orders WHERE o_custkey % 25 <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY body_id ORDER BY took DESC, id DESC) AS n FROM c)
SELECT n_nationkey AS body_id, n_name AS body, count(id) AS videos, count(*) FILTER (state = 'P') AS pending, count(*) FILTER (state = 'F') AS failed, max(id) FILTER (n = 1) AS last_video, max(state) FILTER (n = 1) AS last_state,
 strftime(max(took) FILTER (n = 1), '%Y-%m-%d') AS last_at, bool_or(t.p) FILTER (n = 1) AS last_is_provisional FROM nation LEFT JOIN r ON r.body_id = n_nationkey
 LEFT JOIN (SELECT l_orderkey, arg_min(l_tax > 0.04, (l_tax > 0.04)::BIGINT * 1000000000 - (l_linenumber * 1000000 + l_partkey)) AS p FROM lineitem GROUP BY l_orderkey) t ON t.l_orderkey = r.id GROUP BY n_nationkey, n_name""")
def capture_health(spark: SparkSession, d: str) -> DataFrame:
    """[CX8, AG4, WN1, JN9] Nations as bodies, orders as their videos, lines as transcripts: counts, and how the newest capture went."""
    k = F.col("o_orderkey")
    videos = read(spark, d, "orders").where("o_custkey % 25 <> 3").select(k.alias("video_id"), (F.col("o_custkey") % 25).alias("body_id"), F.col("o_orderdate").alias("captured_at"), F.element_at(F.create_map(*[F.lit(x) for x in ("P", "pending", "F", "failed", "O", "captions")]), F.col("o_orderstatus")).alias("capture_state"))
    transcripts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("transcript_id"), (F.col("l_tax") > 0.04).alias("is_provisional"), F.lit(False).alias("settled_under_churn"))
    bodies = read(spark, d, "nation").select(F.col("n_nationkey").alias("body_id"), F.col("n_name").alias("body"))
    got = reports.capture_health(bodies, videos, transcripts)
    word = F.element_at(F.create_map(*[F.lit(x) for x in ("pending", "P", "failed", "F", "captions", "O")]), F.col("last_state"))
    return got.select("body_id", "body", "videos", "pending", "failed", "last_video", word.alias("last_state"), F.date_format("last_at", "yyyy-MM-dd").alias("last_at"), "last_is_provisional")


@R.add("""WITH l AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS items, count(DISTINCT l_suppkey) AS docs FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS meeting_id, (o_orderkey % 5 + 1)::BIGINT AS revision, coalesce(len(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE items END), 0)::BIGINT AS n_items, coalesce(docs, 0) AS n_documents,
 CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_videos, list_filter([CASE WHEN o_orderkey % 4 = 0 OR items IS NULL THEN 'no agenda item is known' END, CASE WHEN docs IS NULL THEN 'no document is stored' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'no video is linked' END,
 CASE WHEN o_orderkey % 4 = 0 OR items IS NULL OR o_orderkey % 2 = 1 THEN 'no vote is recorded' END], lambda x: x IS NOT NULL) AS notes, o_orderkey AS first_key FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def meeting_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """[CX9, SRC22, JN20] Orders as meetings, lines as items and votes, suppliers as documents: one JSON document a meeting, versioned, with notes on what is lacking."""
    k = F.col("o_orderkey")
    o, lines = read(spark, d, "orders"), read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "meeting_id")
    meetings = o.select(k.alias("meeting_id"), F.col("o_orderpriority").alias("title"), (k % 5 + 1).alias("revision"))
    items = lines.where("meeting_id % 4 <> 0").select("meeting_id", F.col("l_linenumber").alias("item_no"), F.concat(F.lit("item "), "l_linenumber").alias("title")).distinct()
    docs = lines.select("meeting_id", F.col("l_suppkey").alias("document_id")).distinct()
    videos = o.where(k % 3 == 0).select(k.alias("meeting_id"), (k * 10).alias("video_id"))
    votes = items.where("meeting_id % 2 = 0").select("meeting_id", "item_no", F.lit("passed").alias("result"))
    got = reports.snapshots(meetings, {"items": (items, ["item_no"]), "documents": (docs, ["document_id"]), "videos": (videos, ["video_id"]), "votes": (votes, ["item_no"])})
    parsed = F.from_json("snapshot", "meeting_id long, items array<struct<item_no:int>>, documents array<struct<document_id:long>>, videos array<struct<video_id:long>>, notes array<string>")
    x = got.select("meeting_id", "revision", parsed.alias("x"))
    n = lambda c: F.size(f"x.{c}").cast("long").alias(f"n_{c}")
    return x.select("meeting_id", "revision", n("items"), n("documents"), n("videos"), F.col("x.notes").alias("notes"), F.col("x.meeting_id").alias("first_key"))


@R.add(r"""WITH t AS (SELECT p_partkey, p_size % 5 AS source_id, p_type AS title FROM part), s AS (SELECT *, CASE source_id WHEN 0 THEN ['BRASS', 'steel'] WHEN 1 THEN [] WHEN 4 THEN ['small'] ELSE ['City Council', 'Planning and Zoning', 'Advisory Board', 'Commission', 'Authority', 'Study Session', 'Regular Session'] END AS k,
 CASE source_id WHEN 0 THEN ['promo'] ELSE ['This Week in Council', 'Neighborhood Meeting', 'Esports'] END AS s FROM t),
m AS (SELECT p_partkey, source_id, list_filter(k, lambda p: regexp_matches(title, '(?i)\b' || p || '\b')) AS k, list_filter(s, lambda p: regexp_matches(title, '(?i)\b' || p || '\b')) AS s FROM s)
SELECT p_partkey AS title_id, len(k) > 0 AND len(s) = 0 AS is_meeting, array_to_string(k, ',') AS keywords, array_to_string(s, ',') AS skips, CASE source_id WHEN 2 THEN 'the settings are not JSON' WHEN 3 THEN 'the settings are not an object' END AS problem FROM m""")
def classified_by_source(spark: SparkSession, d: str) -> DataFrame:
    """[UD6, FLT6] Parts' types as titles of five sources, each with settings of its own."""
    titles = read(spark, d, "part").select(F.col("p_partkey").alias("title_id"), (F.col("p_size") % 5).cast("long").alias("source_id"), F.col("p_type").alias("title"))
    settings = ['{"meeting_keywords": ["BRASS", "steel"], "meeting_skip_titles": ["promo"]}', '{"meeting_keywords": []}', "{broken", "[1]", '{"meeting_keywords": ["small"]}']
    n = F.col("source_id")
    sources = titles.select("source_id").distinct().select("source_id", F.element_at(F.array(*map(F.lit, settings)), (n + 1).cast("int")).alias("settings"))
    got = portal.classified(titles, sources)
    return got.select("title_id", "is_meeting", F.array_join("keywords", ",").alias("keywords"), F.array_join("skips", ",").alias("skips"), "problem")
