"""Sources and sinks over files made from the driver's tables: what is written in a foreign form must be read as the tables' rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import minutes
from folioflow.plans.common import Registry, read
from folioflow.sources import agendas, exports, listings, tables
from folioflow.sources.cuts import Cuts

R = Registry()


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'second' ELSE 'first' END AS run FROM orders""")
def appended_once(spark: SparkSession, d: str) -> DataFrame:
    """[SRC3] Two appends that overlap: a row whose key is stored isn't written again."""
    path = f"{Cuts(spark, 'append').folder}/table"
    o = read(spark, d, "orders").select("o_orderkey")
    tables.append_new(o.where("o_orderkey % 3 <> 2").withColumn("run", F.lit("first")), path, "o_orderkey")
    return tables.append_new(o.where("o_orderkey % 3 <> 0").withColumn("run", F.lit("second")), path, "o_orderkey")


@R.add("""SELECT l_suppkey % 10 AS part, l_orderkey, CASE WHEN l_suppkey % 10 IN (1, 4) THEN 2 ELSE 1 END AS version, count(*) AS n FROM lineitem GROUP BY ALL""")
def written_again(spark: SparkSession, d: str) -> DataFrame:
    """[SM9] A source read twice: the parts that the second reading holds take the place of the first ones, the others stay."""
    path = f"{Cuts(spark, 'again').folder}/table"
    rows = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("part"), "l_orderkey").agg(F.count("*").alias("n"))
    tables.write_again(rows.withColumn("version", F.lit(1)), path, "part")
    again = tables.write_again(rows.where("part in (1, 4)").withColumn("version", F.lit(2)), path, "part")
    return again.select("part", "l_orderkey", "version", "n")


@R.add("""SELECT 'v' || event_id AS video_id, event_type || ' & <more>' AS title, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published, CASE event_id % 3 WHEN 2 THEN '' ELSE 'UC' || user_id END AS channel_id, 'rss' AS source_method FROM events WHERE event_id % 7 <> 0""")
def feed_videos(spark: SparkSession, d: str) -> DataFrame:
    """[SRC12] Events as entries of Atom feeds: some without a video's id, channels whole, short or absent."""
    k = F.col("event_id")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    channel = F.when(k % 3 == 0, F.concat(F.lit("UC"), "user_id")).when(k % 3 == 1, F.col("user_id").cast("string")).otherwise(F.lit(""))
    entry = F.concat(F.lit("<entry>"), tag("yt:videoId", F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), k))), tag("yt:channelId", channel), tag("title", F.concat("event_type", F.lit(" &amp; &lt;more&gt;"))), tag("published", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</entry>"))
    path = f"{Cuts(spark, 'feed').folder}/feeds"
    feeds = read(spark, d, "events").groupBy((k % 40).alias("feed")).agg(F.array_sort(F.collect_list(entry)).alias("xs"))
    whole = F.concat(F.lit('<feed xmlns:yt="urn:yt">'), F.array_join("xs", ""), F.lit("</feed>"))
    feeds.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # a file holds one feed
    return listings.channel_feed(spark, path).select("video_id", "title", "published", "channel_id", "source_method")


def _entries(spark: SparkSession, d: str, made: Column) -> DataFrame:
    """One JSON answer for each user's events, in the order of their numbers."""
    e = read(spark, d, "events").select("user_id", F.struct("event_id", made.alias("x")).alias("x"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("user_id", F.transform("xs", lambda x: x["x"]).alias("xs"))


@R.add("""WITH e AS (SELECT 'v' || event_id AS video_id, user_id, event_id, event_type, value, epoch_us(ts) // 1000000 AS stamp FROM events WHERE event_id % 11 <> 0)
SELECT video_id, event_type AS title, strftime(make_timestamp(stamp * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published, 'c' || user_id AS channel_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value) END AS duration_s FROM e""")
def playlist_videos(spark: SparkSession, d: str) -> DataFrame:
    """[SRC13] Each user's events as a channel's two playlists, the second with the first's videos under other titles: streams come first."""
    k = F.col("event_id")
    entry = F.struct(F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), k)).alias("id"), F.col("event_type").alias("title"), F.when(k % 5 == 0, F.lit("soon")).otherwise(F.floor("value").cast("string")).alias("duration"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("was_live").alias("live_status"))
    lists = _entries(spark, d, entry)
    body = lambda title: F.to_json(F.struct(F.concat(F.lit("c"), "user_id").alias("channel_id"), F.transform("xs", lambda x: x.withField("title", F.concat(F.lit(title), x["title"]))).alias("entries")))
    answers = lists.select(F.lit("streams").alias("tab"), body("").alias("value")).unionByName(lists.select(F.lit("videos").alias("tab"), body("second ").alias("value")))
    return listings.flat_playlists(answers).select("video_id", "title", "published", "channel_id", "duration_s")


@R.add("""SELECT 'v' || event_id AS video_id, event_type AS title, CASE WHEN event_id % 2 = 0 THEN 'at ' || event_id ELSE 'made ' || event_id END AS published, 'c' || user_id AS channel_id,
CASE WHEN event_id % 3 <> 0 THEN CAST((event_id % 50) * 60 + 7 AS DOUBLE) END AS duration_s, CASE WHEN event_id % 3 <> 0 THEN 'none' END AS live_broadcast_content FROM events WHERE event_id % 13 <> 0""")
def api_videos(spark: SparkSession, d: str) -> DataFrame:
    """[SRC14] Events as playlist items, left-joined with facts that a third of them lack."""
    k = F.col("event_id")
    blank = lambda test, value: F.when(test, F.lit("")).otherwise(value)
    item = F.struct(F.struct(blank(k % 13 == 0, F.concat(F.lit("v"), k)).alias("videoId"), blank(k % 2 == 1, F.concat(F.lit("at "), k)).alias("videoPublishedAt")).alias("contentDetails"), F.struct(F.col("event_type").alias("title"), F.concat(F.lit("c"), "user_id").alias("channelId"), F.concat(F.lit("made "), k).alias("publishedAt")).alias("snippet"))
    fact = F.struct(F.when(k % 3 != 0, F.concat(F.lit("v"), k)).alias("id"), F.struct(F.lit("none").alias("liveBroadcastContent")).alias("snippet"), F.struct(F.concat(F.lit("PT"), k % 50, F.lit("M7S")).alias("duration")).alias("contentDetails"))
    answer = lambda made: _entries(spark, d, made).select(F.to_json(F.struct(F.col("xs").alias("items"))).alias("value"))
    return listings.video_api(answer(item), answer(fact)).select("video_id", "title", "published", "channel_id", "duration_s", "live_broadcast_content")


@R.add("""SELECT 'f' || event_id AS path, 'v' || event_id AS video_id, CASE event_id % 4 WHEN 0 THEN 'publisher' WHEN 1 THEN 'auto' WHEN 2 THEN 'auto' END AS caption_origin,
CASE WHEN event_id % 6 <> 0 THEN floor(value) END AS duration_s, CASE event_id % 4 WHEN 0 THEN 'own' || user_id WHEN 1 THEN 'auto' || user_id WHEN 2 THEN 'en' || user_id END AS revision_at FROM events""")
def sidecar_rows(spark: SparkSession, d: str) -> DataFrame:
    """[SRC16] Events as info files with caption tracks of each origin."""
    k = F.col("event_id")
    track = lambda word: F.array(F.create_map(F.lit("ext"), F.lit("vtt"), F.lit("last_modified"), F.concat(F.lit(word), "user_id")))
    none = F.create_map().cast("map<string,array<map<string,string>>>")
    own = F.when(k % 4 == 0, F.create_map(F.lit("en"), track("own"))).otherwise(none)
    auto = F.when(k % 4 == 1, F.create_map(F.lit("en-orig"), track("auto"), F.lit("en"), track("late"))).when(k % 4 == 2, F.create_map(F.lit("en"), track("en"))).otherwise(none)
    info = F.to_json(F.struct(F.concat(F.lit("v"), k).alias("id"), F.when(k % 6 == 0, F.lit("long")).otherwise(F.floor("value").cast("string")).alias("duration"), own.alias("subtitles"), auto.alias("automatic_captions")))
    return listings.sidecar_facts(read(spark, d, "events").select(F.concat(F.lit("f"), k).alias("path"), info.alias("value")))


@R.add("""SELECT page_id, sha256(html) AS sha256 FROM pages""")
def decoded_pages(spark: SparkSession, d: str) -> DataFrame:
    """[SRC9] Pages' texts from bytes in UTF-8 (told by a meta tag, the content type, or nothing) and in UTF-16 with a mark."""
    k = F.col("page_id")
    plain = F.encode("html", "UTF-8")
    data = F.when(k % 3 == 2, F.concat(F.lit(b"\xff\xfe"), F.encode("html", "UTF-16LE"))).otherwise(plain)
    p = read(spark, d, "pages").select("page_id", data.alias("data"), F.when(k % 3 == 1, "text/html; charset=utf-8").alias("type"))
    return p.select("page_id", F.sha2(agendas.decode_page("data", "type"), 256).alias("sha256"))


@R.add("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 6 AS item, o_orderkey % 4 AS form, o_orderdate FROM orders), n AS (SELECT *, k AS pos FROM o),
m AS (SELECT pos // 10 AS meeting_id, item AS item_no, min(pos % 10) AS turn FROM n WHERE form <> 3 GROUP BY ALL)
SELECT m.meeting_id, CAST(m.item_no AS INT) AS item_no, m.turn * 100000 AS start_ms, CASE n.form WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'unknown' END AS result FROM m JOIN n ON n.pos // 10 = m.meeting_id AND n.pos % 10 = m.turn""")
def spoken_motions(spark: SparkSession, d: str) -> DataFrame:
    """[CX6, ST24] Ten orders as what is said in a meeting: a motion that names one item, its outcome, and lines enough that no other motion is near."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 6).alias("item"), (F.col("o_orderkey") % 4).alias("form"))
    at = F.col("k")
    motion = F.when(F.col("form") == 3, F.lit("a word on the roads")).otherwise(F.concat(F.lit("may i have a motion on item 9"), F.char(65 + F.col("item"))))
    result = F.when(F.col("form") == 0, "that carries").when(F.col("form") == 1, "that fails").otherwise("thank you")
    said = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.when(i == 0, motion).when(i == 4, result).otherwise(F.lit("yes")))
    lines = o.select(F.floor(at / 10).alias("meeting_id"), (at % 10).alias("turn"), F.posexplode(said).alias("i", "text")).select("meeting_id", (F.col("turn") * 100 + F.col("i")).alias("line_id"), (F.col("turn") * 100_000 + F.col("i") * 1000).alias("start_ms"), "text")
    items = o.select(F.floor(at / 10).alias("meeting_id")).distinct().select("meeting_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("item_no")).select("meeting_id", "item_no", F.concat(F.lit("9."), F.char(65 + F.col("item_no"))).alias("number"), F.lit("Streets").alias("title"))
    return minutes.spoken_votes(lines, items).select("meeting_id", "item_no", "start_ms", "result")


@R.add("""SELECT event_id, event_type, value, props FROM events""")
def exported_rows(spark: SparkSession, d: str) -> DataFrame:
    """[SRC21] Events exported as jsonl and read back."""
    path = f"{Cuts(spark, 'export').folder}/rows"
    exports.export(read(spark, d, "events").select("event_id", "event_type", "value", "props"), path, "jsonl")
    return spark.read.schema("event_id long, event_type string, value double, props string").json(path)
