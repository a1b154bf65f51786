"""Listings of meetings and videos as tables: portal JSON, channel feeds, playlists, the video API's answers and sidecars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import collapse_space
from folioflow.functions.times import iso_seconds

MEETINGS = "array<struct<id:bigint,dateTime:string,title:string,videoUrl:string,meetingState:int,documentList:array<struct<id:bigint,templateId:bigint,compileOutputType:int,templateName:string,publishDate:string>>>>"
PLAYLIST = "channel_id string, entries array<struct<id:string,title:string,duration:string,timestamp:bigint,live_status:string>>"
LISTING = ["video_id", "title", "published", "channel_id", "duration_s", "live_broadcast_content", "live_status", "source_method"]
#: The tabs of a channel in the order in which they count, and the start of a channel's full id.
TABS = ["streams", "videos"]
CHANNEL_START = "UC"
#: Language keys of caption tracks.
PUBLISHED_TRACK, OWN_TRACKS = "en", ["en-orig", "en"]
#: Where a track's revision time stands.
REVISED = ["last_modified", "modified"]


def _first(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    place = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def portal_meetings(lists: DataFrame, by: list[str] = ()) -> DataFrame:
    """[SRC7] by, meeting_id, title, starts_at, video_url, documents of portal answers (by, list_no, value: a JSON array of meetings).

    by: columns that tell portals apart. Entries without an id or a time are left out; of entries with one id the first counts, by list_no and place.
    documents: array<struct<id, templateId, compileOutputType, templateName, publishDate>>, those with a template."""
    entry = lists.select(*by, "list_no", F.posexplode(F.from_json("value", MEETINGS)).alias("place", "m"))
    timed = entry.where(F.col("m.id").isNotNull() & F.try_to_timestamp("m.dateTime").isNotNull())
    documents = F.filter(F.coalesce("m.documentList", F.array()), lambda d: d["templateId"].isNotNull())
    out = timed.select(*by, "list_no", "place", F.col("m.id").alias("meeting_id"), collapse_space(F.coalesce("m.title", F.lit(""))).alias("title"), F.col("m.dateTime").alias("starts_at"), F.nullif("m.videoUrl", F.lit("")).alias("video_url"), documents.alias("documents"))
    return _first(out, [*by, "meeting_id"], "list_no", "place").drop("list_no", "place")


def portal_documents(meetings: DataFrame) -> DataFrame:
    """[SRC7] One row for each document of portal_meetings()."""
    d = meetings.select("meeting_id", F.explode("documents").alias("d"))
    return d.select("meeting_id", F.coalesce("d.id", F.lit(0)).alias("document_id"), F.col("d.templateId").alias("template_id"), F.coalesce("d.compileOutputType", F.lit(0)).alias("output_type"), F.coalesce("d.templateName", F.lit("")).alias("template_name"), F.col("d.publishDate").alias("publish_date"))


def _listing(rows: DataFrame, method: str, **columns: Column) -> DataFrame:
    none = {"duration_s": F.lit(None).cast("double"), "live_broadcast_content": F.lit(None).cast("string"), "live_status": F.lit(None).cast("string"), "source_method": F.lit(method)}
    chosen = none | columns
    return rows.select(*[chosen[c].alias(c) for c in LISTING])


def channel_feed(spark: SparkSession, path: str) -> DataFrame:
    """[SRC12] The videos of Atom feeds, read with Spark's XML reader: entries without a video id are left out, a channel's short id is completed."""
    schema = "title string, published string, `yt:videoId` string, `yt:channelId` string"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    channel = F.trim(F.coalesce("`yt:channelId`", F.lit("")))
    full = F.when((channel == "") | channel.startswith(CHANNEL_START), channel).otherwise(F.concat(F.lit(CHANNEL_START), channel))
    held = rows.where(F.trim(F.coalesce("`yt:videoId`", F.lit(""))) != "")
    return _listing(held, "rss", video_id=F.trim("`yt:videoId`"), title=F.trim(F.coalesce("title", F.lit(""))), published=F.nullif(F.trim("published"), F.lit("")), channel_id=full)


def flat_playlists(answers: DataFrame) -> DataFrame:
    """[SRC13] The videos of flat playlists (tab, value): streams before videos, each id once; entries carry no channel, the playlist does."""
    tab = F.array_position(F.array(*map(F.lit, TABS)), F.col("tab"))
    parsed = answers.select(tab.alias("t"), F.from_json("value", PLAYLIST).alias("p"))
    e = parsed.select("t", F.coalesce("p.channel_id", F.lit("")).alias("channel"), F.posexplode("p.entries").alias("place", "e")).where(F.coalesce("e.id", F.lit("")) != "")
    length = F.when(F.col("e.duration").rlike(r"^[0-9.]+$"), F.col("e.duration").cast("double"))
    published = F.when(F.col("e.timestamp").isNotNull(), F.date_format(F.timestamp_seconds("e.timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = e.select("t", "place", "channel", F.col("e.id").alias("video_id"), F.coalesce("e.title", F.lit("")).alias("title"), published.alias("published"), length.alias("duration_s"), F.col("e.live_status").alias("live_status"))
    once = _first(rows, "video_id", "t", "place")
    return _listing(once, "flat", video_id=F.col("video_id"), title=F.col("title"), published=F.col("published"), channel_id=F.col("channel"), duration_s=F.col("duration_s"), live_status=F.col("live_status"))


def video_api(items: DataFrame, facts: DataFrame) -> DataFrame:
    """[SRC14] Playlist items (value: JSON answer) left-joined with the facts of their videos (value: JSON answer): no fact, nulls."""
    item = "array<struct<contentDetails:struct<videoId:string,videoPublishedAt:string>,snippet:struct<title:string,channelId:string,publishedAt:string>>>"
    fact = "array<struct<id:string,snippet:struct<liveBroadcastContent:string>,contentDetails:struct<duration:string>>>"
    i = items.select(F.explode(F.from_json("value", f"items {item}")["items"]).alias("i")).where(F.coalesce("i.contentDetails.videoId", F.lit("")) != "")
    f = facts.select(F.explode(F.from_json("value", f"items {fact}")["items"]).alias("f")).where("f.id is not null")
    f = f.groupBy(F.col("f.id").alias("video_id")).agg(F.last("f.snippet.liveBroadcastContent").alias("content"), F.last(iso_seconds(F.col("f.contentDetails.duration"))).alias("seconds"))
    both = i.withColumn("video_id", F.col("i.contentDetails.videoId")).join(f, "video_id", "left")
    published = F.coalesce(F.nullif("i.contentDetails.videoPublishedAt", F.lit("")), "i.snippet.publishedAt")
    return _listing(both, "api", video_id=F.col("video_id"), title=F.coalesce("i.snippet.title", F.lit("")), published=published, channel_id=F.coalesce("i.snippet.channelId", F.lit("")), duration_s=F.col("seconds").cast("double"), live_broadcast_content=F.col("content"))


@dataclass
class Found:
    """What a ladder found: the rows, the method they came by, and each attempt with its outcome."""

    rows: DataFrame
    method: str
    attempts: DataFrame


def ladder(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]]) -> Found:
    """[SRC15] The first source that gives a row, in order. A failing source is noted and the next one tried; if none gives a row, that is an error."""
    attempts: list[tuple[int, str, str]] = []
    for k, (method, read) in enumerate(steps.items()):
        try:
            rows = read()
            outcome = "empty" if rows.isEmpty() else "used"
        except Exception as e:  # any source may fail in its own way
            rows, outcome = None, f"failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
        attempts.append((k, method, outcome))
        if outcome == "used":
            return Found(rows, method, spark.createDataFrame(attempts, "place int, method string, outcome string"))
    raise LookupError("no source gave a row: " + "; ".join(f"{m}: {o}" for _, m, o in attempts))


def sidecar_facts(sidecars: DataFrame) -> DataFrame:
    """[SRC16] path, video_id, caption_origin, duration_s, revision_at of info files (path, value).

    The publisher's English track comes before the automatic ones; neither gives null. A length that is no number is null;
    a revision time is kept as text."""
    tracks = "map<string,array<map<string,string>>>"
    x = sidecars.select("path", F.from_json("value", f"id string, duration string, subtitles {tracks}, automatic_captions {tracks}").alias("i"))
    has = lambda c, key: F.coalesce(F.map_contains_key(c, key), F.lit(False))
    own, auto = F.col("i.subtitles"), F.col("i.automatic_captions")
    made = has(auto, OWN_TRACKS[0]) | has(auto, OWN_TRACKS[1])
    origin = F.when(has(own, PUBLISHED_TRACK), "publisher").when(made, "auto")
    track = F.when(has(own, PUBLISHED_TRACK), own[PUBLISHED_TRACK]).when(has(own, OWN_TRACKS[0]), own[OWN_TRACKS[0]]).when(has(auto, OWN_TRACKS[0]), auto[OWN_TRACKS[0]]).when(has(auto, OWN_TRACKS[1]), auto[OWN_TRACKS[1]])
    entry = F.get(track, F.lit(0))
    revised = F.coalesce(*[F.nullif(F.trim(entry[k]), F.lit("")) for k in REVISED])
    return x.select("path", F.col("i.id").alias("video_id"), origin.alias("caption_origin"), F.when(F.col("i.duration").rlike(r"^[0-9.]+$"), F.col("i.duration").cast("double")).alias("duration_s"), revised.alias("revision_at"))
