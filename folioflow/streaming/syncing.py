"""[CX17, CX18] Whole syncs: a stream of portals' saved answers becomes meetings, videos, documents and a tally, each batch once.

A batch writes its changed rows to tables under its own number, and last a commit. What is current is the latest committed version of each row; a
batch that is read again after it was committed does nothing, and one that died between two writes writes all of them anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import video_id
from folioflow.operators.portal import cancelled_by, continued_by, meeting_type, resolve_bodies
from folioflow.operators.resolution import adopt_videos, resolve_meetings
from folioflow.operators.state import current
from folioflow.sources.cuts import remove
from folioflow.sources.listings import portal_meetings
from folioflow.sources.tables import stored_rows

MEETINGS = "id long, body_id long, starts_at string, title string, type string, is_cancelled boolean, is_continued boolean, portal_source_id long, portal_meeting_id long, template_id long"
VIDEOS = "id long, source_id long, platform_id string, meeting_id long, is_primary boolean, title string, url string, readiness string"
DOCUMENTS = "id long, meeting_id long, source_id long, document_id long, template_id long, output_type int, template_name string, action string"
TALLY = "id long, source_id long, listed long, meetings_created long, meetings_updated long, cancelled long, continued long, videos_created long, videos_linked long, documents_queued long, agendas_to_read long, skipped long"
SKIPS = "id long, source_id long, portal_meeting_id long, reason string"
TABLES = {"meetings": MEETINGS, "videos": VIDEOS, "documents": DOCUMENTS, "tally": TALLY, "skips": SKIPS}
#: How documents are compiled: fetched later, or read at once.
COMPILED, HTML = 1, 3


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    like = spark.createDataFrame([], TABLES[name] + ", batch long")
    return stored_rows(spark, f"{folder}/{name}", like)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """batch: the batches whose writes are all there."""
    return stored_rows(spark, f"{folder}/commits", spark.createDataFrame([], "done boolean, batch long")).select("batch").distinct()


def current_rows(spark: SparkSession, folder: str, name: str, but: int | None = None) -> DataFrame:
    """The rows of a table as the committed batches left them, the latest version of each. but: a batch whose files aren't opened, as a try to
    write it that died may have left some, which the next one writes over."""
    rows = _table(spark, folder, name)
    rows = rows if but is None else rows.where(F.col("batch") != but)
    return current(rows.join(committed(spark, folder), "batch", "left_semi"), ["id"], "batch").drop("batch")


def sync_batch(lists: DataFrame, batch: int, folder: str, sources: DataFrame, bodies: DataFrame, channels: DataFrame | None = None, wrote: Callable[[str], None] = lambda name: None) -> bool:
    """[CX17] Takes in one batch of answers (site, list_no, value); False where the batch had been committed before.

    sources: source_id, site, area_id, city, body_id; bodies: area_id, body_id, name. A meeting that names no body of its area, a document that is neither
    compiled nor an agenda, and a video address without an id are skipped with a reason. `wrote` is told each table written (tests stop there)."""
    spark = lists.sparkSession
    if committed(spark, folder).where(F.col("batch") == batch).take(1):
        return False

    def put(name: str, rows: DataFrame) -> DataFrame:
        path = f"{folder}/{name}/batch={batch}"
        rows.select([c.split()[0] for c in TABLES[name].split(", ")]).write.mode("overwrite").parquet(path)  # what a dead try left goes
        wrote(name)
        return spark.read.schema(TABLES[name]).parquet(path)

    own_id = lambda *parts: F.shiftrightunsigned(F.xxhash64(*parts, F.lit(batch)), 1)  # noqa: E731  new rows of other batches have other ids
    listed = portal_meetings(lists.where("value is not null"), ["site"]).join(F.broadcast(sources), "site")  # sources are configured by hand: a few rows
    listed = listed.withColumn("key", F.xxhash64("source_id", "meeting_id"))
    named = resolve_bodies(listed.select(F.col("key").alias("title_id"), "area_id", "city", F.col("body_id").alias("own_body_id"), "title"), bodies)
    found = listed.drop("body_id").join(named.select(F.col("title_id").alias("key"), "body_id"), "key", "left")
    templates = F.transform("documents", lambda d: F.coalesce(d["templateName"], F.lit("")))
    html = F.get(F.filter("documents", lambda d: d["compileOutputType"] == HTML), F.lit(0))["templateId"]
    found = found.withColumns({"stopped": cancelled_by(F.col("title"), templates), "put_off": continued_by(F.col("title"))})
    staged = f"{folder}/staged/batch={batch}"
    found.write.mode("overwrite").parquet(staged)  # read once, and used by all that follows
    found = spark.read.schema(found.schema).parquet(staged)
    # one portal's meetings arrive in the order of their numbers, portals one after the other
    arrival = F.row_number().over(Window.partitionBy("source_id").orderBy("meeting_id")).cast("long") + F.col("source_id") * (1 << 40)
    seen = found.where("body_id is not null").select(arrival.alias("arrival"), "body_id", "starts_at", F.nullif("title", F.lit("")).alias("title"), meeting_type(F.col("title")).alias("type"), F.col("stopped").isNotNull().alias("is_cancelled"), F.col("put_off").isNotNull().alias("is_continued"), F.col("source_id").alias("portal_source_id"), F.col("meeting_id").alias("portal_meeting_id"), html.alias("template_id"))
    resolved = resolve_meetings(current_rows(spark, folder, "meetings", batch), seen).where("n_seen > 0")
    meetings = put("meetings", resolved.withColumn("id", F.coalesce("id", own_id("row"))))

    of = meetings.where("portal_meeting_id is not null").select(F.col("id").alias("own_meeting"), F.col("portal_source_id").alias("source_id"), F.col("portal_meeting_id").alias("meeting_id"))
    placed = found.join(of, ["source_id", "meeting_id"])
    linked = placed.where("video_url is not null").withColumn("platform_id", video_id(F.col("video_url")))
    listings = linked.where("platform_id is not null").select(arrival.alias("arrival"), "source_id", "platform_id", F.col("own_meeting").alias("meeting_id"), F.lit(None).cast("string").alias("title"), F.col("video_url").alias("url"), F.lit("unknown").alias("readiness"))
    stored = current_rows(spark, folder, "videos", batch)
    stored = stored if channels is None else stored.unionByName(channels.join(stored.select("id"), "id", "left_anti"), allowMissingColumns=True)
    put("videos", adopt_videos(stored, listings).where("n_seen > 0").withColumn("id", F.coalesce("id", own_id("row"))))

    docs = placed.select("source_id", F.col("own_meeting").alias("meeting_id"), F.col("meeting_id").alias("portal_meeting_id"), F.explode("documents").alias("d"))
    docs = docs.select("source_id", "meeting_id", "portal_meeting_id", F.coalesce("d.id", F.lit(0)).alias("document_id"), F.col("d.templateId").alias("template_id"), F.coalesce("d.compileOutputType", F.lit(0)).alias("output_type"), F.coalesce("d.templateName", F.lit("")).alias("template_name"))
    action = F.when(F.col("output_type") == COMPILED, "download").when(F.col("output_type") == HTML, "read")
    docs = docs.withColumns({"action": action, "id": F.shiftrightunsigned(F.xxhash64("meeting_id", "document_id", "template_id", "output_type"), 1)})
    asked = docs.where("action is not null").dropDuplicates(["id"]).join(current_rows(spark, folder, "documents", batch).select("id"), "id", "left_anti")  # each is asked for once
    documents = put("documents", asked)

    why = lambda rows, reason, m="meeting_id": rows.select("source_id", F.col(m).alias("portal_meeting_id"), reason.alias("reason"))
    skips = why(found.where("body_id is null"), F.concat(F.lit("no body of the area is named by "), "title"))
    skips = skips.unionByName(why(linked.where("platform_id is null"), F.concat(F.lit("no video's id can be read from "), "video_url")))
    skips = skips.unionByName(why(docs.where("action is null"), F.concat(F.lit("a document is compiled as "), "output_type"), "portal_meeting_id"))
    skips = put("skips", skips.withColumn("id", own_id("source_id", "portal_meeting_id", "reason")))
    known = listings.join(stored.select("platform_id", F.lit(True).alias("was")).distinct(), "platform_id", "left")
    first = F.row_number().over(Window.partitionBy("platform_id").orderBy("arrival")) == 1
    known = known.select("source_id", (F.col("was").isNull() & first).alias("fresh"))
    put("tally", _tally(found, meetings, current_rows(spark, folder, "meetings", batch), known, documents, skips).withColumn("id", own_id("source_id")))
    spark.createDataFrame([(True,)], "done boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")
    wrote("commits")
    remove(spark, staged)
    return True


def _tally(found: DataFrame, meetings: DataFrame, before: DataFrame, videos: DataFrame, documents: DataFrame, skips: DataFrame) -> DataFrame:
    """TALLY without id, a row a source. videos: a row a listed video, with whether it was the first sight of it."""
    taken = meetings.join(before.select("id", F.lit(True).alias("was")), "id", "left").withColumn("fresh", F.col("was").isNull()).withColumnRenamed("portal_source_id", "source_id")
    part = lambda rows, **sums: rows.groupBy("source_id").agg(*[F.count_if(test).alias(name) for name, test in sums.items()])
    yes, no = F.col("fresh"), ~F.col("fresh")
    known = F.col("body_id").isNotNull()
    parts = [
        part(found, listed=F.lit(True), cancelled=known & F.col("stopped").isNotNull(), continued=known & F.col("put_off").isNotNull()),
        part(taken, meetings_created=yes, meetings_updated=no),
        part(videos, videos_created=yes, videos_linked=no),
        part(documents, documents_queued=F.col("action") == "download", agendas_to_read=F.col("action") == "read"),
        part(skips, skipped=F.lit(True)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "source_id", "full_outer")
    counts = [c.split()[0] for c in TALLY.split(", ")][2:]
    return out.select("source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def sync(stream: DataFrame, folder: str, sources: DataFrame, bodies: DataFrame, checkpoint: str, channels: DataFrame | None = None, wrote: Callable[[str], None] = lambda name: None):
    """[CX17, CX18] Starts a query that syncs a stream of answers (what="meetings" of the answers source), each batch once."""
    take = lambda rows, batch: sync_batch(rows, batch, folder, sources, bodies, channels, wrote)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()

