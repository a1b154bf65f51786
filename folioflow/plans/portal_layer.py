"""Portal, consent, caption-change and report queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import captures, portal, speakers, state
from folioflow.plans.common import Registry, read

R = Registry()

_FORMS = ["{} Regular Session", "CANCELLED - {}", "SPECIAL {} MEETING", "{} POSTPONED to March 23", "{} May Meeting"]


@R.add("""SELECT c_custkey AS title_id, n_name AS name, n_nationkey AS body_id FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def resolved_bodies(spark: SparkSession, d: str) -> DataFrame:
    """[ST16, JN15] Each customer as a listed title, in five forms, that names a nation as its body."""
    n = read(spark, d, "nation")
    bodies = n.select(F.lit(1).alias("area_id"), F.col("n_nationkey").alias("body_id"), F.col("n_name").alias("name"))
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    titles = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("title_id"), F.lit(1).alias("area_id"), F.lit("Town").alias("city"), F.lit(0).alias("own_body_id"), F.replace(form, F.lit("{}"), F.col("n_name")).alias("title"))
    return portal.resolve_bodies(titles, bodies)


@R.add("""WITH o AS (SELECT o_orderkey, 1 + o_custkey % 6 AS out_no, o_orderkey % 3 AS form FROM orders), i AS (SELECT unnest(range(1, 7)) AS item_no)
SELECT o_orderkey AS meeting_id, CAST(item_no AS INT) AS item_no, NOT (form < 2 AND item_no = out_no) AS covered FROM o, i""")
def consent_coverage(spark: SparkSession, d: str) -> DataFrame:
    """[ST12] Each order as a motion on a consent agenda of six items, with one taken out by number, by letter, or none."""
    orders = read(spark, d, "orders")
    letter = F.char(65 + F.col("o_custkey") % 6)
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("to approve the consent agenda except item 9"), letter)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("to pass the consent agenda minus "), letter, F.lit("."))).otherwise("to approve the consent agenda")
    motions = orders.select(F.col("o_orderkey").alias("meeting_id"), F.lit(1).alias("ordinal"), said.alias("text"))
    number = F.when(F.col("item_no") == 0, "9.").otherwise(F.concat(F.lit("9."), F.char(64 + F.col("item_no"))))
    items = orders.select(F.col("o_orderkey").alias("meeting_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("item_no")).withColumn("number", number).withColumn("title", F.when(F.col("item_no") == 0, "Consent Agenda").otherwise("x"))
    return portal.consent_coverage(motions, items).select("meeting_id", "item_no", "covered")


@R.add("""WITH e AS (SELECT user_id AS video_id, event_type AS sha256, epoch_us(ts) AS seen FROM events)
SELECT video_id, sha256, min(seen) AS seen FROM e WHERE NOT (sha256 = 'view') GROUP BY video_id, sha256""")
def new_caption_versions(spark: SparkSession, d: str) -> DataFrame:
    """[CX11] Event types as versions of each user's captions, of which one is stored."""
    seen = read(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("sha256"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"))
    return captures.new_versions(seen, seen.where("sha256 = 'view'").select("video_id", "sha256").distinct())


@R.add("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS seen FROM events), v AS (SELECT user_id, event_type, min(seen) AS seen FROM e GROUP BY user_id, event_type),
n AS (SELECT user_id, arg_max(event_type, (seen, event_type)) AS now FROM v GROUP BY user_id)
SELECT event_id, 'captions changed: ' || now AS reason FROM e JOIN n ON n.user_id = e.user_id WHERE event_type <> now""")
def stale_marks(spark: SparkSession, d: str) -> DataFrame:
    """[CX11] Events read from an older version than the user's latest."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("video_id"), F.col("event_type").alias("sha256"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"))
    rows = e.select(F.lit("row").alias("kind"), F.col("event_id").alias("row_id"), "video_id", "sha256")
    none = rows.select("kind", "row_id", F.lit("").alias("reason")).where("false")
    return captures.stale_marks(captures.new_versions(e, e.select("video_id", "sha256").where("false")), rows, none).select(F.col("row_id").alias("event_id"), "reason")


@R.add("""WITH t AS (SELECT l_orderkey AS k, max(l_partkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), o AS (SELECT o_orderkey, o_custkey, p FROM orders LEFT JOIN t ON k = o_orderkey),
s AS (SELECT o_custkey, min(o_orderkey) AS sister, arg_min(p, o_orderkey) AS sp FROM o WHERE p IS NOT NULL GROUP BY o_custkey)
SELECT o_orderkey AS video_id, coalesce(p, sp) AS transcript_id, CASE WHEN p IS NOT NULL THEN o_orderkey ELSE sister END AS from_video,
CASE WHEN p IS NULL AND sister IS NULL THEN 'no video of the meeting has captions' END AS hand_off FROM o LEFT JOIN s ON s.o_custkey = o.o_custkey""")
def caption_fallback(spark: SparkSession, d: str) -> DataFrame:
    """[CX24] Orders as videos of their customers' meetings, returned lines as transcripts."""
    videos = read(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("meeting_id"))
    lines = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("transcript_id"), F.col("l_partkey").alias("at"))
    return captures.caption_sources(videos, lines)


@R.add("""WITH e AS (SELECT user_id, event_type, row_number() OVER w AS r, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS subject, count(*) AS n_checks, count(*) FILTER (event_type IS DISTINCT FROM coalesce(before, 'view')) AS n_revisions FROM e GROUP BY user_id""")
def recheck_cycle(spark: SparkSession, d: str) -> DataFrame:
    """[CX23] Each user's events as observations of captions that were first `view`."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = read(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("sha256"), place.cast("long").alias("checked"))
    caps = e.select("subject").distinct().select("subject", F.lit(0).cast("long").alias("captured"), F.lit(0).cast("long").alias("ended"), F.lit("view").alias("sha256"))
    return captures.recheck(caps, e, F.lit(10**9)).select("subject", "n_checks", "n_revisions")


#: The states of a job in the order of its life; others come last.
LIFE = ["O", "P", "F"]


@R.add("""SELECT o_orderstatus AS state, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS lanes,
CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 4 END AS place FROM orders GROUP BY o_orderstatus""")
def queue_report(spark: SparkSession, d: str) -> DataFrame:
    """[CX25] Counts by state in the order of life, lanes nested."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LIFE)), F.col("state")), F.lit(0)), F.lit(len(LIFE) + 1)).cast("int")
    per = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("lane")).agg(F.count("*").alias("n"))
    return per.groupBy("state").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("lane")), ",").alias("lanes")).withColumn("place", place)


@R.add("""WITH s AS (SELECT o_custkey, o_orderstatus, min(o_orderdate) AS a FROM orders GROUP BY ALL) SELECT o_custkey AS person_id, o_orderstatus AS title, a AS start_date FROM s""")
def seat_starts(spark: SparkSession, d: str) -> DataFrame:
    """[CX13] A customer's orders as sightings in a seat, some open already: the start moves earlier only."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.lit(1).alias("body_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderdate").alias("on"))
    opened = o.groupBy("person_id", "body_id", "title").agg(F.max("on").alias("start_date")).withColumn("end_date", F.lit(None).cast("timestamp_ntz"))
    return speakers.seat_intervals(opened, o).select("person_id", "title", "start_date")


@R.add("""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision, o_orderstatus = 'F' AS published FROM orders)
SELECT o_custkey AS meeting_id, max(revision) AS revision, arg_max(published, revision) AS published FROM h GROUP BY o_custkey""")
def publication_state(spark: SparkSession, d: str) -> DataFrame:
    """[CX15] Publishing and withdrawing each count a revision; the latest one holds, the history keeps all."""
    revision = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    history = read(spark, d, "orders").select(F.col("o_custkey").alias("meeting_id"), revision.cast("long").alias("revision"), (F.col("o_orderstatus") == "F").alias("published"))
    return state.current(history, ["meeting_id"], "revision")
