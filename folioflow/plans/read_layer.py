"""Joins, aggregates, order and set queries of the read layer, on the driver's tables in the part of the rebuilt system's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.times import on_days
from folioflow.operators import state, temporal
from folioflow.plans.common import Registry, read

R = Registry()

PRECEDENCE = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@R.add("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000""")
def inner_chain(spark: SparkSession, d: str) -> DataFrame:
    """[JN1] Orders with customer, nation and region; the planner broadcasts the small tables."""
    o = read(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return o.join(c, "o_custkey").join(n, "c_nationkey").join(r, "n_regionkey").select("o_orderkey", "c_name", "n_name", "r_name")


@R.add("""SELECT c_custkey, n_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
          LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def left_outer_chain(spark: SparkSession, d: str) -> DataFrame:
    """[JN2, AG7] Orders are counted by customer before the join, so no wide row is shuffled."""
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(o, "c_custkey", "left").join(n, "c_nationkey", "left").select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@R.add("""SELECT a.event_id, b.event_id AS sister FROM events a JOIN LATERAL (SELECT event_id FROM events b WHERE b.user_id = a.user_id
          AND b.event_type = a.event_type AND b.event_id <> a.event_id ORDER BY value DESC, event_id LIMIT 1) b ON true""")
def sister_row(spark: SparkSession, d: str) -> DataFrame:
    """[JN4] The best other row of the same parent: of each group only its two best are kept, so the group isn't joined with itself."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    best = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    two = e.withColumn("r", F.row_number().over(best)).where("r <= 2")
    pair = two.groupBy("user_id", "event_type").agg(F.min_by("event_id", "r").alias("one"), F.max_by("event_id", "r").alias("two"))
    sister = F.when(F.col("event_id") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    return e.join(pair, ["user_id", "event_type"]).where("one <> two").select("event_id", sister.alias("sister"))


_SPANS = """spans AS (SELECT user_id, event_id, epoch_us(ts) AS s, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id),
   epoch_us(ts) + 3600000000) AS e FROM events WHERE event_type = 'view')"""


@R.add(f"""WITH {_SPANS}, p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'view')
          SELECT p.event_id, p.user_id, p.t, (SELECT event_id FROM spans WHERE spans.user_id = p.user_id AND s <= p.t AND p.t < e
          ORDER BY s DESC, event_id LIMIT 1) AS range_id FROM p""")
def range_join_latest_start(spark: SparkSession, d: str) -> DataFrame:
    """[JN5, JN6, WN11, CX2] Each event in the span that a view opens; a span ends where the user's next one begins."""
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    views = e.where("event_type = 'view'").select("user_id", "event_id", F.col("t").alias("s"))
    order = Window.partitionBy("user_id").orderBy("s", "event_id")
    spans = views.withColumn("e", F.coalesce(F.lead("s").over(order), F.col("s") + state.HOUR))
    return temporal.latest_range(e.where("event_type <> 'view'").select("event_id", "user_id", "t"), spans, "user_id", "t", "s", "e", "event_id")


_SEATS = """seats AS (SELECT o_orderkey AS seat_id, o_custkey AS person_id, o_orderpriority || '-' || (o_custkey % 900) AS title,
   strftime(o_orderdate, '%Y-%m-%d') AS start_date, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS end_date FROM orders)"""


def _seats(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") != "O", F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd"))
    title = F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 900).cast("string"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("seat_id"), F.col("o_custkey").alias("person_id"), title.alias("title"), day.alias("start_date"), end.alias("end_date"))


@R.add(f"""WITH {_SEATS} SELECT person_id, min(seat_id) AS seat_id FROM seats WHERE start_date <= '1997-06-15'
          AND coalesce(end_date >= '1997-06-15', true) GROUP BY person_id""")
def temporal_validity_join(spark: SparkSession, d: str) -> DataFrame:
    """[JN7] Who holds a seat on a day: open bounds hold, one row a person."""
    held = _seats(spark, d).where(temporal.held_on(None, F.lit("1997-06-15")))
    return held.groupBy("person_id").agg(F.min("seat_id").alias("seat_id"))


@R.add(f"""WITH {_SEATS} SELECT title, min(person_id) AS person_id FROM seats WHERE start_date <= '1997-06-15' AND coalesce(end_date >= '1997-06-15', true)
          GROUP BY title HAVING count(DISTINCT person_id) = 1""")
def sole_title_holder(spark: SparkSession, d: str) -> DataFrame:
    """[JN8] Titles held by one person on a day."""
    return temporal.sole_holders(_seats(spark, d), F.lit("1997-06-15"))


@R.add("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey
          ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1""")
def latest_version_pick(spark: SparkSession, d: str) -> DataFrame:
    """[JN9, WN1] Final before provisional, then the highest id: an aggregate with map-side merge, not a sort of each group."""
    rank = F.struct((F.col("o_orderstatus") == "F").alias("final"), "o_orderkey")
    best = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), rank).alias("b"))
    return read(spark, d, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", "b.o_orderkey", "b.o_totalprice")


@R.add("""SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    """[JN10]"""
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@R.add("""SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)""")
def semi_existing(spark: SparkSession, d: str) -> DataFrame:
    """[JN11, JN13]"""
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")


@R.add("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'filled' ELSE 'open' END AS state,
          CASE WHEN a.doc_id IS NULL THEN 'opened' WHEN b.doc_id IS NULL AND a.state = 'open' THEN 'filled'
          WHEN b.doc_id IS NOT NULL AND a.state = 'filled' THEN 'reopened' ELSE 'kept' END AS change
          FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'open' ELSE 'filled' END AS state FROM labels) a
          FULL JOIN (SELECT doc_id FROM documents WHERE n_chars < 1500) b ON a.doc_id = b.doc_id""")
def missing_state_sync(spark: SparkSession, d: str) -> DataFrame:
    """[CX7] Stored findings (labels) against wanted ones (short documents)."""
    stored = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "open").otherwise("filled").alias("state"))
    return state.sync_state(stored, read(spark, d, "documents").where("n_chars < 1500").select("doc_id"), ["doc_id"])


@R.add("""SELECT event_id FROM events WHERE EXISTS (SELECT 1 FROM unnest(map_entries(CAST(try_cast(props AS JSON) AS MAP(VARCHAR, VARCHAR)))) AS t(e)
          WHERE lower(e.key) = '42' OR lower(e.value) = '42')""")
def json_key_or_value(spark: SparkSession, d: str) -> DataFrame:
    """[FLT3, DT15] JSON objects with a key or a value equal to the term; bad JSON is an empty object."""
    props = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    same = lambda x: F.lower(x) == "42"
    return read(spark, d, "events").where(F.exists(F.map_keys(props), same) | F.exists(F.map_values(props), same)).select("event_id")


@R.add("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) = 7")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    """[FLT4]"""
    return read(spark, d, "events").where(F.get_json_object("props", "$.k").try_cast("long") == 7).select("event_id")


@R.add("""SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey
          WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-02-29' ORDER BY o_orderdate DESC,
          CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END, o_orderkey LIMIT 200""")
def precedence_order(spark: SparkSession, d: str) -> DataFrame:
    """[SL2, SL3, SL4, FLT1, FLT2] Newest first, then by a list of precedence, unknown ones last; cut before the join."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("o_orderpriority")), F.lit(9))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    top = read(spark, d, "orders").withColumn("day", day).where(on_days(F.col("day"), "1996-01-01", "1996-02-29")).orderBy(F.desc("o_orderdate"), rank, "o_orderkey").limit(200)
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return top.join(c, "o_custkey").select("o_orderkey", "o_orderpriority", "day", "c_nationkey")


@R.add("SELECT event_type, user_id % 5 AS lane, count(*) AS n FROM events GROUP BY ALL")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    """[AG1, CX25]"""
    return read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("lane")).agg(F.count("*").alias("n"))


@R.add("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(event_id % 7)::BIGINT AS calls FROM events GROUP BY ALL")
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    """[AG2, AG9, DT19] Facts are appended and summed; partial sums merge before the shuffle, so no upsert is needed."""
    return read(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("event_id") % 7).alias("calls"))


@R.add("SELECT strftime(ts, '%Y-%m') AS month, sum(event_id % 7)::BIGINT AS calls FROM events GROUP BY ALL")
def usage_by_month(spark: SparkSession, d: str) -> DataFrame:
    """[AG2]"""
    return read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(F.col("event_id") % 7).alias("calls"))


@R.add("SELECT coalesce(sum(o_custkey), 0)::BIGINT AS total, min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last FROM orders WHERE o_orderkey < 0")
def empty_total(spark: SparkSession, d: str) -> DataFrame:
    """[AG3, AG6] A sum over nothing is 0, a minimum is null."""
    o = read(spark, d, "orders").where("o_orderkey < 0")
    return o.agg(F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("total"), F.min("o_orderdate").cast("string").alias("first"), F.max("o_orderdate").cast("string").alias("last"))


@R.add("""SELECT n_name, count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS failed, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS best,
          arg_max(c_name, c_custkey) AS newest FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def health_by_group(spark: SparkSession, d: str) -> DataFrame:
    """[AG4, CX8, WN1] Conditional counts and the newest row of each group in one aggregate; names joined afterwards."""
    per = read(spark, d, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("failed"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("best"), F.max_by("c_name", "c_custkey").alias("newest")
    )
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return per.join(n, "c_nationkey").select("n_name", "customers", "failed", "best", "newest")


@R.add("SELECT DISTINCT event_type, user_id % 3 AS part FROM events")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[AG5, SO2]"""
    return read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("part")).distinct()


@R.add("""SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click,
          count(*) FILTER (event_type = 'none') AS n_none FROM events GROUP BY user_id""")
def conditional_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """[AG8, AG18] Every method has a count, 0 too; no pivot pass over the data is needed for a known list."""
    return read(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == m).alias(f"n_{m}") for m in ("view", "click", "none")])


@R.add("""WITH r AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
          SELECT user_id, run::BIGINT AS run, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL""")
def islands_by_marker(spark: SparkSession, d: str) -> DataFrame:
    """[WN5] A run begins at each marker row."""
    e = read(spark, d, "events")
    return temporal.runs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@R.add("""SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS outcome FROM events""")
def forward_first_match(spark: SparkSession, d: str) -> DataFrame:
    """[WN7] The first outcome among the next 24 rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 24)
    return read(spark, d, "events").select("event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("outcome"))


@R.add("""WITH l AS (SELECT user_id, event_id, lag(event_id) OVER w AS prev, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
          SELECT user_id, event_id, before FROM l WHERE prev IS NOT NULL""")
def next_run_label(spark: SparkSession, d: str) -> DataFrame:
    """[WN6] What one run recognised labels the next; the first has no label."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("prev"), F.lag("event_type").over(w).alias("before")).where("prev is not null").drop("prev")


@R.add("""WITH v AS (SELECT l_suppkey AS g, l_quantity AS v FROM lineitem),
          c AS (SELECT a.g, a.v, count(*) AS n FROM (SELECT DISTINCT g, v FROM v) a JOIN v b ON a.g = b.g AND abs(a.v - b.v) <= 2 GROUP BY ALL),
          best AS (SELECT g, arg_min(v, struct_pack(n := -n, v := v)) AS centre, max(n) AS n FROM c GROUP BY g)
          SELECT best.g AS g, CASE WHEN any_value(n) >= 3 THEN round_even(median(v.v), 0)::BIGINT END AS "offset", any_value(n) AS support
          FROM best JOIN v ON v.g = best.g AND abs(v.v - centre) <= 2 GROUP BY best.g""")
def offset_cluster_median(spark: SparkSession, d: str) -> DataFrame:
    """[AG11] The agreed value of each group: most support within a tolerance, then the smallest centre, half-even median."""
    v = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("v"))
    return temporal.agreed_offset(v, "g", "v", 2.0, 3)


_CHECKS = """checks AS (SELECT user_id AS subject, epoch_us(ts) AS checked, event_type = 'click' AS changed FROM events),
   caps AS (SELECT user_id AS subject, min(epoch_us(ts)) AS captured, min(epoch_us(ts)) - (user_id % 3) * 57600000000 AS ended FROM events GROUP BY user_id)"""


@R.add(f"""WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY checked DESC) AS r FROM checks),
          p AS (SELECT subject, max(checked) AS l, max(checked) FILTER (r = 2) AS b, count(*) FILTER (r <= 2 AND NOT changed) AS same, bool_or(changed) AS churn FROM r GROUP BY subject),
          x AS (SELECT caps.subject, captured, l, churn, CASE WHEN captured > ended + 86400000000 THEN 'late' WHEN same = 2 AND l - b >= 3600000000 THEN 'unchanged'
          WHEN 1704844800000000 >= captured + 172800000000 THEN 'backstop' ELSE 'provisional' END AS reason FROM caps JOIN p ON p.subject = caps.subject)
          SELECT subject, reason <> 'provisional' AS settle, reason = 'backstop' AND churn AS under_churn, reason,
          CASE WHEN reason = 'provisional' THEN least(l + 10800000000, captured + 172800000000) END AS next_check FROM x""")
def settle_decision(spark: SparkSession, d: str) -> DataFrame:
    """[CX10, WN12, SM5, DT10] Each user's events as checks of a capture, judged at a fixed moment."""
    e = read(spark, d, "events").select(F.col("user_id").alias("subject"), F.unix_micros(F.col("ts").cast("timestamp")).alias("checked"), (F.col("event_type") == "click").alias("changed"))
    first = e.groupBy("subject").agg(F.min("checked").alias("captured"))
    captures = first.withColumn("ended", F.col("captured") - (F.col("subject") % 3) * 57_600_000_000)
    return state.settle(captures, e, F.lit(1_704_844_800_000_000))


@R.add("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
          SELECT user_id, event_id, event_type, '{"event_type":"' || old || '"}' AS before, '{"event_type":"' || event_type || '"}' AS after FROM l
          WHERE prev IS NOT NULL AND old IS DISTINCT FROM event_type""")
def change_history(spark: SparkSession, d: str) -> DataFrame:
    """[CX14, DT16, DT18]"""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return state.changes(e, "user_id", ["ts", "event_id"], ["event_type"]).drop("ts")


@R.add("""SELECT user_id, bool_or(event_type = 'purchase') AS is_cancelled, arg_min(CASE WHEN value > 50 THEN value END, event_id) FILTER (value > 50) AS first_value FROM events GROUP BY user_id""")
def sticky_flags_upsert(spark: SparkSession, d: str) -> DataFrame:
    """[AG12, AG13, CX12, CX16] Flags stay set, values are the first known."""
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("is_cancelled"), F.when(F.col("value") > 50, F.col("value")).alias("first_value"))
    return state.resolve_upserts(e, ["user_id"], ["is_cancelled"], ["first_value"], "event_id")


@R.add("SELECT arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, o_custkey FROM orders GROUP BY o_custkey")
def current_of_history(spark: SparkSession, d: str) -> DataFrame:
    """[SRC19, CX15, AG16]"""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return state.current(o, ["o_custkey"], "o_orderkey")


@R.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey - 2 FROM orders WHERE o_orderkey % 3 = 0)")
def supersession_filter(spark: SparkSession, d: str) -> DataFrame:
    """[FLT10, SO3]"""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return state.not_superseded(o, o.where("id % 3 = 0").select((F.col("id") - 2).alias("previous_id")))


@R.add("""SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies, any_value(strlen(text)) AS bytes FROM documents GROUP BY text""")
def content_addressed_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """[SRC17, DT13] One row a content; the digest is shuffled, not the text."""
    x = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return x.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("bytes").alias("bytes"))


@R.add("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'no file' WHEN a.doc_id IS NULL THEN 'no row' ELSE 'differs' END AS fault
          FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, length(text) + (CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) AS n FROM documents WHERE doc_id % 10 <> 4) b
          ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR n <> n_chars""")
def store_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """[SRC18, DT14] Rows with no file, files with no row, and files that differ."""
    docs = read(spark, d, "documents")
    rows = docs.where("doc_id % 10 <> 3").select("doc_id", "n_chars", F.lit(1).alias("row"))
    files = docs.where("doc_id % 10 <> 4").select("doc_id", (F.length("text") + F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)).alias("n"), F.lit(1).alias("file"))
    fault = F.when(F.col("file").isNull(), "no file").when(F.col("row").isNull(), "no row").when(F.col("n") != F.col("n_chars"), "differs")
    return rows.join(files, "doc_id", "full_outer").select("doc_id", fault.alias("fault")).where("fault is not null")


@R.add("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey UNION
          SELECT b.n_name, a.n_name FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey""")
def symmetric_closure(spark: SparkSession, d: str) -> DataFrame:
    """[JN21, SO1, SO2]"""
    n = read(spark, d, "nation")
    pairs = n.select(F.col("n_name").alias("a"), (F.col("n_nationkey") + 1).alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b")), "k").select("a", "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@R.add("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def hierarchy_tree(spark: SparkSession, d: str) -> DataFrame:
    """[JN22] Children gathered under their parent."""
    per = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"))
    return read(spark, d, "region").join(per, "r_regionkey", "left").select("r_name", "children")


@R.add("""WITH l AS (SELECT *, timezone('America/Denver', timezone('UTC', ts)) AS here FROM events)
          SELECT user_id, event_type, CAST(here AS DATE)::VARCHAR AS day, min(event_id) AS first_id FROM l WHERE strftime(here, '%H:%M') >= '05:30' GROUP BY ALL""")
def daily_once_per_subject(spark: SparkSession, d: str) -> DataFrame:
    """[SM6, DT8] One run a subject, task and local day, at the first tick after the daily time."""
    from folioflow.functions.times import due_day

    e = read(spark, d, "events").select("user_id", "event_type", due_day(F.col("ts").cast("timestamp"), "America/Denver", "05:30").cast("string").alias("day"), "event_id")
    return e.where("day is not null").groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("first_id"))


@R.add("""SELECT l_orderkey, CAST(max(l_linenumber) AS INT) AS last_line, arg_max(l_partkey, struct_pack(n := l_linenumber, p := l_partkey)) AS decided FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""")
def last_decided(spark: SparkSession, d: str) -> DataFrame:
    """[WN15, WN14] An item's vote is its last motion that wasn't withdrawn."""
    return read(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_line"), F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("decided"))


@R.add("""WITH i AS (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'O')
          SELECT l_orderkey, CAST(min(n) AS INT) AS first_page, CAST(max(n) AS INT) AS last_page FROM i GROUP BY l_orderkey, g""")
def consecutive_runs(spark: SparkSession, d: str) -> DataFrame:
    """[WN13] Pages whose numbers rise by exactly one are one run."""
    x = read(spark, d, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", F.col("l_linenumber").alias("n"))
    g = F.col("n") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("n"))
    return x.withColumn("g", g).groupBy("l_orderkey", "g").agg(F.min("n").alias("first_page"), F.max("n").alias("last_page")).drop("g")


@R.add("""SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderdate, o_orderkey) AS orders, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def detail_with_children(spark: SparkSession, d: str) -> DataFrame:
    """[CX9, SRC22, JN20] A parent with its ordered children as one value: no query for each parent."""
    row = F.struct("o_orderdate", "o_orderkey")
    per = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    both = read(spark, d, "customer").select("c_custkey").join(per, "c_custkey")
    return both.select("c_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), " ").alias("orders"), F.size("rows").cast("long").alias("n"))


@R.add("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC NULLS LAST, o_orderkey LIMIT 50")
def nulls_last_order(spark: SparkSession, d: str) -> DataFrame:
    """[FLT7, SL1, SL5, SRC2] Top rows by a null-last order."""
    return read(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy(F.col("o_orderstatus").desc_nulls_last(), "o_orderkey").limit(50)
