"""Queries about evidence: text windows, set facts, identifiers, unique matches and packs, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.plans.common import Registry, read

R = Registry()

#: Model calls that a unit of each kind of work takes.
CALLS = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}
MINUTE = 60_000_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


@R.add("""SELECT o_orderpriority AS task, count(*) AS units, CAST(count(*) * max(c) AS BIGINT) AS calls FROM orders
          JOIN (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('3-MEDIUM', 1)) v(p, c) ON p = o_orderpriority GROUP BY o_orderpriority""")
def weighted_estimate(spark: SparkSession, d: str) -> DataFrame:
    """[AG10] Units times calls a unit; the constants are part of the plan, so nothing is joined."""
    calls = F.create_map(*[F.lit(x) for pair in CALLS.items() for x in pair])
    counted = read(spark, d, "orders").where(F.col("o_orderpriority").isin(*CALLS)).groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("units"))
    return counted.withColumn("calls", (F.col("units") * calls[F.col("task")]).cast("long"))


@R.add("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """[AG16] The last row of each user, by an aggregate that is combined before the shuffle."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return read(spark, d, "events").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_id", "x.event_type")


@R.add("""SELECT source, count(*) AS n, count(*) FILTER (length(text) < 50) AS n_short, count(*) FILTER (contains(text, 'http')) AS n_linked FROM documents GROUP BY source""")
def page_counters(spark: SparkSession, d: str) -> DataFrame:
    """[AG17]"""
    t = F.col("text")
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length(t) < 50).alias("n_short"), F.count_if(t.contains("http")).alias("n_linked"))


@R.add("""SELECT conv_id, turn, CASE WHEN a LIKE '%?' OR b IS NULL THEN a WHEN b LIKE '%?' OR c IS NULL THEN a || ' ' || b ELSE a || ' ' || b || ' ' || c END AS said FROM (
          SELECT conv_id, turn, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER w AS b, lead(coalesce(text, ''), 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def lines_to_question(spark: SparkSession, d: str) -> DataFrame:
    """[WN8] Up to three turns, until one ends with a question mark."""
    near = F.collect_list(F.coalesce("text", F.lit(""))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 2))
    asks = F.array_position(F.transform("near", lambda t: t.endswith("?")), True)
    kept = F.when(asks > 0, F.slice("near", F.lit(1), asks.cast("int"))).otherwise(F.col("near"))
    return read(spark, d, "conversations").select("conv_id", "turn", near.alias("near")).select("conv_id", "turn", F.array_join(kept, " ").alias("said"))


@R.add("""SELECT event_id, array_to_string(list_sort(list(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 20 MINUTE PRECEDING AND INTERVAL 20 MINUTE FOLLOWING)), ',') AS near FROM events""")
def time_window_text(spark: SparkSession, d: str) -> DataFrame:
    """[WN9] What the same user did within twenty minutes, by a range window: no range join. The list is the answer, so one
    user's rows of forty minutes must fit a row."""
    w = Window.partitionBy("user_id").orderBy(_micros(F.col("ts"))).rangeBetween(-20 * MINUTE, 20 * MINUTE)
    return read(spark, d, "events").select("event_id", F.array_sort(F.collect_list("event_id").over(w)).alias("ids")).select("event_id", F.array_join("ids", ",").alias("near"))


@R.add("""WITH c AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'signup')
          SELECT c.event_id, count(e.event_id) AS n, min(e.event_id) AS least FROM c LEFT JOIN events e ON e.user_id = c.user_id AND e.event_type <> 'signup'
          AND e.ts >= c.ts AND e.ts <= c.ts + INTERVAL 6 HOUR AND (until IS NULL OR e.ts < until) GROUP BY c.event_id""")
def forward_to_next_cue(spark: SparkSession, d: str) -> DataFrame:
    """[WN10] From each cue, the rows within six hours, cut at the user's next cue."""
    at = _micros(F.col("ts"))
    base = read(spark, d, "events").select("event_id", "user_id", at.alias("at"), (F.col("event_type") == "signup").alias("cue"))
    order = Window.partitionBy("user_id").orderBy("at", F.desc("cue"), "event_id")
    # each row belongs to the cue before it, if that is near enough; so a cue's rows end at the next cue
    dealt = base.withColumn("to", F.last(F.when(F.col("cue"), F.struct("event_id", "at")), ignorenulls=True).over(order))
    inside = ~F.col("cue") & (F.col("at") <= F.col("to.at") + 360 * MINUTE)
    found = dealt.where("to is not null").groupBy("to.event_id").agg(F.count_if(inside).alias("n"), F.min(F.when(inside, F.col("event_id"))).alias("least"))
    return base.where("cue").select("event_id").join(found, "event_id")


@R.add("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def current_less_superseded(spark: SparkSession, d: str) -> DataFrame:
    """[SO3] An anti join, which both keys of an exchange can serve."""
    gone = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


_NUMBERS = "list_sort(list_distinct(regexp_extract_all(coalesce({}, ''), '[0-9]+')))"
_WORDS = "list_sort(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]+')))"


@R.add(f"""SELECT conv_id, turn, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ' ') AS shared, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS inside,
          array_to_string(list_filter(n, lambda x: NOT list_contains(m, x)), ' ') AS dropped, array_to_string(list_filter(m, lambda x: NOT list_contains(n, x)), ' ') AS added FROM (
          SELECT conv_id, turn, {_WORDS.format("text")} AS a, {_WORDS.format("after")} AS b, {_NUMBERS.format("text")} AS n, {_NUMBERS.format("after")} AS m FROM (
          SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations))""")
def facts_between_turns(spark: SparkSession, d: str) -> DataFrame:
    """[SO4, SO5, SO7, ST27] Words two turns share, whether the first's are all in the second, and numbers dropped and added."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    found = lambda c, p: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0))))
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text", after.alias("after"))
    sets = rows.select("conv_id", "turn", found(F.lower("text"), "[a-z]+").alias("a"), found(F.lower("after"), "[a-z]+").alias("b"), found(F.col("text"), "[0-9]+").alias("n"), found(F.col("after"), "[0-9]+").alias("m"))
    return sets.select(
        "conv_id",
        "turn",
        F.array_join(F.array_sort(F.array_intersect("a", "b")), " ").alias("shared"),
        (F.size(F.array_except("a", "b")) == 0).alias("inside"),
        F.array_join(F.array_except("n", "m"), " ").alias("dropped"),
        F.array_join(F.array_except("m", "n"), " ").alias("added"),
    )


@R.add("""SELECT o_orderkey, c_custkey, 'C-' || c_custkey AS canonical FROM customer JOIN orders ON CAST(regexp_extract(c_name, '#0*([0-9]+)', 1) AS BIGINT) = o_custkey""")
def identifier_join(spark: SparkSession, d: str) -> DataFrame:
    """[ST8, JN18] Identifiers read from names, joined by equality of their canonical spelling."""
    number = F.regexp_extract("c_name", "#0*([0-9]+)", 1).cast("long")
    named = read(spark, d, "customer").select("c_custkey", number.alias("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(named, "o_custkey").select("o_orderkey", "c_custkey", F.concat(F.lit("C-"), F.col("c_custkey")).alias("canonical"))


@R.add(r"""SELECT doc_id, regexp_matches(lower(text), '\bcancell?ed\b') AS cancelled, regexp_matches(lower(text), '\bcontinued\b') AS continued,
          CASE WHEN regexp_matches(lower(text), '\b(failed|fails)\b') THEN 'failed' WHEN regexp_matches(lower(text), '\b(passed|passes|carried)\b') THEN 'passed' ELSE 'unknown' END AS result FROM documents""")
def status_signals(spark: SparkSession, d: str) -> DataFrame:
    """[ST18, ST24] Whole words only; a word for failure beats one for success."""
    low = F.lower("text")
    result = F.when(low.rlike(r"\b(failed|fails)\b"), "failed").when(low.rlike(r"\b(passed|passes|carried)\b"), "passed").otherwise("unknown")
    return read(spark, d, "documents").select("doc_id", low.rlike(r"\bcancell?ed\b").alias("cancelled"), low.rlike(r"\bcontinued\b").alias("continued"), result.alias("result"))


@R.add("""SELECT doc_id, sha256(text) AS sha, sha256(text) = min(sha256(text)) OVER (PARTITION BY source, n_chars) AS verified FROM documents""")
def hash_verification(spark: SparkSession, d: str) -> DataFrame:
    """[DT13, DT14] Each text's digest against the one held for its source and size; the text itself isn't shuffled."""
    rows = read(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("sha"))
    return rows.select("doc_id", "sha", (F.col("sha") == F.min("sha").over(Window.partitionBy("source", "n_chars"))).alias("verified"))


@R.add("""SELECT event_id, coalesce(json_valid(props), false) AS valid, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_guard(spark: SparkSession, d: str) -> DataFrame:
    """[DT15] A broken object gives no value, not an error."""
    valid = F.get_json_object("props", "$").isNotNull()
    return read(spark, d, "events").select("event_id", valid.alias("valid"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@R.add("""WITH m AS (SELECT event_id, o_orderkey, o_orderdate::DATE = ts::DATE AS exact FROM events LEFT JOIN orders ON o_custkey = user_id AND abs(date_diff('day', o_orderdate::DATE, ts::DATE)) <= 1),
          n AS (SELECT event_id, count(*) FILTER (exact) AS same, count(o_orderkey) AS near, min(o_orderkey) FILTER (exact) AS a, min(o_orderkey) AS b FROM m GROUP BY event_id)
          SELECT event_id, CASE WHEN same = 1 THEN a WHEN same = 0 AND near = 1 THEN b END AS order_id, CASE WHEN same = 1 OR same = 0 AND near = 1 THEN 'linked' WHEN near = 0 THEN 'none' ELSE 'several' END AS reason FROM n""")
def unique_within_a_day(spark: SparkSession, d: str) -> DataFrame:
    """[JN16] The one order of that user and day, else of a day beside it; two matches give none, with the reason.

    Days are spread to three keys, so it's an equi join on user and day, not a range join."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.to_date("ts").alias("own"))
    spread = e.select("event_id", "o_custkey", "own", F.explode(F.sequence(F.date_sub("own", 1), F.date_add("own", 1))).alias("day"))
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    exact = F.col("day") == F.col("own")
    found = spread.join(o, ["o_custkey", "day"], "left").groupBy("event_id").agg(F.count(F.when(exact, F.col("o_orderkey"))).alias("same"), F.count("o_orderkey").alias("near"), F.min(F.when(exact, F.col("o_orderkey"))).alias("a"), F.min("o_orderkey").alias("b"))
    one, beside = F.col("same") == 1, (F.col("same") == 0) & (F.col("near") == 1)
    reason = F.when(one | beside, "linked").when(F.col("near") == 0, "none").otherwise("several")
    return found.select("event_id", F.when(one, F.col("a")).when(beside, F.col("b")).alias("order_id"), reason.alias("reason"))


@R.add("""WITH i AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
          n AS (SELECT event_id, event_type, k, min(k) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later,
          max(k) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sooner FROM i)
          SELECT event_id, coalesce(later, sooner) AS nearest FROM n WHERE event_type <> 'purchase'""")
def nearest_by_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """[JN19] The nearest labelled row at or after each row, else the nearest before; one sort serves all three windows."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.row_number().over(order).alias("k"))
    label = F.when(F.col("event_type") == "purchase", F.col("k"))
    later = F.min(label).over(order.rowsBetween(0, Window.unboundedFollowing))
    sooner = F.max(label).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event_id", "event_type", F.coalesce(later, sooner).cast("long").alias("nearest")).where("event_type <> 'purchase'").drop("event_type")


@R.add("""SELECT conv_id, count(*) FILTER (k > 3) AS n_dropped, string_agg('[E' || k || '] ' || coalesce(text, ''), chr(10) ORDER BY k) FILTER (k <= 3) AS pack FROM (
          SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id""")
def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    """Stable handles for the first three lines of each conversation, and how many are beyond."""
    lines = read(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = lines.withColumn("k", F.row_number().over(order)).where("k <= 3")  # Spark keeps three rows a conversation before the shuffle
    told = F.concat(F.lit("[E"), F.col("k").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    packs = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", told.alias("t")))).alias("xs"))
    sizes = lines.groupBy("conv_id").agg(F.greatest(F.count("*") - 3, F.lit(0).cast("long")).alias("n_dropped"))
    return sizes.join(packs, "conv_id").select("conv_id", "n_dropped", F.array_join(F.transform("xs", lambda x: x["t"]), "\n").alias("pack"))
