"""State as data: what is missing, settled, superseded or published is derived from append-only rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.times import next_midnight
from folioflow.operators.closure import reached
from folioflow.operators.placing import running_total

HOUR = 3_600_000_000


def missing(wanted: DataFrame, present: DataFrame, key: str, age_us: Column, after_hours: int = 36) -> DataFrame:
    """[JN10, DT3] Rows that are old enough (the bound included) and have no record."""
    return wanted.where(age_us >= after_hours * HOUR).join(present.select(key).distinct(), key, "left_anti")


def sync_state(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """[CX7] keys, state, change: open, fill, reopen or keep each finding; none is ever deleted. stored: keys, state."""
    both = stored.select(*keys, F.col("state").alias("_was")).join(wanted.select(*keys, F.lit(True).alias("_gap")), keys, "full_outer")
    change = F.when(F.col("_was").isNull(), "opened").when(F.col("_gap").isNull() & (F.col("_was") == "open"), "filled").when(F.col("_gap").isNotNull() & (F.col("_was") == "filled"), "reopened").otherwise("kept")
    return both.select(*keys, F.when(F.col("_gap").isNull(), "filled").otherwise("open").alias("state"), change.alias("change"))


def settle(captures: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """[CX10, WN12, SM5] subject, settle, under_churn, reason, next_check of captures (subject, captured, ended) with their
    checks (subject, checked, changed); times are micro-seconds.

    Late captures (over 24 h after the end) and two last checks unchanged an hour apart settle; 48 h settle anything."""
    order = Window.partitionBy("subject").orderBy(F.desc("checked"))
    ranked = checks.withColumn("_r", F.row_number().over(order))
    per = ranked.groupBy("subject").agg(
        F.max("checked").alias("last"),
        F.max(F.when(F.col("_r") == 2, F.col("checked"))).alias("before"),
        F.count_if((F.col("_r") <= 2) & ~F.col("changed")).alias("same"),
        F.max("changed").alias("churn"),
    )
    x = captures.join(per, "subject", "left")
    late = F.coalesce(F.col("captured") > F.col("ended") + 24 * HOUR, F.lit(False))
    pair = F.coalesce((F.col("same") == 2) & (F.col("last") - F.col("before") >= HOUR), F.lit(False))
    backstop = F.col("captured") + 48 * HOUR
    reason = F.when(late, "late").when(pair, "unchanged").when(now >= backstop, "backstop").otherwise("provisional")
    out = x.withColumn("reason", reason)
    due = F.least(F.coalesce("last", "captured") + 3 * HOUR, backstop)
    return out.select("subject", (F.col("reason") != "provisional").alias("settle"), ((F.col("reason") == "backstop") & F.coalesce("churn", F.lit(False))).alias("under_churn"), "reason", F.when(F.col("reason") == "provisional", due).alias("next_check"))


def changes(versions: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """[CX14, DT16, DT18] versions that differ from the one before, with JSON of both states; null equals null."""
    w = Window.partitionBy(key).orderBy(*order)
    old = versions.withColumn("_old", F.lag(F.struct(*columns)).over(w)).where("_old is not null")
    return old.where(~F.struct(*columns).eqNullSafe(F.col("_old"))).withColumn("before", F.to_json("_old")).withColumn("after", F.to_json(F.struct(*columns))).drop("_old")


def current(history: DataFrame, keys: list[str], version: str) -> DataFrame:
    """[SRC19, CX15, AG16] The row of the latest version for each key, by a map-side aggregate."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row")).select(*keys, "_row.*")


def not_superseded(records: DataFrame, revisions: DataFrame, id_: str = "id") -> DataFrame:
    """[FLT10, SO3] records that are nobody's previous version."""
    return records.join(revisions.select(F.col("previous_id").alias(id_)), id_, "left_anti")


def revision_group(edges: DataFrame, start: list[int]) -> DataFrame:
    """[SO2, SO8] All ids of the chains that `start` is in, by the components of all chains: rounds grow with the logarithm of the longest."""
    ids = edges.sparkSession.createDataFrame([(i,) for i in start], "node long")
    return reached(edges.select(F.col("id").alias("a"), F.col("previous_id").alias("b")), ids).select(F.col("node").alias("id"))


def quota(uses: DataFrame, at: str, then: list[str], limit: int, zone: str = "America/Los_Angeles") -> DataFrame:
    """[DT9, DT19] then, used (so far in the local day), blocked, until (seconds of the midnight at which a block ends).

    The count is a running total by ranges, so one day's uses may be any number."""
    dated = uses.select(*then, at, F.to_date(F.from_utc_timestamp(at, zone)).alias("_day"))
    out = running_total(dated, ["_day"], [at, *then], F.lit(1).cast("long"), "used").withColumn("blocked", F.col("used") > limit)
    return out.select(*then, "used", "blocked", F.when(F.col("blocked"), F.unix_seconds(next_midnight(F.col(at), zone))).alias("until"))


def resolve_upserts(observed: DataFrame, keys: list[str], flags: list[str], values: list[str], arrival: str) -> DataFrame:
    """[AG12, AG13, CX12] One row a key: flags once set stay set, values are the first that aren't null."""
    order = F.col(arrival)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    return observed.groupBy(*keys).agg(*[F.max(c).alias(c) for c in flags], *first)


def new_requests(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """[CX19] Requests with no queued or running job of the same kind and payload."""
    return wanted.join(jobs.where(F.col("state").isin("queued", "running")).select("kind", "payload"), ["kind", "payload"], "left_anti")


def stale(jobs: DataFrame, now: Column, after_us: int) -> DataFrame:
    """[SM1] Running jobs whose heartbeat is older than that, as they go back to the queue."""
    out = jobs.where((F.col("state") == "running") & (F.col("heartbeat") < now - after_us))
    return out.withColumn("state", F.lit("queued")).withColumn("attempts", F.col("attempts") + 1)


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """[FLT9, SM2] Queued jobs that may start: no time set, or it has come."""
    return jobs.where((F.col("state") == "queued") & (F.col("run_after").isNull() | (F.col("run_after") <= now)))
