"""Which stored row an observation belongs to: by a provider's id, else by what is still unclaimed, else a new row. One batch, several arrivals.

Observations are folded in the order of arrival. A window tells for each place and time whether an unclaimed row is there when an observation comes, as
only the observation before it decides that; then all that belongs to one row is merged by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = ["body_id", "starts_at"]
_PROVIDER = ["portal_source_id", "portal_meeting_id"]


def _tag(kind: str, *parts: str) -> Column:
    return F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def resolve_meetings(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """[CX12, AG12, AG13] row, id, created, n_seen, body_id, starts_at, title, type, is_cancelled, is_continued, portal_source_id, portal_meeting_id,
    template_id: the stored meetings and those that observations add, after all observations have been taken in.

    stored: id and the other columns; observed: arrival (a number that tells rows apart) and the other columns. An observation with a provider's
    id belongs to the row that holds the id, stored or claimed earlier in the batch; else, like one without id, to the only row of its body and
    start that no provider has claimed, which it claims; if there's none, or more than one, it makes a row. The latest observation gives title,
    type and start; flags once set stay set; ids and templates known stay known. row names a row: its stored id, or what made it."""
    bare = F.col("portal_source_id").isNull() & F.col("portal_meeting_id").isNull()
    full = F.col("portal_source_id").isNotNull() & F.col("portal_meeting_id").isNotNull()
    known = stored.where(full).groupBy(*_PROVIDER).agg(F.min("id").alias("known_id"))
    seen = observed.join(known, _PROVIDER, "left")
    # the first sight of an id that no stored row holds is its claim; later ones follow it wherever it went
    first = seen.where(full & F.col("known_id").isNull()).groupBy(*_PROVIDER).agg(F.min_by(F.struct("arrival", *_PLACE), "arrival").alias("f"))
    claims = first.select(F.lit(True).alias("claims"), _tag("p", *_PROVIDER).alias("own"), "f.arrival", *[f"f.{c}" for c in _PLACE])
    alone = seen.where(~full & ~bare).select(F.lit(True).alias("claims"), _tag("o", "arrival").alias("own"), "arrival", *_PLACE)  # half an id claims, but can't be found again
    plain = seen.where(bare).select(F.lit(False).alias("claims"), _tag("o", "arrival").alias("own"), "arrival", *_PLACE)
    unclaimed = stored.where(bare).groupBy(*_PLACE).agg(F.count("*").alias("n_open"), F.min("id").alias("open_id"))
    events = claims.unionByName(alone).unionByName(plain).join(unclaimed, _PLACE, "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    order = Window.partitionBy(*_PLACE).orderBy("arrival")
    placed = events.withColumns({"before": F.lag("claims").over(order), "turn": F.coalesce(F.sum(F.col("claims").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    there = (F.col("n_open") < 2) & F.coalesce(~F.col("before"), F.col("n_open") == 1)
    open_row = F.when((F.col("turn") == 0) & (F.col("n_open") == 1), _tag("s", "open_id")).otherwise(_tag("k", *_PLACE, "turn"))
    row = F.when(F.col("claims"), F.when(there, open_row).otherwise(F.col("own"))).when(F.col("n_open") < 2, open_row).otherwise(F.col("own"))
    decided = placed.select("own", row.alias("row"))
    found = seen.withColumn("own", F.when(full, _tag("p", *_PROVIDER)).otherwise(_tag("o", "arrival"))).join(decided, "own", "left")
    found = found.withColumn("row", F.coalesce("row", _tag("s", "known_id"))).withColumn("id", F.lit(None).cast("long"))
    values = ["body_id", "starts_at", "title", "type", "is_cancelled", "is_continued", *_PROVIDER, "template_id"]
    kept = stored.select(_tag("s", "id").alias("row"), F.lit(None).cast("long").alias("arrival"), "id", *values)
    every = kept.unionByName(found.select("row", F.col("arrival").cast("long").alias("arrival"), "id", *values)).withColumn("at", F.coalesce("arrival", F.lit(-(2**63))))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return (
        every.groupBy("row")
        .agg(F.max("id").alias("id"), F.count("arrival").alias("n_seen"), F.min_by("body_id", "at").alias("body_id"), F.max_by(F.struct("starts_at", "title", "type"), "at").alias("v"), *[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("is_cancelled", "is_continued")], *map(last, (*_PROVIDER, "template_id")))
        .select("row", "id", F.col("id").isNull().alias("created"), "n_seen", "body_id", "v.*", "is_cancelled", "is_continued", *_PROVIDER, "template_id")
    )


def adopt_videos(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """[CX16] row, id, created, n_seen, source_id, platform_id, meeting_id, is_primary, title, url, readiness: the stored videos and those that lists add.

    stored: id and the other columns; listed: arrival (a number that tells rows apart) and the other columns. A listing belongs to the row of its
    own source for the platform's id, else to the oldest row for the id, whoever made it, else it makes one. A row that exists is never renamed: it
    gets what it lacks, a meeting, with it an address, and a readiness where it was unknown. The first video attached to a meeting that has no
    primary one becomes it."""
    oldest = stored.groupBy("platform_id").agg(F.min("id").alias("oldest"))
    own = stored.groupBy("platform_id", "source_id").agg(F.min("id").alias("mine"))
    seen = listed.join(own, ["platform_id", "source_id"], "left").join(oldest, "platform_id", "left").withColumn("id", F.coalesce("mine", "oldest"))
    row = F.when(F.col("id").isNotNull(), _tag("s", "id")).otherwise(_tag("v", "platform_id"))
    values = ["source_id", "platform_id", "meeting_id", "title", "url", "readiness"]
    seen = seen.select(row.alias("row"), "id", F.col("arrival").cast("long").alias("arrival"), F.lit(False).alias("is_primary"), *values)
    every = stored.select(_tag("s", "id").alias("row"), "id", F.lit(None).cast("long").alias("arrival"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"), *values).unionByName(seen)
    every = every.withColumn("at", F.coalesce("arrival", F.lit(-(2**63))))
    first = lambda c, when: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & when, F.col("at"))).alias(c)
    always, is_stored = F.lit(True), F.col("arrival").isNull()
    merged = every.groupBy("row").agg(
        F.max("id").alias("id"), F.count("arrival").alias("n_seen"), F.max("is_primary").alias("was_primary"),
        F.min_by(F.struct("source_id", "platform_id", "title", "url", "readiness", is_stored.alias("was")), "at").alias("f"),
        first("meeting_id", always), F.min_by("url", F.when(F.col("url").isNotNull() & (is_stored | F.col("meeting_id").isNotNull()), F.col("at"))).alias("attached_url"),
        F.min_by("readiness", F.when(F.col("readiness") != "unknown", F.col("at"))).alias("sure"),
    )
    taken = every.where("is_primary and meeting_id is not null").select("meeting_id").distinct()
    attached = every.where("arrival is not null and meeting_id is not null").select("row", "meeting_id", "at").join(merged.select("row", "meeting_id"), ["row", "meeting_id"], "left_semi")
    chosen = attached.join(taken, "meeting_id", "left_anti").groupBy("meeting_id").agg(F.min_by("row", "at").alias("row")).select("row", F.lit(True).alias("chosen"))
    out = merged.join(chosen, "row", "left")
    url = F.when(F.col("f.was"), F.col("attached_url")).otherwise(F.coalesce("f.url", "attached_url"))
    return out.select("row", "id", F.col("id").isNull().alias("created"), "n_seen", "f.source_id", "f.platform_id", "meeting_id", (F.col("was_primary") | F.coalesce("chosen", F.lit(False))).alias("is_primary"), "f.title", url.alias("url"), F.coalesce("sure", "f.readiness").alias("readiness"))
