"""Captions that change: new versions, what they make stale, and the next check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.state import settle


def new_versions(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """[CX11] video_id, sha256, seen: bytes that the video's transcripts don't hold yet, once each, at their first sight.
    A source that goes back to bytes already stored gives no row. observed: video_id, sha256, seen; stored: video_id, sha256."""
    fresh = observed.join(stored.select("video_id", "sha256"), ["video_id", "sha256"], "left_anti")
    return fresh.groupBy("video_id", "sha256").agg(F.min("seen").alias("seen"))


def stale_marks(versions: DataFrame, dependents: DataFrame, marks: DataFrame) -> DataFrame:
    """[CX11] kind, row_id, reason: rows read from an older transcript of a video that has a new version; each reason once.
    dependents: kind, row_id, video_id, sha256 (of what it was read from); marks: kind, row_id, reason."""
    latest = versions.groupBy("video_id").agg(F.max_by("sha256", F.struct("seen", "sha256")).alias("now"))
    old = dependents.join(latest, "video_id").where("sha256 <> now").select("kind", "row_id", F.concat(F.lit("captions changed: "), "now").alias("reason"))
    return old.join(marks.select("kind", "row_id", "reason"), ["kind", "row_id", "reason"], "left_anti").distinct()


def caption_sources(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """[CX24, JN4] video_id, transcript_id, from_video, hand_off: a video's own latest transcript, else that of another video of the same
    meeting (the smallest id), else a transcription to be queued, with its reason. videos: video_id, meeting_id; transcripts: video_id, transcript_id, at."""
    latest = transcripts.groupBy("video_id").agg(F.max_by("transcript_id", "at").alias("transcript_id"))
    own = videos.join(latest, "video_id", "left")
    per_meeting = own.where("transcript_id is not null and meeting_id is not null").groupBy("meeting_id").agg(F.min(F.struct("video_id", "transcript_id")).alias("sister"))
    x = own.join(per_meeting, "meeting_id", "left")
    source = F.when(F.col("transcript_id").isNotNull(), F.col("video_id")).otherwise(F.col("sister.video_id"))
    reason = F.when(source.isNotNull(), None).when(F.col("meeting_id").isNull(), "no meeting is known").otherwise("no video of the meeting has captions")
    return x.select("video_id", F.coalesce("transcript_id", "sister.transcript_id").alias("transcript_id"), source.alias("from_video"), reason.alias("hand_off"))


def recheck(captures: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """[CX23] subject, n_checks, n_revisions, settle, under_churn, reason, next_check: each observation is compared with the one before (the first
    with the capture), counts as a check, and as a revision if it differs; the capture is then settled or checked again.

    captures: subject, captured, ended, sha256; observations: subject, checked, sha256."""
    order = Window.partitionBy("subject").orderBy("checked")
    before = F.coalesce(F.lag("sha256").over(order), F.col("first_sha"))
    known = observations.join(captures.select("subject", F.col("sha256").alias("first_sha")), "subject")
    checks = known.withColumn("changed", ~F.col("sha256").eqNullSafe(before)).select("subject", "checked", "changed")
    counts = checks.groupBy("subject").agg(F.count("*").alias("n_checks"), F.count_if("changed").alias("n_revisions"))
    decided = settle(captures.select("subject", "captured", "ended"), checks, now)
    return decided.join(counts, "subject", "left").select("subject", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("n_revisions", F.lit(0)).alias("n_revisions"), "settle", "under_churn", "reason", "next_check")
