"""Reports that put several tables together: how captures went, and whole meetings as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a meeting may lack, and the note that says so.
NOTES = {"items": "no agenda item is known", "documents": "no document is stored", "videos": "no video is linked", "votes": "no vote is recorded"}


def capture_health(bodies: DataFrame, videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """[CX8] body_id, body, videos, pending, failed, last_video, last_state, last_at, last_is_provisional, last_settled_under_churn: one row a body.

    The newest capture and its state are one video's, taken whole by one aggregate. Its captions are its settled transcript before a provisional
    one, then the latest. videos: video_id, body_id, captured_at, capture_state; transcripts: video_id, transcript_id, is_provisional,
    settled_under_churn. No window: bodies with very many videos are summed up where the rows lie."""
    best = transcripts.groupBy("video_id").agg(F.min_by(F.struct("is_provisional", "settled_under_churn"), F.struct("is_provisional", -F.col("transcript_id"))).alias("t"))
    newest = F.max_by(F.struct("video_id", "capture_state", "captured_at"), F.struct("captured_at", "video_id")).alias("x")
    counts = videos.groupBy("body_id").agg(F.count("*").alias("videos"), F.count_if(F.col("capture_state") == "pending").alias("pending"), F.count_if(F.col("capture_state").isin("failed", "skipped")).alias("failed"), newest)
    whole = bodies.join(counts, "body_id", "left").withColumn("video_id", F.col("x.video_id")).join(best, "video_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.select("body_id", "body", n("videos"), n("pending"), n("failed"), F.col("x.video_id").alias("last_video"), F.col("x.capture_state").alias("last_state"), F.col("x.captured_at").alias("last_at"), F.col("t.is_provisional").alias("last_is_provisional"), F.col("t.settled_under_churn").alias("last_settled_under_churn"))


def snapshots(meetings: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """[CX9, SRC22] meeting_id, revision, snapshot: each meeting with its children as one JSON document, lists in order, with notes on what is lacking.

    children: by name, rows with a meeting_id and the columns that order them. A list without rows is an empty list; of those that NOTES
    names, its note is told."""
    out = meetings
    for name, (rows, order) in children.items():
        fields = [c for c in rows.columns if c != "meeting_id"]
        listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
        out = out.join(rows.groupBy("meeting_id").agg(listed.alias(name)), "meeting_id", "left").withColumn(name, F.coalesce(name, F.array()))
    notes = F.array_compact(F.array(*[F.when(F.size(name) == 0, NOTES[name]) for name in children if name in NOTES]))
    whole = F.to_json(F.struct(*meetings.columns, *children, notes.alias("notes")))
    return out.select("meeting_id", "revision", whole.alias("snapshot"))
