"""Exact duplicates: work once per distinct content, copy the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_key(content: str):
    """SHA-256 of the bytes; a frame that cannot be read stands for itself."""
    own = F.concat(F.lit("frame:"), F.col("frame_no").cast("string"))
    return F.coalesce(F.sha2(F.col(content).cast("binary"), 256), own)


def dedup_frames(frames: DataFrame, content: str = "raw", confirm_bytes: bool = False) -> DataFrame:
    """The duplicate plan: clip_id, frame_no, ``rep_frame_no`` (the first frame of the
    clip with the same bytes), ``is_duplicate``.

    Only digests are shuffled, never the contents. The representative is a
    map-side-combined minimum, so a group of copies of any size shrinks to one row
    per task before the shuffle. ``confirm_bytes`` puts the bytes themselves in
    the key instead of trusting the digest.
    """
    keyed = frames.select("clip_id", "frame_no", content_key(content).alias("_key"), *(
        [F.coalesce(F.col(content).cast("binary"), F.unhex(F.lit(""))).alias("_bytes")] if confirm_bytes else []))
    keys = [c for c in keyed.columns if c != "frame_no"]
    reps = keyed.groupBy(keys).agg(F.min("frame_no").alias("rep_frame_no"))
    return keyed.join(reps, keys).select(
        "clip_id", "frame_no", "rep_frame_no", (F.col("rep_frame_no") != F.col("frame_no")).alias("is_duplicate"))


def representatives(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Only the frames that need work."""
    return frames.join(plan.filter(~F.col("is_duplicate")), ["clip_id", "frame_no"], "left_semi")


def fanout_duplicates(deduped: DataFrame, results: DataFrame) -> DataFrame:
    """Results computed for representatives, repeated for every frame they stand for."""
    plan = deduped.select("clip_id", "frame_no", "rep_frame_no")
    made = results.withColumnRenamed("frame_no", "rep_frame_no")
    rest = [c for c in results.columns if c not in ("clip_id", "frame_no")]
    return plan.join(made, ["clip_id", "rep_frame_no"]).select("clip_id", "frame_no", "rep_frame_no", *rest)
