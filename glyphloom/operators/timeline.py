"""Time range and constant frame rate over timed frames (``t_us`` microseconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import idiv, parse_timestamp
from glyphloom.operators.ordering import with_frame_idx


def since_start(frames: DataFrame) -> DataFrame:
    """``t_us`` made relative to the first frame of the clip (a combined minimum)."""
    first = frames.groupBy("clip_id").agg(F.min("t_us").alias("_t0"))
    return frames.join(first, "clip_id").withColumn("t_us", F.col("t_us") - F.col("_t0")).drop("_t0")


def range_filter(t_us: Column, start: str | None, end: str | None) -> Column:
    """Predicate for [start, end) given as time strings. Empty or "0" start means
    none, empty end means none; with a start at or past the end the end is dropped."""
    def micros(text):
        return F.round(parse_timestamp(F.lit(text)) * 1e6).cast("bigint")

    has_start, has_end = bool(start) and start != "0", bool(end)
    keep = F.lit(True)
    if has_start:
        keep = keep & (t_us >= micros(start))
    if has_end:
        below = t_us < micros(end)
        keep = keep & (((micros(end) <= micros(start)) | below) if has_start else below)
    return keep


def time_range(frames: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Frames of [start, end); ``t_us`` must be relative to the clip start."""
    return frames.filter(range_filter(F.col("t_us"), start, end))


#: Ticks of one block.
TICKS = 65536


def resample_timeline(frames: DataFrame, fps: int, per_seconds: int = 1) -> DataFrame:
    """Constant rate of ``fps`` ticks per ``per_seconds``: each tick shows the latest
    frame at or before it. Frames must be numbered in time order, first at t = 0.

    A frame holds until the next one, so every frame lists its own ticks; the only
    exchange is the look-up of the next frame, an equi-join on the index. No clip
    is ever sorted as a whole.
    """
    indexed = with_frame_idx(frames).select("clip_id", "frame_no", "frame_idx", "t_us")
    following = indexed.select("clip_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("t_us").alias("_next"))
    span = per_seconds * 1_000_000

    def tick_from(t):  # first tick at or after t
        return idiv(t * fps + (span - 1), span)

    held = indexed.join(following, ["clip_id", "frame_idx"], "left")
    first = tick_from(F.col("t_us"))
    last = F.when(F.col("_next").isNotNull(), tick_from(F.col("_next")) - 1).otherwise(idiv(F.col("t_us") * fps, span))
    # A frame may hold for billions of ticks: blocks of ticks first, spread out, then the ticks of a block.
    blocks = F.when(first <= last, F.sequence(idiv(first, TICKS), idiv(last, TICKS)))
    blocked = held.select("clip_id", "frame_no", first.alias("_first"), last.alias("_last"), F.explode(blocks).alias("_block"))
    ticks = F.sequence(F.greatest("_first", F.col("_block") * TICKS), F.least("_last", F.col("_block") * TICKS + (TICKS - 1)))
    return blocked.select("clip_id", F.explode(ticks).alias("tick"), "frame_no").select(
        "clip_id", (F.col("tick") + 1).alias("new_frame_no"), idiv(F.col("tick") * span, fps).alias("tick_us"), "frame_no")
