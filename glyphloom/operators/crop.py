"""Crop and trim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import let, text_lines
from glyphloom.operators.ordering import dense_index, frame_block
from glyphloom.sources.text import reject_reason


def resolve_sides(all_sides=None, top=None, bottom=None, left=None, right=None) -> dict:
    """A uniform width overridden per side; 0 = inactive."""
    base = all_sides or 0
    return {k: base if v is None else v for k, v in (("top", top), ("bottom", bottom), ("left", left), ("right", right))}


def crop_frames(cells: DataFrame, all_sides=None, top=None, bottom=None, left=None, right=None) -> DataFrame:
    """Cut the four sides and renumber the frames from 1.

    The size of the first frame of a clip decides for the whole clip. A clip of
    which nothing would remain stops the job.
    """
    cut = resolve_sides(all_sides, top, bottom, left, right)
    sizes = cells.groupBy("clip_id", "frame_no").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    numbered = dense_index(sizes, ["clip_id"], ["frame_no"], frame_block(), out="new_no", start=1)
    first = sizes.groupBy("clip_id").agg(F.min_by("w", "frame_no").alias("w"), F.min_by("h", "frame_no").alias("h"))
    nothing = (F.col("h") <= cut["top"] + cut["bottom"]) | (F.col("w") <= cut["left"] + cut["right"])
    stop = F.raise_error(F.concat(F.lit("crop leaves nothing of clip "), F.col("clip_id").cast("string"))).cast("int")
    bounds = first.select(
        "clip_id",
        F.when(nothing, stop).otherwise(F.col("h") - cut["bottom"]).alias("row_end"),
        (F.col("w") - cut["right"]).alias("col_end"),
    )
    plan = numbered.select("clip_id", "frame_no", "new_no").join(bounds, "clip_id")
    rest = [c for c in cells.columns if c not in ("clip_id", "frame_no", "row", "col")]
    kept = cells.filter((F.col("row") >= cut["top"]) & (F.col("col") >= cut["left"]))
    return (
        kept.join(plan, ["clip_id", "frame_no"])
        .filter((F.col("row") < F.col("row_end")) & (F.col("col") < F.col("col_end")))
        .select("clip_id", F.col("new_no").alias("frame_no"), (F.col("row") - cut["top"]).alias("row"),
                (F.col("col") - cut["left"]).alias("col"), *rest)
    )


def crop_summary(cropped: DataFrame) -> DataFrame:
    """Per clip: frames, new size, bytes of the text and binary form of all frames."""
    frames = cropped.groupBy("clip_id", "frame_no").agg(
        (F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"), F.count(F.lit(1)).alias("n"),
        F.count("br").alias("backed"))
    text = F.col("n") + F.col("h")
    binary = F.lit(8) + F.col("n") * 4 + F.when(F.col("backed") > 0, F.col("n") * 3 + 1).otherwise(0)
    return frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.max("w").alias("new_width"), F.max("h").alias("new_height"),
        F.sum(text + binary).alias("total_size"))


def trim_text(frames: DataFrame, all_sides=None, top=None, bottom=None, left=None, right=None) -> DataFrame:
    """Trim each text frame by its own size; numbers are kept. Ragged, empty and
    used-up frames come back unchanged with a ``reject_reason``."""
    cut = resolve_sides(all_sides, top, bottom, left, right)

    def cut_lines(v):
        keep_rows = F.greatest(F.lit(0), F.size(v["lines"]) - cut["top"] - cut["bottom"])
        return F.transform(F.slice(v["lines"], F.lit(cut["top"] + 1), keep_rows),
                           lambda s: F.substring(s, F.lit(cut["left"] + 1), v["cols"]))

    sized = let(text_lines(F.col("text")), lambda ls: F.struct(
        ls.alias("lines"), (F.length(F.get(ls, 0)) - cut["left"] - cut["right"]).alias("cols")))
    part = let(sized, cut_lines)
    marked = frames.withColumn("reject_reason", reject_reason("rect", **cut))
    trimmed = F.concat(F.array_join(part, "\n"), F.lit("\n"))
    return marked.withColumn("text", F.when(F.col("reject_reason").isNull(), trimmed).otherwise(F.col("text")))
