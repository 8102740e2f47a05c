"""Comparison of two runs and choice of the frame source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import let, text_lines
from glyphloom.operators.ordering import frames_apart
from glyphloom.schemas import CELL_KEYS, FRAME_KEYS, PIXEL_KEYS


def compare_runs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Four checks per clip over text frames: total size, frame count, height and width of the first frame."""
    def facts(frames, tag):
        sized = frames.select("clip_id", "frame_no", F.octet_length("text").alias("bytes"), let(text_lines(F.col("text")), lambda ls: F.struct(
            F.size(ls).alias("h"), F.length(F.get(ls, 0)).alias("w"))).alias("s"))
        return sized.groupBy("clip_id").agg(
            F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("count"), F.min_by(F.col("s.h"), "frame_no").alias("h"), F.min_by(F.col("s.w"), "frame_no").alias("w"),
        ).select("clip_id", F.array(F.col("size"), F.col("count"), F.col("h").cast("bigint"), F.col("w").cast("bigint")).alias(tag))

    both = facts(expected, "e").join(facts(actual, "a"), "clip_id", "full_outer")
    names = F.lit(["total_size", "frame_count", "frame_height", "frame_width"])
    rows = both.select("clip_id", F.posexplode(names).alias("i", "check_name"), "e", "a")
    left, right = F.col("e")[F.col("i")], F.col("a")[F.col("i")]
    return rows.select("clip_id", "check_name", left.alias("expected"), right.alias("actual"),
                       F.when(left == right, "PASSED").otherwise("FAILED").alias("result"))


def diff_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per cell: absolute channel differences and whether both sides are equal (missing on one side = different)."""
    channels = ["fr", "fg", "fb", "br", "bg", "bb"]
    a = left.select(*CELL_KEYS, F.struct("glyph", *channels).alias("l"))
    b = right.select(*CELL_KEYS, F.struct("glyph", *channels).alias("r"))
    joined = a.join(b, CELL_KEYS, "full_outer")
    return joined.select(*CELL_KEYS, F.col("l").eqNullSafe(F.col("r")).alias("same"),
                         *[F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")).alias(f"d_{c}") for c in channels])


def diff_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per frame: identical?, differing cells, largest and total channel difference."""
    channels = ["fr", "fg", "fb", "br", "bg", "bb"]
    parts = [F.coalesce(F.col(f"d_{c}"), F.lit(0)) for c in channels]
    return diff_cells(left, right).groupBy(FRAME_KEYS).agg(
        F.bool_and("same").alias("identical"), F.count_if(~F.col("same")).alias("cells_different"),
        F.max(F.greatest(*parts)).alias("max_difference"), F.sum(sum(parts[1:], parts[0])).alias("total_difference"))


def diff_pixels(left: DataFrame, right: DataFrame, met: bool = False) -> DataFrame:
    """The difference image of two runs: absolute channel differences per pixel (null where one run has no such
    pixel) and whether both are equal. A pixel is one row of each run; the runs meet by frame in one exchange, without a sort.
    Runs made of frames that were spread alike while compact have ``met``: their pixels stay where they are."""
    sides = [run.select(*PIXEL_KEYS, *[(F.col(c) if side == mine else F.lit(None)).cast("int").alias(f"{side}_{c}") for side in "lr" for c in "rgb"])
             for mine, run in (("l", left), ("r", right))]
    both = sides[0].unionByName(sides[1])
    paired = (both if met else frames_apart(both)).groupBy(PIXEL_KEYS).agg(*[F.max(f"{side}_{c}").alias(f"{side}_{c}") for side in "lr" for c in "rgb"])
    apart = [F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")).alias(c) for c in "rgb"]
    return paired.select(*PIXEL_KEYS, *apart, F.coalesce(sum(apart[1:], apart[0]) == 0, F.lit(False)).alias("same"))


def diff_images(left: DataFrame, right: DataFrame, met: bool = False) -> DataFrame:
    """Per frame of two rasterised runs: identical?, differing pixels, largest and total channel difference."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in "rgb"]
    return diff_pixels(left, right, met).groupBy(FRAME_KEYS).agg(
        F.bool_and("same").alias("identical"), F.count_if(~F.col("same")).alias("pixels_different"),
        F.max(F.greatest(*parts)).alias("max_difference"), F.sum(sum(parts[1:], parts[0])).alias("total_difference"))


def frame_source_choice(files: DataFrame, use_colors: bool | None = None) -> DataFrame:
    """Per clip: render from colour frames if there are any, else from text; colours
    follow the source unless overridden. ``files``: clip_id, kind ("text" or "color")."""
    seen = files.groupBy("clip_id").agg(F.bool_or(F.col("kind") == "color").alias("has_color"), F.count_if(F.col("kind") == "text").alias("n_text"),
                                        F.count_if(F.col("kind") == "color").alias("n_color"))
    colored = F.col("has_color")
    return seen.select(
        "clip_id", F.when(colored, "color").otherwise("text").alias("source"),
        F.when(colored, F.col("n_color")).otherwise(F.col("n_text")).alias("frames"),
        F.coalesce(F.lit(use_colors).cast("boolean"), colored).alias("use_colors"))
