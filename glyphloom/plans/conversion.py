"""Image corpora to glyph frames, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import glyph_for_luma, luminance
from glyphloom.operators.fit import fit_cells
from glyphloom.operators.preprocess import apply_filter
from glyphloom.operators.dedup import dedup_frames, fanout_duplicates, representatives
from glyphloom.operators.resample import resample_to_grid
from glyphloom.schemas import DEFAULT_RAMP, FRAME_KEYS
from glyphloom.sources.binary import image_pixels
from glyphloom.sources.text import assemble_text


def image_to_cells(pixels: DataFrame, columns=None, font_ratio=0.7, luminance_threshold: int = 20,
                   ramp: str = DEFAULT_RAMP) -> DataFrame:
    """Pixels to glyph cells with the resampled colour as foreground and no background."""
    grid = resample_to_grid(pixels, columns, font_ratio)
    luma = luminance(F.col("r"), F.col("g"), F.col("b"))
    none = F.lit(None).cast("int")
    return grid.select(
        *FRAME_KEYS, F.col("y").alias("row"), F.col("x").alias("col"), glyph_for_luma(luma, luminance_threshold, ramp).alias("glyph"),
        F.col("r").alias("fr"), F.col("g").alias("fg"), F.col("b").alias("fb"),
        none.alias("br"), none.alias("bg"), none.alias("bb"))


def image_to_text(pixels: DataFrame, **options) -> DataFrame:
    """Pixels to text frames."""
    return assemble_text(image_to_cells(pixels, **options))


def fit_cell_backgrounds(pixels: DataFrame, atlas: DataFrame, cell_width: int, cell_height: int, columns=None, font_ratio=0.7,
                         luminance_threshold: int = 20, bg_luminance: int | None = None, ramp: str = DEFAULT_RAMP) -> DataFrame:
    """Pixels to cells with fitted foreground and background. The resolution of the
    coverage table is the quality setting: a smaller one is faster and coarser."""
    grid = resample_to_grid(pixels, columns, font_ratio, cell_width, cell_height)
    return fit_cells(grid, atlas, ramp, cell_width, cell_height, luminance_threshold, bg_luminance)


def convert_images(images: DataFrame, **options) -> DataFrame:
    """Decoded images (see ``scan_image_files``) to cells, each distinct image converted once."""
    shape = F.encode(F.concat_ws("x", "width", "height", "channels"), "UTF-8")
    deduped = dedup_frames(images.withColumn("_bytes_seen", F.concat(shape, F.col("data"))), content="_bytes_seen")
    cells = image_to_cells(image_pixels(representatives(images, deduped)), **options)
    return fanout_duplicates(deduped, cells).drop("rep_frame_no")


def preprocess_corpus(pixels: DataFrame, preset: str | None = None, steps: list | None = None, path: str | None = None) -> DataFrame:
    """Filter every image of a corpus, frame numbers kept; written by clip when a path is given."""
    filtered = apply_filter(pixels, preset, steps)
    if path is not None:
        filtered.write.partitionBy("clip_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return filtered
