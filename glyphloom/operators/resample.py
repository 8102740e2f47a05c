"""Pixels to a grid of another size (triangle filter, exact resize).

The triangle weight of input position i for output position o on an axis of
length n_in -> n_out is ``max(0, 2*max(n_in, n_out) - |(2i+1)*n_out - (2o+1)*n_in|)``
up to a constant factor, so all sums are whole numbers and the result does not
depend on the order of summation. Every pixel lists the outputs it feeds, both
axes at once: no join, one shuffle, combined on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import grid_size, idiv
from glyphloom.schemas import FRAME_KEYS


def with_size(pixels: DataFrame) -> DataFrame:
    """Image width and height as columns; measured only where the scan did not supply them."""
    if {"width", "height"} <= set(pixels.columns):
        return pixels
    size = pixels.groupBy(FRAME_KEYS).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return pixels.join(size, FRAME_KEYS)


def axis_span(at: Column, n_in: Column, n_out: Column) -> Column:
    """The output positions an input position feeds, as an array (never empty)."""
    wide = F.greatest(n_in, n_out) * 2
    centre = (at * 2 + 1) * n_out
    # first o with (2o+1)*n_in > centre - wide; ``lift`` keeps the dividend positive
    lift = idiv(wide + n_in, n_in * 2) + 1
    first = idiv(centre - wide - n_in + n_in * 2 * lift, n_in * 2) - lift + 1
    last = idiv(centre + wide - n_in - 1, n_in * 2)
    return F.sequence(F.greatest(F.lit(0).cast("bigint"), first), F.least(n_out - 1, last))


def axis_weight(at: Column, out: Column, n_in: Column, n_out: Column) -> Column:
    """Whole-number triangle weight, positive on the span."""
    return F.greatest(n_in, n_out) * 2 - F.abs((at * 2 + 1) * n_out - (out * 2 + 1) * n_in)


def resample_to(pixels: DataFrame, out_width: Column, out_height: Column) -> DataFrame:
    """Resampled rgb per output position: clip_id, frame_no, width, height, y, x, r, g, b (new size)."""
    big = {c: F.col(c).cast("bigint").alias(c) for c in ("y", "x", "width", "height")}
    aimed = with_size(pixels).select(
        *FRAME_KEYS, *big.values(), "r", "g", "b", out_width.cast("bigint").alias("_w"), out_height.cast("bigint").alias("_h"))
    y, x, w, h, nw, nh = (F.col(c) for c in ("y", "x", "width", "height", "_w", "_h"))
    # outer explode: the spans are never empty, and a plain one would test that by computing them twice
    fed = aimed.withColumn("oy", F.explode_outer(axis_span(y, h, nh))).withColumn("ox", F.explode_outer(axis_span(x, w, nw)))
    weight = axis_weight(y, F.col("oy"), h, nh) * axis_weight(x, F.col("ox"), w, nw)
    totals = fed.select(*FRAME_KEYS, "_w", "_h", F.col("oy").alias("y"), F.col("ox").alias("x"), "r", "g", "b", weight.alias("w")).groupBy(
        *FRAME_KEYS, "_w", "_h", "y", "x").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"], F.sum("w").alias("w"))
    return totals.select(
        *FRAME_KEYS, F.col("_w").cast("int").alias("width"), F.col("_h").cast("int").alias("height"),
        F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        *[idiv(F.col(c) * 2 + F.col("w"), F.col("w") * 2).cast("int").alias(c) for c in "rgb"])


def resample_to_grid(pixels: DataFrame, columns=None, font_ratio=0.7, cell_width: int = 1, cell_height: int = 1) -> DataFrame:
    """Resample to the target grid, or to grid times cell size for glyph fitting.
    ``columns`` is a number, a Column (per-clip options) or None to keep the width."""
    cols = columns if isinstance(columns, Column) else F.lit(columns).cast("int")
    grid = grid_size(F.col("width"), F.col("height"), cols, font_ratio)
    return resample_to(with_size(pixels), grid["width"] * cell_width, grid["height"] * cell_height)
