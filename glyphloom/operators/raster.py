"""Cells back to pixels through a glyph coverage table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import blend_channel, idiv
from glyphloom.operators.fit import dense_atlas, small_enough
from glyphloom.schemas import FRAME_KEYS


def thicken_atlas(atlas: DataFrame, stroke_width: float) -> DataFrame:
    """Coverage widened by a stroke of 0..1.5 pixels (works on the small table only)."""
    radius = min(1.5, max(0.0, stroke_width))
    if radius == 0.0:
        return atlas
    reach = int(-(-radius // 1))
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)
             if dy * dy + dx * dx <= radius * radius + 0.0001]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"),
                                 F.lit(1.0 if dy == dx == 0 else min(1.0, radius / (dy * dy + dx * dx) ** 0.5)).alias("s"))
                        for dy, dx in steps])
    spread = atlas.withColumn("o", F.explode(offsets)).select(
        "glyph", (F.col("py") + F.col("o.dy")).alias("py"), (F.col("px") + F.col("o.dx")).alias("px"), (F.col("alpha") * F.col("o.s")).alias("alpha"))
    widened = spread.groupBy("glyph", "py", "px").agg(F.max("alpha").alias("alpha"))
    return widened.join(atlas.select("glyph", "py", "px"), ["glyph", "py", "px"], "left_semi")


def rasterise_cells(cells: DataFrame, atlas: DataFrame, cell_width: int, cell_height: int,
                    use_colors: bool = True, stroke_width: float = 0.0) -> DataFrame:
    """Background fill (also under spaces), then the glyph blended on it; white where
    colours are off or missing, black where nothing is drawn, sizes padded to even.

    Each cell writes its own pixels: one row per glyph of the table carries the
    whole coverage as an array, so the join has one small side and no shuffle.
    """
    table = dense_atlas(thicken_atlas(atlas, stroke_width), cell_width, cell_height)
    level = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(F.col("alpha") * 255.0))).cast("int")
    spots = F.array_sort(F.collect_list(F.struct("py", "px", level.alias("a"))))
    masks = table.groupBy("glyph").agg(F.transform(spots, lambda s: s["a"]).alias("mask"))
    masks = F.broadcast(masks) if small_enough(table) else masks
    n = cell_width * cell_height
    lit_cells = cells.join(masks, "glyph", "left").select(
        *FRAME_KEYS, "row", "col", *[(F.coalesce(F.col(f"f{c}"), F.lit(255)) if use_colors else F.lit(255)).alias(f"f{c}") for c in "rgb"],
        *[F.coalesce(F.col(f"b{c}"), F.lit(0)).alias(f"b{c}") for c in "rgb"],
        F.posexplode(F.coalesce("mask", F.array_repeat(F.lit(0), n))).alias("p", "a"))
    drawn = lit_cells.select(
        *FRAME_KEYS,
        (F.col("row") * cell_height + idiv(F.col("p"), cell_width)).cast("int").alias("y"),
        (F.col("col") * cell_width + F.col("p") % cell_width).cast("int").alias("x"),
        *[blend_channel(F.col(f"b{c}"), F.col(f"f{c}"), F.col("a")).alias(c) for c in "rgb"])
    if cell_width % 2 == 0 and cell_height % 2 == 0:
        return drawn
    size = cells.groupBy(FRAME_KEYS).agg(((F.max("col") + 1) * cell_width).alias("w"), ((F.max("row") + 1) * cell_height).alias("h"))
    w, h = F.col("w"), F.col("h")
    even_w, even_h = w + w % 2, h + h % 2
    right = F.when(w % 2 == 1, F.transform(F.sequence(F.lit(0), even_h - 1), lambda y: F.struct(y.alias("y"), w.alias("x"))))
    below = F.when(h % 2 == 1, F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.struct(h.alias("y"), x.alias("x"))))
    none = F.array().cast("array<struct<y:int,x:int>>")
    edge = size.select(*FRAME_KEYS, F.explode(F.concat(F.coalesce(right, none), F.coalesce(below, none))).alias("e")).select(
        *FRAME_KEYS, F.col("e.y").cast("int").alias("y"), F.col("e.x").cast("int").alias("x"), *[F.lit(0).alias(c) for c in "rgb"])
    return drawn.unionByName(edge)
