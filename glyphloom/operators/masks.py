"""Cell masks and edits.

A selection is either a Python list of (row, col) applied to every frame, or a
DataFrame with clip_id, frame_no, row, col. Lists become a literal, so cells are
filtered in place and no join with the frame list is needed to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.exprs import hue_rotate, is_blank, luminance, ramp_luminance, rgb_distance_l2
from glyphloom.operators.ordering import frames_apart
from glyphloom.schemas import CELL_KEYS, DEFAULT_RAMP, FRAME_KEYS

Selection = list | DataFrame
SPAN = 1 << 20


def _spot() -> Column:
    return F.col("row").cast("bigint") * SPAN + F.col("col")


def _codes(selection: list) -> list[int]:
    return sorted({r * SPAN + c for r, c in selection})


def selected_cells(cells: DataFrame, selection: Selection, payload: list[str]) -> DataFrame:
    """One row per (frame, selected position) with the ``payload`` columns of its cell,
    null for positions outside the frame.

    For a list the cells are read once: each frame keeps its selected cells (at most
    the length of the list) and adds the positions it does not have.
    """
    if isinstance(selection, DataFrame):
        return selection.select(CELL_KEYS).distinct().join(cells.select(*CELL_KEYS, *payload), CELL_KEYS, "left")
    codes = _codes(selection)
    chosen = F.when(_spot().isin(codes), F.struct(_spot().alias("code"), *payload))
    frames = cells.groupBy(FRAME_KEYS).agg(F.collect_list(chosen).alias("inside"))
    outside = F.array_except(F.lit(codes).cast("array<bigint>"), F.col("inside.code"))
    blank = [F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in payload]
    rows = frames.select(*FRAME_KEYS, F.explode(F.concat("inside", F.transform(
        outside, lambda code: F.struct(code.alias("code"), *blank)))).alias("s"))
    return rows.select(*FRAME_KEYS, F.call_function("div", F.col("s.code"), F.lit(SPAN)).cast("int").alias("row"),
                       (F.col("s.code") % SPAN).cast("int").alias("col"), *[F.col(f"s.{c}").alias(c) for c in payload])


def luminance_passes(luma: Column, drop_below=None, drop_above=None) -> Column:
    """Keep flag of a luma value. Each bound is (threshold, inclusive) or None."""
    keep = F.lit(True)
    if drop_below is not None:
        t, inclusive = drop_below
        keep = keep & ((luma > t) if inclusive else (luma >= t))
    if drop_above is not None:
        t, inclusive = drop_above
        keep = keep & ((luma < t) if inclusive else (luma <= t))
    return keep


def luminance_mask(cells: DataFrame, selection: Selection, drop_below=None, drop_above=None) -> DataFrame:
    """Keep flag per selected cell by foreground luma; positions outside the grid pass."""
    luma = luminance(F.col("fr"), F.col("fg"), F.col("fb"))
    keep = F.coalesce(luminance_passes(luma, drop_below, drop_above), F.lit(True))
    return selected_cells(cells, selection, ["fr", "fg", "fb"]).select(*CELL_KEYS, keep.alias("keep"))


def ramp_mask(cells: DataFrame, selection: Selection, ramp: str = DEFAULT_RAMP, drop_below=None, drop_above=None) -> DataFrame:
    """The same for text-only frames by ramp position; unknown glyphs pass."""
    luma = ramp_luminance(F.col("glyph"), ramp)
    keep = F.coalesce(luminance_passes(luma, drop_below, drop_above), F.lit(True))
    return selected_cells(cells, selection, ["glyph"]).select(*CELL_KEYS, keep.alias("keep"))


def neighbour_sums(cells: DataFrame, radius: int) -> DataFrame:
    """Per cell: colour sums and count (r, g, b, n) of the visible cells around it in a
    square window, itself not included, next to its own fr, fg, fb and ``visible`` (1 or 0).

    Two one-dimensional passes instead of a square of offsets: each cell is spread
    over the 2r+1 rows it reaches and summed with map-side combining (its own values
    ride along on the middle copy), then columns are summed by a range window inside
    one line of one frame. Frames are spread before, so both passes stay in their task.
    """
    seen = ~is_blank(F.col("glyph"))
    reach = F.when(seen, F.sequence(F.lit(-radius), F.lit(radius))).otherwise(F.array(F.lit(0)))
    source = {"r": "fr", "g": "fg", "b": "fb"}
    needed = frames_apart(cells.select(*FRAME_KEYS, "row", "col", *source.values(), "glyph"), 2 * radius + 1)
    spread = needed.select(
        *FRAME_KEYS, "row", "col", *source.values(), F.when(seen, 1).otherwise(0).alias("n"), F.explode(reach).alias("d"))
    middle = {c: F.when(F.col("d") == 0, F.col(c)).alias(c) for c in source.values()}
    bands = spread.select(
        *FRAME_KEYS, (F.col("row") + F.col("d")).alias("row"), "col", "n", *[(F.col(c) * F.col("n")).alias(k) for k, c in source.items()],
        *middle.values(), F.when(F.col("d") == 0, F.col("n")).alias("visible"),
    ).groupBy(CELL_KEYS).agg(*[F.max(c).alias(c) for c in (*middle, "visible")], *[F.sum(k).alias(k) for k in "rgbn"])
    box = W.partitionBy("clip_id", "frame_no", "row").orderBy("col").rangeBetween(-radius, radius)
    around = bands.select(*CELL_KEYS, *source.values(), "visible", *[F.sum(k).over(box).alias(k) for k in "rgbn"]).filter("visible is not null")
    return around.withColumns({k: F.col(k) - F.col("visible") * F.col(c) for k, c in source.items()} | {"n": F.col("n") - F.col("visible")})


def proximity_mask(cells: DataFrame, selection: Selection, tolerance: int, radius: int) -> DataFrame:
    """Keep flag per selected cell: colour within ``tolerance`` of the truncated mean
    of its visible neighbours. Blank, outside and neighbourless cells pass."""
    summed = neighbour_sums(cells, min(4, max(1, radius)))
    mean = [F.call_function("div", F.col(c), F.col("n")) for c in "rgb"]
    near = rgb_distance_l2([F.col("fr"), F.col("fg"), F.col("fb")], mean) <= tolerance
    judged = summed.withColumn("near", F.when((F.col("visible") == 0) | (F.col("n") == 0), True).otherwise(near))
    return selected_cells(judged, selection, ["near"]).select(*CELL_KEYS, F.coalesce("near", F.lit(True)).alias("keep"))


def erase_cells(cells: DataFrame, selection: Selection, layer: str = "all") -> DataFrame:
    """Blank the selected cells of ``all`` layers, only ``text`` or only ``background``.

    All cells come back; ``changed`` tells per frame whether anything differs
    (a frame is one bounded image, so the flag is a window over its cells).
    """
    if layer not in ("all", "text", "background"):
        raise ValueError(f"unknown layer: {layer}")
    if isinstance(selection, DataFrame):
        chosen = selection.select(CELL_KEYS).distinct().withColumn("_pick", F.lit(True))
        marked = cells.join(chosen, CELL_KEYS, "left").withColumn("_pick", F.coalesce("_pick", F.lit(False)))
    else:
        marked = cells.withColumn("_pick", _spot().isin(_codes(selection)))
    fore, back = ["fr", "fg", "fb"], ["br", "bg", "bb"]
    pick = F.col("_pick")
    new = {c: F.col(c) for c in ("glyph", *fore, *back)}
    if layer != "background":
        new["glyph"] = F.when(pick, F.lit(" ")).otherwise(F.col("glyph"))
        new.update({c: F.when(pick, F.lit(0)).otherwise(F.col(c)) for c in fore})
    if layer != "text":
        new.update({c: F.when(pick & F.col(c).isNotNull(), F.lit(0)).otherwise(F.col(c)) for c in back})
    differs = F.lit(False)
    for name, value in new.items():
        differs = differs | ~F.col(name).eqNullSafe(value)
    edited = marked.select(*CELL_KEYS, *[v.alias(k) for k, v in new.items()], differs.alias("_differs"))
    flag = F.bool_or("_differs").over(W.partitionBy(*FRAME_KEYS))
    return edited.withColumn("changed", flag).drop("_differs")


def hue_shift(cells: DataFrame, target: str = "both", foreground: float = 0.0, background: float = 0.0) -> DataFrame:
    """Rotate the hue of foreground, background or both; cells without background keep null."""
    if target not in ("foreground", "background", "both"):
        raise ValueError(f"unknown target: {target}")
    out = cells
    for active, names, degrees in (
        (target != "background", ("fr", "fg", "fb"), foreground),
        (target != "foreground", ("br", "bg", "bb"), background),
    ):
        if active:
            out = hue_rotate(out, names, degrees)
    return out


def frames_with_background(cells: DataFrame) -> DataFrame:
    """Per frame: does it carry a background payload?"""
    return cells.groupBy(FRAME_KEYS).agg(F.bool_or(F.col("br").isNotNull()).alias("has_background"))


def strided_sample(cells: DataFrame, limit: int = 64) -> DataFrame:
    """At most ``limit`` evenly spaced cells per frame: row-major index floor(k*n/limit)."""
    frame = W.partitionBy(*FRAME_KEYS)
    sized = cells.withColumn("_w", F.max("col").over(frame) + 1).withColumn("_n", F.col("_w").cast("bigint") * (F.max("row").over(frame) + 1))
    at = F.col("row") * F.col("_w") + F.col("col")
    # the index is hit when some k has floor(k*n/limit) = index
    k = F.call_function("div", at * limit + F.col("_n") - 1, F.col("_n"))
    hit = (F.col("_n") <= limit) | ((k < limit) & (F.call_function("div", k * F.col("_n"), F.lit(limit)) == at))
    return sized.filter(hit).drop("_w", "_n")
