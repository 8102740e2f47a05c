"""Glyph and colour fitting per cell by least squares over a coverage table.

A pixel is modelled as alpha*fg + (1-alpha)*bg. Only sums are needed, so the
relational form aggregates on the map side; the fitted form multiplies patches
with the coverage matrix, one Arrow batch of cells at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.exprs import clamp_channel, idiv, luminance
from glyphloom.schemas import CELL_KEYS, FRAME_KEYS

MAX_ATLAS_ROWS = 95 * 64 * 64  # printable ASCII glyphs at 64 x 64 pixels


def small_enough(table: DataFrame, limit: int = MAX_ATLAS_ROWS) -> bool:
    """Size check before a dimension table is broadcast; reads at most limit + 1 rows."""
    return table.limit(limit + 1).count() <= limit


def dimension(table: DataFrame, limit: int = MAX_ATLAS_ROWS) -> DataFrame:
    """Broadcast hint if the table is proven small, the table as it is otherwise."""
    return F.broadcast(table) if small_enough(table, limit) else table


def dense_atlas(atlas: DataFrame, cell_width: int, cell_height: int) -> DataFrame:
    """One row per glyph and pixel of a cell: pixels the table leaves out have no coverage, those outside the cell go."""
    places = F.transform(F.sequence(F.lit(0), F.lit(cell_width * cell_height - 1)), lambda p: F.struct(
        idiv(p, cell_width).cast("int").alias("py"), (p % cell_width).cast("int").alias("px")))
    full = atlas.select("glyph").distinct().select("glyph", F.explode(places).alias("at")).select("glyph", "at.py", "at.px")
    return full.join(atlas.select("glyph", "py", "px", "alpha"), ["glyph", "py", "px"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))


def atlas_sums(atlas: DataFrame) -> DataFrame:
    """Per glyph: the sums the closed form needs and whether it is degenerate."""
    a, b = F.col("alpha"), 1 - F.col("alpha")
    sums = atlas.groupBy("glyph").agg(
        F.sum(a * a).alias("s_aa"), F.sum(a * b).alias("s_ab"), F.sum(b * b).alias("s_bb"), F.avg(a).alias("mean_alpha"))
    det = F.col("s_aa") * F.col("s_bb") - F.col("s_ab") * F.col("s_ab")
    mean = F.col("mean_alpha")
    flat = (mean <= 1e-6) | (mean >= 1.0 - 1e-6) | (F.abs(det) <= 1e-9)
    return sums.withColumn("det", det).withColumn("degenerate", flat)


def candidates(atlas: DataFrame, ramp: str) -> DataFrame:
    """Atlas rows of the ramp glyphs except space, with ``ramp_pos``; only spaces -> the space."""
    wanted = ramp.replace(" ", "") or " "
    place = F.call_function("locate", F.col("glyph"), F.lit(wanted))
    return atlas.withColumn("ramp_pos", (place - 1).cast("int")).filter(place > 0)


def patches(pixels: DataFrame, cell_width: int, cell_height: int) -> DataFrame:
    """Pixels of a grid-times-cell image, addressed by cell and position in it."""
    return pixels.select(
        *FRAME_KEYS, idiv(F.col("y"), cell_height).cast("int").alias("row"), idiv(F.col("x"), cell_width).cast("int").alias("col"),
        (F.col("y") % cell_height).alias("py"), (F.col("x") % cell_width).alias("px"), "r", "g", "b")


def _stat_columns():
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return [
        F.count(F.lit(1)).alias("n"), F.sum(luminance(r, g, b)).alias("sum_luma"),
        F.sum("r").alias("sum_r"), F.sum("g").alias("sum_g"), F.sum("b").alias("sum_b"),
        F.sum(r * r + g * g + b * b).alias("sum_sq"),
    ]


def patch_stats(pixels: DataFrame, cell_width: int, cell_height: int) -> DataFrame:
    """Per cell: mean luma, colour sums, sum of squares, truncated mean colour."""
    stats = patches(pixels, cell_width, cell_height).groupBy(CELL_KEYS).agg(*_stat_columns())
    return stats.withColumn("mean_luma", F.col("sum_luma") / F.col("n")).withColumns(
        {f"mean_{c}": idiv(F.col(f"sum_{c}"), F.col("n")).cast("int") for c in "rgb"})


def cell_gate(stats: DataFrame, threshold: int, bg_threshold: int) -> DataFrame:
    """Which layers a cell shows: nothing, background, glyph, both."""
    fore, back = F.col("mean_luma") >= threshold, F.col("mean_luma") >= bg_threshold
    return stats.withColumn("emit_fg", fore).withColumn("emit_bg", back).withColumn(
        "gate", F.when(fore & back, "both").when(fore, "glyph").when(back, "background").otherwise("nothing"))


def fit_glyph_colors(pixels: DataFrame, atlas: DataFrame, ramp: str, cell_width: int, cell_height: int) -> DataFrame:
    """One row per (cell, candidate glyph): rounded colours and their squared error."""
    table = candidates(dense_atlas(atlas, cell_width, cell_height), ramp)
    spots = patches(pixels, cell_width, cell_height).join(dimension(table), ["py", "px"])
    sums = spots.groupBy(*CELL_KEYS, "glyph", "ramp_pos").agg(
        *_stat_columns(), *[F.sum(F.col("alpha") * F.col(c)).alias(f"ap_{c}") for c in "rgb"])
    joined = sums.join(dimension(atlas_sums(table)), "glyph")
    flat, n = F.col("degenerate"), F.col("n")
    error = F.col("sum_sq").cast("double")
    colors = {}
    for c in "rgb":
        total, ap = F.col(f"sum_{c}").cast("double"), F.col(f"ap_{c}")
        bp = total - ap
        mean = idiv(F.col(f"sum_{c}"), n).cast("int")
        fore = F.when(flat, mean).otherwise(clamp_channel((ap * F.col("s_bb") - bp * F.col("s_ab")) / F.col("det")))
        back = F.when(flat, mean).otherwise(clamp_channel((bp * F.col("s_aa") - ap * F.col("s_ab")) / F.col("det")))
        colors[f"f{c}"], colors[f"b{c}"] = fore, back
        f, k = fore.cast("double"), back.cast("double")
        fitted = f * f * F.col("s_aa") + f * 2.0 * k * F.col("s_ab") + k * k * F.col("s_bb") - (f * ap + k * bp) * 2.0
        error = error + F.when(flat, n * f * f - f * 2.0 * total).otherwise(fitted)
    return joined.select(*CELL_KEYS, "glyph", "ramp_pos", *[v.alias(k) for k, v in colors.items()], error.alias("error"))


def best_glyph(fits: DataFrame) -> DataFrame:
    """Smallest error per cell; on a tie the glyph that comes first in the ramp."""
    names = ["glyph", "fr", "fg", "fb", "br", "bg", "bb", "error"]
    best = F.min_by(F.struct(*names), F.struct("error", "ramp_pos"))
    return fits.groupBy(CELL_KEYS).agg(best.alias("best")).select(*CELL_KEYS, "best.*")


FITTED_DDL = "clip_id bigint, frame_no bigint, row int, col int, glyph string, fr int, fg int, fb int, br int, bg int, bb int"


def _fit_batches(alpha, glyphs, sums):
    """Task-side helper: batches of patches -> fitted cells. ``alpha`` is glyphs x pixels."""
    s_aa, s_ab, s_bb, det, flat = (sums[k][None, :, None] for k in ("s_aa", "s_ab", "s_bb", "det", "degenerate"))
    safe = np.where(flat, 1.0, det)
    names = np.array(glyphs, dtype=object)

    def run(batches):
        for pdf in batches:
            mean = pdf[["mean_r", "mean_g", "mean_b"]].to_numpy(np.int64)
            fore, back = np.zeros_like(mean), np.where(pdf["emit_bg"].to_numpy(bool)[:, None], mean, 0)
            glyph = np.full(len(pdf), " ", dtype=object)
            todo = np.flatnonzero(pdf["emit_fg"].to_numpy(bool))
            for part in np.array_split(todo, max(1, len(todo) // 2048)):
                if not len(part) or not len(names):
                    fore[part] = mean[part]
                    continue
                chosen = pdf.iloc[part]
                p = np.stack([np.stack(chosen[f"p_{c}"].to_numpy()) for c in "rgb"], axis=2).astype(np.float64)
                total = p.sum(axis=1)[:, None, :]
                ap = np.einsum("gn,cnk->cgk", alpha, p)
                bp = total - ap
                avg = mean[part][:, None, :].astype(np.float64)
                f = np.where(flat, avg, np.floor(np.clip((ap * s_bb - bp * s_ab) / safe, 0, 255) + 0.5))
                k = np.where(flat, avg, np.floor(np.clip((bp * s_aa - ap * s_ab) / safe, 0, 255) + 0.5))
                fitted = f * f * s_aa + 2 * f * k * s_ab + k * k * s_bb - 2 * (f * ap + k * bp)
                constant = p.shape[1] * avg * avg - 2 * avg * total
                error = (np.where(flat, constant, fitted)).sum(axis=2)
                best = error.argmin(axis=1)
                rows = np.arange(len(part))
                glyph[part], fore[part] = names[best], f[rows, best]
                back[part] = np.where(chosen["emit_bg"].to_numpy(bool)[:, None], k[rows, best], 0)
            out = pdf[["clip_id", "frame_no", "row", "col"]].copy()
            out["glyph"] = glyph
            for i, c in enumerate("rgb"):
                out[f"f{c}"] = fore[:, i].astype(np.int32)
            for i, c in enumerate("rgb"):
                out[f"b{c}"] = back[:, i].astype(np.int32)
            yield out[["clip_id", "frame_no", "row", "col", "glyph", "fr", "fg", "fb", "br", "bg", "bb"]]

    return run


def _gated_patches(pixels, cell_width, cell_height, threshold, bg_threshold):
    spot = F.struct("py", "px", "r", "g", "b")
    grouped = patches(pixels, cell_width, cell_height).groupBy(CELL_KEYS).agg(
        *_stat_columns(), F.array_sort(F.collect_list(spot)).alias("spots"))
    stats = grouped.withColumn("mean_luma", F.col("sum_luma") / F.col("n")).withColumns(
        {f"mean_{c}": idiv(F.col(f"sum_{c}"), F.col("n")).cast("int") for c in "rgb"})
    gated = cell_gate(stats, threshold, bg_threshold)
    return gated.select(*CELL_KEYS, "emit_fg", "emit_bg", "mean_r", "mean_g", "mean_b",
                        *[F.when(F.col("emit_fg"), F.col(f"spots.{c}")).alias(f"p_{c}") for c in "rgb"])


def fit_cells(pixels: DataFrame, atlas: DataFrame, ramp: str, cell_width: int, cell_height: int,
              threshold: int = 20, bg_threshold: int | None = None) -> DataFrame:
    """Gate, fit and choose per cell of a grid-times-cell image; cells that show no
    glyph never reach the solver. One shuffle (pixels to cells)."""
    bg_threshold = threshold if bg_threshold is None else bg_threshold
    table = candidates(dense_atlas(atlas, cell_width, cell_height), ramp)
    cover = table.limit(MAX_ATLAS_ROWS + 1).toPandas()  # the size check: never more than the bound reaches the driver
    if len(cover) > MAX_ATLAS_ROWS:
        return _fit_cells_relational(pixels, atlas, ramp, cell_width, cell_height, threshold, bg_threshold)
    cover = cover.sort_values(["ramp_pos", "py", "px"])
    glyphs = list(cover["glyph"].drop_duplicates())
    alpha = cover["alpha"].to_numpy(np.float64).reshape(len(glyphs), -1 if glyphs else 0)
    s_aa, s_ab, s_bb = (alpha * alpha).sum(1), (alpha * (1 - alpha)).sum(1), ((1 - alpha) * (1 - alpha)).sum(1)
    det, mean = s_aa * s_bb - s_ab * s_ab, alpha.mean(1) if glyphs else np.zeros(0)
    flat = (mean <= 1e-6) | (mean >= 1.0 - 1e-6) | (np.abs(det) <= 1e-9)
    sums = {"s_aa": s_aa, "s_ab": s_ab, "s_bb": s_bb, "det": det, "degenerate": flat}
    gated = _gated_patches(pixels, cell_width, cell_height, threshold, bg_threshold)
    return gated.mapInPandas(_fit_batches(alpha, glyphs, sums), FITTED_DDL)


def _fit_cells_relational(pixels, atlas, ramp, cell_width, cell_height, threshold, bg_threshold):
    gated = cell_gate(patch_stats(pixels, cell_width, cell_height), threshold, bg_threshold)
    best = best_glyph(fit_glyph_colors(pixels, atlas, ramp, cell_width, cell_height)).drop("error")
    joined = gated.join(best, CELL_KEYS, "left")
    fore, back = F.col("emit_fg"), F.col("emit_bg")
    shown = {f"f{c}": F.when(fore, F.coalesce(F.col(f"f{c}"), F.col(f"mean_{c}"))).otherwise(0) for c in "rgb"}
    shown |= {f"b{c}": F.when(~back, 0).when(fore, F.coalesce(F.col(f"b{c}"), F.col(f"mean_{c}"))).otherwise(F.col(f"mean_{c}"))
              for c in "rgb"}
    glyph = F.when(fore, F.coalesce("glyph", F.lit(" "))).otherwise(F.lit(" "))
    return joined.select(*CELL_KEYS, glyph.alias("glyph"), *[v.cast("int").alias(k) for k, v in shown.items()])
