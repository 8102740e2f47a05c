import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.adapters import TINY_RAMP, tiny_atlas
from glyphloom.operators import fit, preprocess, raster, resample
from glyphloom.plans.conversion import fit_cell_backgrounds, preprocess_corpus
from glyphloom.schemas import CELLS_DDL, PIXELS_DDL


def image(spark, w, h, f, frame=1):
    rows = [(1, frame, w, h, y, x, *f(x, y)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIXELS_DDL)


def formula(x, y):
    return (17 * x + 3 * y) % 256, (5 * x + 23 * y) % 256, (11 * x + 7 * y) % 256


def triangle(line, n_out):
    """Dense weights of one axis, from the definition."""
    n_in = line
    s = max(1.0, n_in / n_out)
    m = np.zeros((n_out, n_in))
    for o in range(n_out):
        c = (o + 0.5) * n_in / n_out
        for i in range(n_in):
            m[o, i] = max(0.0, 1 - abs((i + 0.5 - c) / s))
        m[o] /= m[o].sum()
    return m


@pytest.mark.parametrize("w,h,ow,oh", [(8, 8, 4, 2), (37, 29, 10, 7), (5, 3, 9, 8), (6, 6, 6, 6), (7, 1, 1, 1)])
def test_resample(spark, w, h, ow, oh):
    got = np.zeros((oh, ow, 3))
    for r in resample.resample_to(image(spark, w, h, formula), F.lit(ow), F.lit(oh)).collect():
        got[r.y, r.x] = r.r, r.g, r.b
    src = np.array([[formula(x, y) for x in range(w)] for y in range(h)], float)
    want = np.einsum("oy,px,yxc->opc", triangle(h, oh), triangle(w, ow), src)
    assert np.abs(got - want).max() <= 0.5 + 1e-9
    first = triangle(8, 2)[0]
    assert np.allclose(first[:6], [0.178571, 0.25, 0.25, 0.178571, 0.107143, 0.035714], atol=1e-6)


def test_sizes_are_measured_when_missing(spark):
    px = image(spark, 6, 4, formula)
    a = resample.resample_to_grid(px, 3, 0.5)
    b = resample.resample_to_grid(px.drop("width", "height"), 3, 0.5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("level,fg,bg,gate,glyph_space,black_bg", [
    (128, 30, 30, "both", False, False), (128, 30, 200, "glyph", False, True), (128, 200, 30, "background", True, False), (64, 200, 200, "nothing", True, True)])
def test_quadrants(spark, level, fg, bg, gate, glyph_space, black_bg):
    px = image(spark, 4, 4, lambda x, y: (level,) * 3)
    stats = fit.patch_stats(px, 4, 4)
    assert fit.cell_gate(stats, fg, bg).first().gate == gate
    cell = fit.fit_cells(px, tiny_atlas(spark), TINY_RAMP, 4, 4, fg, bg).first()
    assert (cell.glyph == " ") == glyph_space
    assert ((cell.br, cell.bg, cell.bb) == (0, 0, 0)) == black_bg
    if gate == "background":
        assert (cell.br, cell.fr) == (128, 0)


def test_matrix_form_equals_relational_form(spark):
    px = resample.resample_to_grid(image(spark, 37, 29, formula).unionByName(image(spark, 37, 29, lambda x, y: (x * 6, y * 8, 90), 2)), 6, 0.7, 4, 4)
    atlas = tiny_atlas(spark)
    fast = fit.fit_cells(px, atlas, TINY_RAMP, 4, 4, 110, 130)
    slow = fit._fit_cells_relational(px, atlas, TINY_RAMP, 4, 4, 110, 130)
    cols = ["clip_id", "frame_no", "row", "col", "glyph", "fr", "fg", "fb", "br", "bg", "bb"]
    a, b = (sorted(map(tuple, d.select(cols).collect())) for d in (fast, slow))
    assert a == b and len(a) == 2 * 6 * 3


def test_ties_and_missing_glyphs(spark):
    flat = image(spark, 4, 4, lambda x, y: (90, 90, 90))
    atlas = tiny_atlas(spark)
    assert fit.fit_cells(flat, atlas, "?.:", 4, 4).first().glyph == "."  # equal errors: earliest in the ramp
    none = fit.fit_cells(flat, atlas, "?!", 4, 4).first()
    assert (none.glyph, none.fr, none.br) == (" ", 90, 90)
    only_space = fit.fit_cells(flat, atlas, "  ", 4, 4).first()
    assert (only_space.glyph, only_space.fr, only_space.br) == (" ", 90, 90)


def test_atlas_sums(spark):
    got = {r.glyph: (r.det, r.degenerate) for r in fit.atlas_sums(tiny_atlas(spark)).collect()}
    dets = [0, 15.75, 5.4375, 32.4375, 19, 45.75, 27.75, 39.75, 31.4375, 23.9375]
    assert [got[g][0] for g in TINY_RAMP] == dets
    assert [got[g][1] for g in TINY_RAMP] == [True] + [False] * 9


def test_raster(spark):
    space = spark.createDataFrame([(1, 1, 0, 0, " ", 1, 1, 1, 255, 0, 0)], CELLS_DDL)
    assert {(r.r, r.g, r.b) for r in raster.rasterise_cells(space, tiny_atlas(spark), 4, 4).collect()} == {(255, 0, 0)}
    odd = spark.createDataFrame([("#", y, x, 1.0 if x == 1 else 0.5 if y == 1 else 0.0) for y in range(3) for x in range(3)], "glyph string, py int, px int, alpha double")
    cell = spark.createDataFrame([(1, 1, 0, 0, "#", 200, 100, 0, None, None, None), (1, 1, 0, 1, "?", 9, 9, 9, 10, 20, 30)], CELLS_DDL)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in raster.rasterise_cells(cell, odd, 3, 3).collect()}
    assert len(got) == 6 * 4  # 6 x 3 padded to even
    assert got[0, 1] == (200, 100, 0) and got[0, 0] == (0, 0, 0) and got[1, 0] == (100, 50, 0)
    assert got[0, 3] == (10, 20, 30) and got[3, 5] == (0, 0, 0)
    white = {(r.y, r.x): r.r for r in raster.rasterise_cells(cell, odd, 3, 3, use_colors=False).collect()}
    assert white[0, 1] == 255
    one = spark.createDataFrame([(1, 1, 0, 0, "#", 200, 100, 0, None, None, None)], CELLS_DDL)
    assert raster.rasterise_cells(one, odd, 3, 3).count() == 16


def test_stroke(spark):
    dot = spark.createDataFrame([("o", y, x, 1.0 if (y, x) == (2, 2) else 0.0) for y in range(5) for x in range(5)], "glyph string, py int, px int, alpha double")
    def covered(width):
        return sum(r.alpha > 0 for r in raster.thicken_atlas(dot, width).collect())
    assert [covered(w) for w in (0.0, 0.4, 1.0, 1.5, 9.0)] == [1, 1, 5, 9, 9]


def test_filters(spark):
    px = image(spark, 5, 4, formula)
    gray = preprocess.gray(px).collect()
    assert all(r.r == r.g == r.b for r in gray)
    flat = image(spark, 5, 4, lambda x, y: (40, 80, 120))
    for step in (preprocess.blur(flat), preprocess.unsharp(flat, 1.0)):
        assert {(r.r, r.g, r.b) for r in step.collect()} == {(40, 80, 120)}
    assert {(r.r, r.g, r.b) for r in preprocess.edges(flat, 0.05, 0.2).collect()} == {(0, 0, 0)}
    assert {(r.r, r.g, r.b) for r in preprocess.apply_filter(image(spark, 2, 2, lambda x, y: (250, 251, 252)), "bg-white").collect()} == {(0, 0, 0)}
    for name in preprocess.PREPROCESS_PRESETS:
        assert preprocess.apply_filter(px, f" {name.upper()} ").count() == 20
    with pytest.raises(ValueError):
        preprocess.resolve_filter("nothing")
    with pytest.raises(ValueError):
        preprocess.resolve_filter(steps=[])
    assert preprocess.resolve_filter("vivid", [("gray", {})]) == [("gray", {})]


def test_preprocess_corpus_writes(spark, tmp_path):
    out = str(tmp_path / "px")
    preprocess_corpus(image(spark, 4, 4, formula), "bw-contrast", path=out)
    assert spark.read.parquet(out).count() == 16


def test_background_plan_resamples(spark):
    cells = fit_cell_backgrounds(image(spark, 37, 29, formula), tiny_atlas(spark), 4, 4, columns=5, font_ratio=0.44, ramp=TINY_RAMP)
    assert cells.count() == 5 * 2
