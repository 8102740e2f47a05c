import pytest

from glyphloom.operators import compare, crop, masks
from glyphloom.schemas import CELLS_DDL


def cells(spark, grid, clip=1, frame=1, bg=None):
    """grid: list of rows of (glyph, r, g, b)."""
    rows = []
    for r, line in enumerate(grid):
        for c, (g, *rgb) in enumerate(line):
            back = bg[r][c] if bg else (None, None, None)
            rows.append((clip, frame, r, c, g, *rgb, *back))
    return spark.createDataFrame(rows, CELLS_DDL)


def keeps(df):
    return {(r.row, r.col): r.keep for r in df.collect()}


ORANGE, BLUE, BLANK = ("#", 220, 120, 10), ("#", 20, 40, 220), (" ", 0, 0, 0)


def gray(v):
    return ("#", v, v, v)


@pytest.mark.parametrize("below,above,want", [
    ((100, False), None, [False, True, True, True, True]), ((100, True), None, [False, False, True, True, True]),
    (None, (200, False), [True, True, True, True, False]), (None, (200, True), [True, True, True, False, False]),
    ((100, True), (200, True), [False, False, True, False, False]), (None, None, [True] * 5)])
def test_luminance_bounds(spark, below, above, want):
    df = cells(spark, [[gray(v) for v in (99, 100, 150, 200, 201)]])
    got = keeps(masks.luminance_mask(df, [(0, c) for c in range(5)], below, above))
    assert [got[0, c] for c in range(5)] == want


def test_outside_the_grid_passes(spark):
    df = cells(spark, [[gray(0), gray(0)]])
    assert keeps(masks.luminance_mask(df, [(5, 5), (0, 2), (1, 0), (0, 0)], (10, False))) == {(5, 5): True, (0, 2): True, (1, 0): True, (0, 0): False}


def test_selection_table(spark):
    df = cells(spark, [[gray(0), gray(0)]])
    picked = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 4, 4)], "clip_id bigint, frame_no bigint, row int, col int")
    assert keeps(masks.luminance_mask(df, picked, (10, False))) == {(0, 1): False, (4, 4): True}
    erased = masks.erase_cells(df, picked, "text").orderBy("col").collect()
    assert [r.glyph for r in erased] == ["#", " "]


def test_ramp_mask(spark):
    df = cells(spark, [[(" ", 0, 0, 0), ("@", 0, 0, 0), ("Q", 0, 0, 0)]])
    assert keeps(masks.ramp_mask(df, [(0, 0), (0, 1), (0, 2)], " .:-=+*#%@", (10, False))) == {(0, 0): False, (0, 1): True, (0, 2): True}


def test_proximity(spark):
    df = cells(spark, [[ORANGE] * 3, [ORANGE, ORANGE, BLUE], [ORANGE] * 3])
    assert keeps(masks.proximity_mask(df, [(1, 1), (1, 2), (0, 0)], 40, 1)) == {(1, 1): True, (1, 2): False, (0, 0): True}
    line = cells(spark, [[("#", i * 50, i * 25, 0) for i in range(5)]])
    assert all(keeps(masks.proximity_mask(line, [(0, 1), (0, 2), (0, 3)], 5, 1)).values())
    alone = cells(spark, [[BLANK] * 3, [BLANK, ORANGE, BLANK], [BLANK] * 3])
    assert all(keeps(masks.proximity_mask(alone, [(1, 1), (0, 0)], 10, 1)).values())
    assert all(keeps(masks.proximity_mask(cells(spark, [[ORANGE, ORANGE]]), [(0, 0), (0, 1)], 10, 4)).values())
    assert not any(keeps(masks.proximity_mask(cells(spark, [[ORANGE, BLUE]]), [(0, 0), (0, 1)], 10, 4)).values())


def test_erase_layers(spark):
    df = cells(spark, [[("A", 1, 2, 3), ("B", 4, 5, 6)]], bg=[[(7, 8, 9), (10, 11, 12)]])
    def row(layer):
        r = masks.erase_cells(df, [(0, 0), (9, 9)], layer).filter("col = 0").first()
        return (r.glyph, r.fr, r.fg, r.fb, r.br, r.bg, r.bb, r.changed)
    assert row("text") == (" ", 0, 0, 0, 7, 8, 9, True)
    assert row("background") == ("A", 1, 2, 3, 0, 0, 0, True)
    assert row("all") == (" ", 0, 0, 0, 0, 0, 0, True)
    plain = cells(spark, [[("A", 1, 2, 3)]])
    assert not masks.erase_cells(plain, [(0, 0)], "background").first().changed
    once = masks.erase_cells(df, [(0, 0)], "all").drop("changed")
    assert not masks.erase_cells(once, [(0, 0)], "all").first().changed


def test_hue_targets(spark):
    df = cells(spark, [[("#", 255, 0, 0), ("#", 0, 255, 0)]], bg=[[(0, 0, 255), (255, 0, 0)]])
    rows = masks.hue_shift(df, "both", 120.0, -120.0).orderBy("col").collect()
    assert [(r.fr, r.fg, r.fb) for r in rows] == [(0, 255, 0), (0, 0, 255)]
    assert [(r.br, r.bg, r.bb) for r in rows] == [(0, 255, 0), (0, 0, 255)]
    same = masks.hue_shift(df, "background", 120.0, 0.0).orderBy("col").collect()
    assert [(r.fr, r.fg, r.fb) for r in same] == [(255, 0, 0), (0, 255, 0)]


def test_strided_sample(spark):
    df = cells(spark, [[(chr(33 + c % 60), 0, 0, 0) for c in range(20)] for _ in range(10)])
    got = sorted(r.row * 20 + r.col for r in masks.strided_sample(df).collect())
    assert got == sorted({k * 200 // 64 for k in range(64)})
    assert masks.strided_sample(cells(spark, [[gray(1)] * 8] * 8)).count() == 64


def letters(text):
    return [[(ch, 1, 2, 3) for ch in line] for line in text.split("/")]


def test_crop(spark):
    df = cells(spark, letters("abcd/efgh/ijkl"), frame=7).union(cells(spark, letters("mnop/qrst/uvwx"), frame=12))
    got = crop.crop_frames(df, top=1, left=1, right=1)
    assert {(r.frame_no, r.row, r.col): r.glyph for r in got.collect() if r.frame_no == 1} == {
        (1, 0, 0): "f", (1, 0, 1): "g", (1, 1, 0): "j", (1, 1, 1): "k"}
    total = crop.crop_summary(got).first()
    assert (total.frame_count, total.new_width, total.new_height, total.total_size) == (2, 2, 2, 2 * (6 + 8 + 16))
    whole = crop.crop_frames(df)
    assert whole.count() == 24 and {r.frame_no for r in whole.collect()} == {1, 2}
    with pytest.raises(Exception, match="crop leaves nothing"):
        crop.crop_frames(df, top=2, bottom=1).count()


def test_trim(spark):
    df = spark.createDataFrame([(1, 1, "abcd\nefgh\nijkl\n"), (1, 2, "abc\nab\n"), (1, 3, ""), (1, 4, "ab\nab")], "clip_id bigint, frame_no bigint, text string")
    got = {r.frame_no: (r.text, r.reject_reason) for r in crop.trim_text(df, top=1, left=1, right=1).collect()}
    assert got == {1: ("fg\njk\n", None), 2: ("abc\nab\n", "ragged"), 3: ("", "empty"), 4: ("ab\nab", "nothing_left")}
    assert crop.resolve_sides(3, left=0) == {"top": 3, "bottom": 3, "left": 0, "right": 3}


def test_diff_and_compare(spark):
    a = cells(spark, letters("ab/cd"))
    b = masks.erase_cells(a, [(0, 1)], "text").drop("changed")
    r = compare.diff_frames(a, b).first()
    assert (r.identical, r.cells_different, r.max_difference, r.total_difference) == (False, 1, 3, 6)
    assert compare.diff_frames(a, a).first().identical
    t = spark.createDataFrame([(1, 1, "abc\nabc\n"), (1, 2, "abc\nabc\n")], "clip_id bigint, frame_no bigint, text string")
    got = {r.check_name: (r.expected, r.actual, r.result) for r in compare.compare_runs(t, t.filter("frame_no = 1")).collect()}
    assert got == {"total_size": (16, 8, "FAILED"), "frame_count": (2, 1, "FAILED"), "frame_height": (2, 2, "PASSED"), "frame_width": (3, 3, "PASSED")}
    files = spark.createDataFrame([(1, "color"), (1, "text"), (2, "text")], "clip_id bigint, kind string")
    assert {r.clip_id: (r.source, r.frames, r.use_colors) for r in compare.frame_source_choice(files).collect()} == {1: ("color", 1, True), 2: ("text", 1, False)}
    assert {r.use_colors for r in compare.frame_source_choice(files, False).collect()} == {False}
