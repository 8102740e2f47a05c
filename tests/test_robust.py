"""Inputs that used to kill a job or change a result."""

import struct

from glyphloom.operators import loops
from glyphloom.operators.timeline import resample_timeline
from glyphloom.sources.binary import encode_cell_frames, pack_frames, raw_reject_reason, unpack_frames
from glyphloom.sources.text import with_frame_no


def test_frame_number_beyond_64_bits_is_left_out(spark):
    df = spark.createDataFrame([("a/frame_99999999999999999999999.png",), ("a/frame_7.png",)], "path string")
    assert [r.frame_no for r in with_frame_no(df).collect()] == [7]


def test_header_overflow_is_a_reject(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<II", 2**32 - 1, 2**32 - 1)),), (bytearray(struct.pack("<II", 2**31, 2**30)),), (bytearray(struct.pack("<II", 1, 1) + b"a123"),)], "raw binary")
    assert [r[0] for r in df.select(raw_reject_reason(df.raw)).collect()] == ["dims_overflow", "dims_overflow", None]


def test_pack_leaves_rejected_frames_out(spark):
    good = bytearray(struct.pack("<II", 1, 1) + b"a123")
    df = spark.createDataFrame([(1, 0, good), (1, 1, None), (1, 2, good)], "clip_id long, frame_no long, raw binary")
    back = unpack_frames(pack_frames(df)).collect()
    assert len(back) == 2 and all(bytes(r.raw) == bytes(good) and r.reject_reason is None for r in back)


def test_colour_beyond_a_byte_is_a_reject(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, "a", 256, 0, 0, None, None, None)], "clip_id long, frame_no long, row int, col int, glyph string, fr int, fg int, fb int, br int, bg int, bb int")
    row = encode_cell_frames(df).first()
    assert row.raw is None and row.reject_reason == "foreground_length"


def test_long_gap_in_a_timeline(spark):
    year = 365 * 24 * 3600 * 1_000_000
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 10 * year)], "clip_id long, frame_no long, t_us long")
    out = resample_timeline(df, 1, 3600)
    assert out.count() == 10 * 365 * 24 + 1 and out.filter("frame_no = 1").count() == 1


def test_several_loops_of_a_clip_stay_apart(spark):
    frames = spark.createDataFrame([(1, n, t) for n, t in enumerate("abcab", 1)], "clip_id long, frame_no long, text string")
    slices = spark.createDataFrame([(1, 1, 4, 0, 3), (1, 2, 5, 1, 4)], "clip_id long, first_no long, second_no long, start_idx int, end_idx int")
    out = {}
    for r in loops.export_loop(frames, slices).orderBy("frame_no").collect():
        out[r.first_no] = out.get(r.first_no, "") + r.text
    assert out == {1: "abca", 2: "bcab"}
    assert loops.repeat_loop(frames, slices).groupBy("first_no").count().orderBy("first_no").collect() == [(1, 9), (2, 9)]


def test_sparse_coverage_draws_in_its_place(spark):
    """Pixels a coverage table leaves out count as uncovered, in drawing and in fitting."""
    from glyphloom.operators import fit, raster
    from glyphloom.schemas import CELLS_DDL

    full = [("#", y, x, 1.0 if (y, x) == (1, 1) else 0.0) for y in range(2) for x in range(2)]
    dense, sparse = (spark.createDataFrame(r, "glyph string, py int, px int, alpha double") for r in (full, full[3:]))
    cells = spark.createDataFrame([(1, 0, 0, 0, "#", 200, 100, 50, 10, 20, 30)], CELLS_DDL)
    drawn = [sorted(map(tuple, raster.rasterise_cells(cells, a, 2, 2).collect())) for a in (dense, sparse)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 4 and drawn[0][3][-3:] == (200, 100, 50)
    pixels = raster.rasterise_cells(cells, dense, 2, 2).selectExpr("clip_id", "frame_no", "2 as width", "2 as height", "y", "x", "r", "g", "b")
    fits = [sorted(map(tuple, fit.fit_cells(pixels, a, "#", 2, 2).collect())) for a in (dense, sparse)]
    assert fits[0] == fits[1] and fits[0][0][4] == "#"


def test_glyphs_beyond_a_byte_differ():
    from glyphloom.operators.similarity import LoopOptions, glyph_codes, pair_scores

    def block(*texts):
        import numpy as np
        return {"glyphs": np.stack([glyph_codes(t) for t in texts])}

    options = LoopOptions(mode="visual_text")
    scores = pair_scores(block("ab\u2588d"), block("ab\u2588d", "ab\u2592d", "ab?d"), options, False)[0]
    assert scores[0] == 1.0 and scores[1] < 1.0 and scores[2] < 1.0
