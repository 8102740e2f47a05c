import pytest
from pyspark.sql import functions as F

from glyphloom.operators import dedup, timeline
from glyphloom.operators.ordering import dense_index, last_marked
from glyphloom.sources import config, text, writers
from glyphloom.functions.exprs import idiv


def frames(spark, rows):
    return spark.createDataFrame(rows, "clip_id bigint, frame_no bigint, text string")


def test_scan_index_and_policies(spark, tmp_path):
    for name, body in {"frame_0002.txt": "ab\nabcd\n", "frame_10.txt": "x\n", "frame_0001.txt": "q", "note.txt": "no", "frame_x.txt": "no"}.items():
        (tmp_path / name).write_text(body)
    scanned = text.scan_text_frames(spark, str(tmp_path))
    assert sorted((r.frame_no, r.text) for r in scanned.collect()) == [(1, "q"), (2, "ab\nabcd\n"), (10, "x\n")]
    indexed = text.index_frames(scanned.drop("frame_no"))
    assert sorted((r.frame_no, r.frame_idx) for r in indexed.collect()) == [(1, 0), (2, 1), (10, 2)]
    shaped = {r.frame_no: (r.width, r.height, r.glyphs) for r in text.text_shape(scanned, "pad").collect()}
    assert shaped[2] == (4, 2, "ab  abcd")
    assert {r.frame_no: (r.width, r.height, r.glyphs) for r in text.text_shape(scanned, "first_line").collect()}[2] == (2, 2, "abab")
    spots = {(r.row, r.col): r.glyph for r in text.text_cells(scanned.filter("frame_no = 2")).collect()}
    assert len(spots) == 8 and spots[0, 3] == " " and spots[1, 3] == "d"


def test_validation(spark):
    df = frames(spark, [(1, 1, "ab\nab"), (1, 2, "é"), (1, 3, ""), (1, 4, "\n"), (1, 5, "ab\na"), (1, 6, None)])
    reasons = {r.frame_no: r.reject_reason for r in text.validate_frames(df, "pad").collect()}
    assert reasons == {1: None, 2: "non_ascii", 3: "empty", 4: "zero_width", 5: None, 6: "empty"}
    assert {r.frame_no: r.reject_reason for r in text.validate_frames(df, "rect").collect()}[5] == "ragged"
    good, bad = text.split_rejects(text.validate_frames(df))
    assert good.count() == 2 and bad.count() == 4
    with pytest.raises(Exception, match="bad frame"):
        text.validate_frames(df, strict=True).collect()


def test_pairing(spark):
    t = text.text_shape(frames(spark, [(1, 1, "ab\n"), (1, 2, "cd\n")]))
    c = spark.createDataFrame([(1, 2, 2, 1, "XY", [1, 2, 3, 4, 5, 6], None), (1, 3, 2, 1, "ZZ", None, None)],
                              "clip_id bigint, frame_no bigint, width int, height int, glyphs string, fg array<int>, bg array<int>")
    got = {r.frame_no: (r.glyphs, r.exact, r.has_color, r.has_text) for r in text.pair_payloads(t, c).collect()}
    assert got == {1: ("ab", "ab\n", False, True), 2: ("XY", "cd\n", True, True), 3: ("ZZ", "ZZ", True, False)}


def test_dedup_and_fanout(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([b"red", b"green", b"red", b"red", None, None])], "clip_id bigint, frame_no bigint, raw binary")
    for confirm in (False, True):
        plan = dedup.dedup_frames(df, confirm_bytes=confirm)
        assert {r.frame_no: r.rep_frame_no for r in plan.collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 5}
    made = dedup.representatives(df, plan).select("clip_id", "frame_no", F.length("raw").alias("n"))
    assert made.count() == 4
    assert {r.frame_no: r.n for r in dedup.fanout_duplicates(plan, made).collect()} == {0: 3, 1: 5, 2: 3, 3: 3, 4: None, 5: None}


def test_blocked_order(spark):
    df = spark.range(1000).select((F.col("id") % 3 * F.col("id") % 2).alias("g"), (F.col("id") * 17 % 1009).alias("v"))
    got = dense_index(df, ["g"], ["v"], idiv(F.col("v"), 37)).collect()
    for g in {r.g for r in got}:
        mine = sorted((r.v, r.frame_idx) for r in got if r.g == g)
        assert [i for _, i in mine] == list(range(len(mine)))
    marks = spark.range(500).select(F.lit(0).alias("g"), F.col("id").alias("i"))
    filled = last_marked(marks, ["g"], "i", F.when(F.col("i") % 90 == 7, F.col("i")), "m", block=16)
    assert all(r.m == (None if r.i < 7 else (r.i - 7) // 90 * 90 + 7) for r in filled.collect())


@pytest.mark.parametrize("start,end,want", [("10", "15", [10, 14]), ("0", "5", [0]), ("10", "5", [10, 14, 15, 99]), ("", "", [0, 10, 14, 15, 99]), (None, "15", [0, 10, 14]), ("00:00:14", None, [14, 15, 99])])
def test_time_range(spark, start, end, want):
    df = spark.createDataFrame([(1, i, s * 1_000_000) for i, s in enumerate([0, 10, 14, 15, 99])], "clip_id bigint, frame_no bigint, t_us bigint")
    assert sorted(r.t_us // 1_000_000 for r in timeline.time_range(df, start, end).collect()) == want


def test_resample_timeline(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 400_000), (1, 3, 450_000), (1, 4, 2_000_000)], "clip_id bigint, frame_no bigint, t_us bigint")
    got = timeline.resample_timeline(df, 4).orderBy("new_frame_no").collect()
    assert [(r.new_frame_no, r.tick_us, r.frame_no) for r in got] == [
        (1, 0, 1), (2, 250_000, 1), (3, 500_000, 3), (4, 750_000, 3), (5, 1_000_000, 3), (6, 1_250_000, 3), (7, 1_500_000, 3), (8, 1_750_000, 3), (9, 2_000_000, 4)]


def test_config_and_summary(spark):
    req = spark.createDataFrame(
        [(1, None, None, None, None, None, None), (2, "small", 33, None, None, 50, None), (3, "odd", None, None, None, None, 9)],
        "clip_id bigint, preset string, columns int, fps int, font_ratio double, luminance int, bg_luminance int")
    got = {r.clip_id: r for r in config.run_config(req).collect()}
    assert (got[1].columns, got[1].fps, got[1].font_ratio, got[1].luminance, got[1].bg_luminance) == (400, 30, 0.7, 20, 20)
    assert (got[2].columns, got[2].fps, got[2].font_ratio, got[2].bg_luminance) == (33, 24, 0.44, 50)
    assert got[3].reject_reason == "unknown_preset"
    fr = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (2, 1, 8)], "clip_id bigint, frame_no bigint, width int")
    table = config.run_summary(fr, config.run_config(req), cell_background_mode="optimized")
    row = {r.clip_id: r for r in table.collect()}
    assert row[1].frames == 2 and row[1].fit_cell_backgrounds and len(table.columns) == 16
    assert '"frames":2' in {r.clip_id: r.details for r in config.summary_json(table).collect()}[1]


def test_writers(spark, tmp_path):
    cells = spark.createDataFrame([(c, 1, r, k, "#", 1, 2, 3, None, None, None) for c in (1, 2) for r in range(2) for k in range(3)],
                                  "clip_id bigint, frame_no bigint, row int, col int, glyph string, fr int, fg int, fb int, br int, bg int, bb int")
    out = str(tmp_path / "out")
    writers.write_frames(cells, out, "text+color")
    back = spark.read.parquet(out + "/text")
    assert {r.text for r in back.collect()} == {"###\n###\n"} and spark.read.parquet(out + "/color").count() == 2
    # overwriting one clip leaves the other
    writers.write_text_frames(frames(spark, [(2, 1, "new")]), out + "/text")
    assert sorted(r.text for r in spark.read.parquet(out + "/text").collect()) == ["###\n###\n", "new"]
    with pytest.raises(ValueError):
        writers.write_frames(cells, out, "neither")
    with pytest.raises(Exception, match="too_few_cells"):
        writers.write_cell_frames(cells.filter("not (row = 0 and col = 1)"), out + "/bad")
