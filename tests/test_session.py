"""Functions from SQL text, and counts observed on a write."""

import pytest
from pyspark.sql import functions as F

from glyphloom import catalog
from glyphloom.functions import exprs as X
from glyphloom.functions import session
from glyphloom.sources.writers import write_valid_frames


def test_functions_equal_the_expressions_on_edge_values(spark):
    session.register(spark)
    df = spark.createDataFrame([(0, 0, 0, 255, " ", "@"), (255, 255, 255, 0, "@", "é"), (12, 200, 7, 40, "#", "#"), (None, 1, 2, 3, None, " "), (254, 1, 0, 254, "\x00", "")],
                               "r int, g int, b int, a int, one string, other string")
    pairs = {
        "gl_luminance(r, g, b)": X.luminance(*map(F.col, "rgb")), "gl_glyph_for_luma(a, 255)": X.glyph_for_luma(F.col("a"), 255), "gl_glyph_for_luma(a, 20)": X.glyph_for_luma(F.col("a"), 20),
        "gl_ramp_luminance(one)": X.ramp_luminance(F.col("one")), "gl_ramp_luminance(one, 'xx')": X.ramp_luminance(F.col("one"), "xx"), "gl_ramp_distance(one, other, 'a#@a')": X.ramp_distance(F.col("one"), F.col("other"), "a#@a"),
        "gl_rgb_distance_l2(r, g, b, a, g, r)": X.rgb_distance_l2(tuple(map(F.col, "rgb")), tuple(map(F.col, "agr"))), "gl_rgb_distance_l1(r, g, b, a, g, r)": X.rgb_distance_l1(tuple(map(F.col, "rgb")), tuple(map(F.col, "agr"))),
        "gl_blend_channel(r, g, a)": X.blend_channel(*map(F.col, "rga")), "gl_is_blank(one)": X.is_blank(F.col("one")), "gl_is_occupied(one)": X.is_occupied(F.col("one")),
        "gl_grid_size(g + 1, b + 1, r, 0.44D)": X.grid_size(F.col("g") + 1, F.col("b") + 1, F.col("r"), 0.44),
    }
    got = df.select(*[F.expr(sql).alias(f"s{i}") for i, sql in enumerate(pairs)], *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())]).collect()
    for row in got:
        for i, sql in enumerate(pairs):
            assert row[f"s{i}"] == row[f"c{i}"], sql


@pytest.mark.parametrize("stamp", ["1:02:03.5", "59", "", "x:1", "-1:.5", "1e2:3.", None, "1:2:3:4"])
def test_seconds(spark, stamp):
    session.register(spark)
    df = spark.createDataFrame([(stamp,)], "stamp string").select(F.expr("gl_seconds(stamp)").alias("a"), X.parse_timestamp(F.col("stamp")).alias("b")).first()
    assert df["a"] == df["b"]


def test_functions_leave_no_python_in_the_plan_and_fold(spark):
    plan = catalog.QUERIES["session_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert spark.sql("SELECT * FROM range(5) WHERE gl_luminance(255, 255, 255) = 1")._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation")


@pytest.mark.parametrize("policy", ["pad", "rect"])
def test_counts_come_with_the_write_in_one_job(spark, tmp_path, policy):
    texts = ["ab\ncd\n", "", None, "é\n", "\n\n", "a\nbcd\n", "xy\n"]
    frames = spark.createDataFrame([(i % 2, i, t, "x") for i, t in enumerate(texts)], "clip_id long, frame_no long, text string, reject_reason_2 string")
    group = f"observed-{policy}"
    spark.sparkContext.setJobGroup(group, "")
    seen = write_valid_frames(frames, str(tmp_path / "out"), policy)
    spark.sparkContext.setJobGroup("later", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    from glyphloom.sources.text import validate_frames
    reasons = [r.reject_reason for r in validate_frames(frames, policy).collect()]
    assert seen["frames"] == 7 and seen["written"] == len(out) == reasons.count(None) and seen["characters"] == sum(len(r.text) for r in out)
    assert {k: v for k, v in seen.items() if k not in ("frames", "written", "characters")} == {k: reasons.count(k) for k in ("empty", "non_ascii", "zero_width", "ragged", "nothing_left")}
    assert write_valid_frames(frames.limit(0), str(tmp_path / "none"), policy)["frames"] == 0
