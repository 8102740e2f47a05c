import pytest
from pyspark.sql import functions as F

from glyphloom.functions import exprs as X


def value(spark, column, **lits):
    df = spark.range(1)
    for k, v in lits.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("rgb,want", [((0, 0, 0), 0), ((255, 255, 255), 255), ((255, 0, 0), 54), ((0, 255, 0), 182), ((0, 0, 255), 18)])
def test_luminance(spark, rgb, want):
    assert value(spark, X.luminance(*rgb)) == want


@pytest.mark.parametrize("luma,want", [(0, " "), (9, " "), (255, "#")])
def test_glyph_for_luma(spark, luma, want):
    assert value(spark, X.glyph_for_luma(luma, 10, " .:#")) == want


@pytest.mark.parametrize("a,b,want", [((1, 2, 3), (1, 2, 3), 0), ((255, 255, 255), (0, 0, 0), 255), ((255, 0, 0), (0, 0, 0), 147), ((200, 100, 0), (210, 110, 10), 10)])
def test_rgb_distance_l2(spark, a, b, want):
    assert value(spark, X.rgb_distance_l2(a, b)) == want


def test_rgb_distance_l1(spark):
    assert value(spark, X.rgb_distance_l1((255, 0, 0), (0, 255, 255))) == 1.0


def test_ramp_luminance(spark):
    ramp = " .:-=+*#%@"
    assert value(spark, X.ramp_luminance(" ", ramp)) == 0
    assert value(spark, X.ramp_luminance("@", ramp)) == 255
    assert value(spark, X.ramp_luminance("Q", ramp)) is None
    assert value(spark, X.ramp_luminance("x", "x")) == 0
    with pytest.raises(ValueError):
        X.ramp_luminance("x", "")


def test_first_and_last_ramp_position(spark):
    assert value(spark, X.ramp_luminance("a", "ab.a")) == 0
    # last position of a is 3, of b 1
    assert value(spark, X.ramp_distance("a", "b", "ab.a")) == pytest.approx(2 / 3)
    assert value(spark, X.ramp_distance("a", "a", "ab.a")) == 0.0
    assert value(spark, X.ramp_distance("a", "?", "ab.a")) == 1.0


@pytest.mark.parametrize("rgb,deg,want", [
    ((255, 0, 0), 120, (0, 255, 0)), ((0, 255, 0), 120, (0, 0, 255)), ((0, 0, 255), 120, (255, 0, 0)),
    ((80, 80, 80), 137, (80, 80, 80)), ((10, 200, 30), 360, (10, 200, 30)), ((10, 200, 30), -360, (10, 200, 30)),
    ((0, 0, 255), -120, (0, 255, 0))])
def test_hue(spark, rgb, deg, want):
    df = spark.createDataFrame([rgb, (None, None, None)], "r int, g int, b int")
    assert set(map(tuple, X.hue_rotate(df, ("r", "g", "b"), float(deg)).collect())) == {want, (None, None, None)}


@pytest.mark.parametrize("text,want", [("00:01:23.456", 83.456), ("83.456", 83.456), ("1:02:03", 3723.0), ("x", 0.0), ("", 0.0)])
def test_parse_timestamp(spark, text, want):
    assert value(spark, X.parse_timestamp(text)) == pytest.approx(want)


@pytest.mark.parametrize("w,h,cols,ratio,want", [(8, 8, 4, 0.5, (4, 2)), (1920, 1080, 400, 0.7, (400, 158)), (10, 1, None, 0.1, (10, 1)), (100, 7, 2, 0.44, (2, 1))])
def test_grid_size(spark, w, h, cols, ratio, want):
    assert tuple(value(spark, X.grid_size(w, h, F.lit(cols).cast("int"), ratio))) == want


def test_blend(spark):
    assert value(spark, X.blend_channel(0, 255, 128)) == 128
    assert value(spark, X.blend_channel(10, 200, 0)) == 10
    assert value(spark, X.blend_channel(10, 200, 255)) == 200


@pytest.mark.parametrize("text,want", [("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\n\nb", ["a", "", "b"])])
def test_text_lines(spark, text, want):
    assert value(spark, X.text_lines(F.col("t")), t=text) == want
