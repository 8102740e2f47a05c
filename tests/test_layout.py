import pytest
from pyspark.sql import functions as F

from glyphloom.operators import compare, dedup
from glyphloom.sources import layout, text

FRAMES = "clip_id bigint, frame_no bigint, text string"


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(c, i, "ab\ncd" if i % 3 else f"{c}{i}\nxy") for c in (1, 2, 3) for i in range(200)]
    shaped = text.text_shape(spark.createDataFrame(rows, FRAMES))
    none = F.lit(None).cast("array<int>")
    colored = shaped.filter("frame_no % 4 <> 1").select("clip_id", "frame_no", "width", "height", F.upper("glyphs").alias("glyphs"), none.alias("fg"), none.alias("bg"))
    plain = shaped.filter("frame_no % 5 <> 2")
    names = [f"stored_{k}_{tmp_path.name.replace('-', '_')}" for k in ("text", "color", "plan", "made")]
    plan = dedup.dedup_frames(plain, "text")
    made = dedup.representatives(plain, plan).select("clip_id", "frame_no", F.length("text").alias("chars"))
    parts = [plain, colored, plan, made]
    store = [layout.store_frames, layout.store_frames, layout.store_plan, layout.store_frames]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield parts, [f(df, n, path=f"{tmp_path}/{n}") for f, df, n in zip(store, parts, names)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_stored_frames_meet_without_an_exchange(spark, stored):
    (plain, colored, plan, made), (s_plain, s_colored, s_plan, s_made) = stored
    for live, kept in ((text.pair_payloads(plain, colored), text.pair_payloads(s_plain, s_colored)),
                       (dedup.fanout_duplicates(plan, made), dedup.fanout_duplicates(s_plan, s_made)),
                       (dedup.representatives(plain, plan.select("clip_id", "frame_no", "is_duplicate")), None)):
        assert exchanges(live) > 0
        if kept is not None:
            assert exchanges(kept) == 0, kept._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, live.collect())) == sorted(map(str, kept.collect()))


def test_difference_images(spark):
    pixels = "clip_id bigint, frame_no bigint, y int, x int, r int, g int, b int"
    left = spark.createDataFrame([(1, 1, 0, 0, 5, 5, 5), (1, 1, 0, 1, 0, 0, 0), (1, 2, 0, 0, 1, 2, 3), (1, 3, 0, 0, 1, 1, 1)], pixels)
    right = spark.createDataFrame([(1, 1, 0, 0, 5, 9, 0), (1, 1, 0, 1, 0, 0, 0), (1, 2, 0, 0, 1, 2, 3), (1, 4, 0, 0, 7, 7, 7)], pixels)
    got = {(r.frame_no, r.y, r.x): (r.r, r.g, r.b, r.same) for r in compare.diff_pixels(left, right).collect()}
    assert got == {(1, 0, 0): (0, 4, 5, False), (1, 0, 1): (0, 0, 0, True), (2, 0, 0): (0, 0, 0, True), (3, 0, 0): (None, None, None, False), (4, 0, 0): (None, None, None, False)}
    frames = {r.frame_no: (r.identical, r.pixels_different, r.max_difference, r.total_difference) for r in compare.diff_images(left, right).collect()}
    assert frames == {1: (False, 1, 5, 9), 2: (True, 0, 0, 0), 3: (False, 1, 0, 0), 4: (False, 1, 0, 0)}


def test_grouped_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Pixels and cells are grouped in as many partitions as they fill, not in a number that the session sets."""
    from glyphloom.operators import masks

    monkeypatch.setattr("glyphloom.operators.ordering.TASK_ROWS", 100)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pixels = spark.range(100 * least).selectExpr("id % 50 AS clip_id", "id AS frame_no", "1 AS y", "2 AS x", "3 AS r", "4 AS g", "5 AS b")
    met = compare.diff_pixels(pixels, pixels)
    assert met.rdd.getNumPartitions() == 2 * least and met.where("same").count() == 100 * least
    cells = pixels.selectExpr("clip_id", "frame_no", "y AS row", "x AS col", "'#' AS glyph", "r AS fr", "g AS fg", "b AS fb")
    around = masks.neighbour_sums(cells, 1)
    assert around.rdd.getNumPartitions() == 3 * least and around.where("n = 0").count() == 100 * least


@pytest.fixture
def lines(spark, tmp_path):
    """Order lines with absent keys, cells that several lines claim and an order with most of the lines."""
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_partkey bigint, l_suppkey bigint"
    rows = [(i * 5, i % 7 + 1, float(i % 50 + 1), i * 37, i * 11) for i in range(900)]
    rows += [(70, i % 9, float(i % 40), 5000 - i, i) for i in range(2000)] + [(70, 1, None, None, 3), (None, 1, 2.0, 3, 4), (None, None, None, 9, 4), (641, None, 4.0, None, 6)] + rows[:50]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def drawn_apart(spark, path):
    """The two runs of the difference queries, from cells that were not spread by frame."""
    from glyphloom import adapters, catalog
    from glyphloom.functions import exprs as X
    from glyphloom.operators import raster

    cells = adapters.lineitem_cells(spark, path)
    low, high = (cells.withColumn("glyph", X.glyph_for_luma(X.luminance(*catalog.fore()), t, catalog.TINY)) for t in (40, 130))
    return [raster.rasterise_cells(run, adapters.tiny_atlas(spark), 4, 4) for run in (low, high.filter("frame_no % 11 <> 3"))]


def sent_above_the_union(df):
    """Exchanges that the pixels of both runs pass."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Union")
    return plan[0].count("Exchange") if len(plan) == 2 else None


def test_pixels_of_the_difference_are_not_sent(spark, lines):
    """cells are spread by frame before they are drawn, so no pixel is shuffled."""
    from glyphloom.catalog import QUERIES

    got = QUERIES["diff_pixels"](spark, lines)
    assert sent_above_the_union(got) == 0
    want = compare.diff_pixels(*drawn_apart(spark, lines)).filter("NOT same")
    assert sent_above_the_union(want) == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_lines_of_a_hot_order_collapse_before_they_are_sent(spark, lines):
    from glyphloom import adapters

    batch = spark.read.parquet(f"{lines}/lineitem.parquet").where("l_orderkey = 70").selectExpr(
        "l_orderkey o", "l_linenumber n", "cast(l_quantity as int) q", "l_partkey p", "l_suppkey s").toArrow().combine_chunks().to_batches()[0]
    assert batch.num_rows > 2000 and sum(b.num_rows for b in adapters._least_lines([batch])) == 9


def test_pixels_of_compared_images_are_not_sent(spark, lines):
    """frames are summed up where their pixels were drawn."""
    from glyphloom.catalog import QUERIES

    got = QUERIES["diff_images"](spark, lines)
    assert sent_above_the_union(got) == 0
    want = compare.diff_images(*drawn_apart(spark, lines))
    assert sent_above_the_union(want) == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
