"""Views of the test tables as clips, frames, cells, pixels and sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.exprs import glyph_for_luma, idiv, luminance, ntz_micros
from glyphloom.operators.ordering import by_frame, dense_index, frames_apart


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _least_lines(batches):
    """Task-side helper: the lines of an order and number in a batch, as one line of minima."""
    for batch in batches:
        least = pa.Table.from_batches([batch]).group_by(["o", "n"]).aggregate([(c, "min") for c in "qps"])
        yield from least.rename_columns({f"{c}_min": c for c in "qps"}).select(batch.schema.names).to_batches()


def lineitem_cells(spark: SparkSession, sf_dir: str, copies: int = 0) -> DataFrame:
    """Coloured cells, at most 32 x 14 per frame: 64 orders make a frame, 1024 a clip.

    Several lines may claim one cell; it takes the smallest quantity, part and
    supplier of them. These are plain minima, so a hot order key collapses on the map
    side and frames stay small. Every fourth frame has no background.

    With ``copies`` the cells come spread by (clip, frame), each about to become so many rows:
    lines meet by frame instead of by cell, in the same single exchange.
    """
    table = _read(spark, sf_dir, "lineitem")
    lines = table.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"),
                         F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    order = F.col("o")
    clip, frame = idiv(order, 1024), idiv(order, 64)
    if copies:
        lines = frames_apart(lines.mapInArrow(_least_lines, lines.schema), copies, table.count(), (clip, frame))
    lines = lines.select(
        clip.alias("clip_id"),
        frame.alias("frame_no"),
        (order % 32).cast("int").alias("row"),
        (F.col("n") - 1 + 7 * (idiv(order, 32) % 2)).cast("int").alias("col"),
        "q", "p", "s", "o",
    )
    won = lines.groupBy("clip_id", "frame_no", "row", "col").agg(*[F.min(c).alias(c) for c in "qpso"])
    q, p, s = F.col("q"), F.col("p"), F.col("s")
    backed = F.col("frame_no") % 4 != 0
    coloured = won.select(
        "clip_id", "frame_no", "row", "col",
        ((q * 5) % 256).cast("int").alias("fr"),
        (p % 256).cast("int").alias("fg"),
        ((s * 7) % 256).cast("int").alias("fb"),
        F.when(backed, (F.col("o") % 256).cast("int")).alias("br"),
        F.when(backed, (p % 251).cast("int")).alias("bg"),
        F.when(backed, (s % 241).cast("int")).alias("bb"),
    )
    return coloured.withColumn("glyph", glyph_for_luma(luminance(F.col("fr"), F.col("fg"), F.col("fb")), 20))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-float vector as one 8 x 8 RGB image; the label is the clip."""
    vec = F.col("embedding")

    def level(shift):
        at = F.element_at(vec, ((F.col("k") + shift) % 64 + 1).cast("int")).cast("double")
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((at + 1.0) * 127.5))).cast("int")

    vectors = _read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("clip_id"), F.col("vec_id").alias("frame_no"), "embedding")
    return (
        by_frame(vectors).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63))))
        .select("clip_id", "frame_no", F.lit(8).alias("width"), F.lit(8).alias("height"), idiv(F.col("k"), 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"),
                level(0).alias("r"), level(21).alias("g"), level(42).alias("b"))
    )


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per user; the events in time order are its frames, numbered from 1 without
    gaps, so the index of a frame is its number less one."""
    events = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", F.col("event_type").alias("text"), ntz_micros(F.col("ts")).alias("t_us")
    )
    minute = idiv(F.col("t_us"), 60_000_000)
    frames = dense_index(events, ["clip_id"], ["t_us", "event_id"], minute, out="frame_no", start=1)
    return frames.withColumn("frame_idx", (F.col("frame_no") - 1).cast("int"))


def document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line text frames; the source is the clip."""
    return _read(spark, sf_dir, "documents").select(
        F.substring("source", 4, 20).cast("bigint").alias("clip_id"), F.col("doc_id").alias("frame_no"), "text"
    )


def conversation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per conversation, the role of each turn as its frame."""
    return _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("clip_id"), (F.col("turn") + 1).alias("frame_no"), F.col("role").alias("text")
    )


def tiny_atlas(spark: SparkSession) -> DataFrame:
    """Rule-made 4 x 4 coverage table for the ten-glyph ramp (dyadic, so sums are exact)."""
    p, py, px = F.col("p"), F.col("py"), F.col("px")
    grid = spark.range(160).select(
        idiv(F.col("id"), 16).cast("int").alias("p"), (idiv(F.col("id"), 4) % 4).cast("int").alias("py"),
        (F.col("id") % 4).cast("int").alias("px"),
    )
    covered = ((py * 4 + px) * 7 + p * 3) % 10 < p
    alpha = F.when(covered, ((p + py + px) % 4 + 1) / 4.0).otherwise(0.0)
    return grid.select(F.substring(F.lit(TINY_RAMP), p + 1, F.lit(1)).alias("glyph"), "py", "px", alpha.alias("alpha"))


TINY_RAMP = " .:-=+*#%@"


def picked_cells() -> list[tuple[int, int]]:
    """A cell selection that partly lies outside the 32 x 14 grid."""
    return [(r, c) for r in range(0, 36) for c in range(0, 18) if (r * 7 + c * 3) % 5 == 0]
