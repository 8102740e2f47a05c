"""Order-dependent work on clips that may be far larger than one task.

A window partitioned by ``clip_id`` puts a whole clip into one task, which fails
once a single clip holds a large part of the corpus. The helpers here cut the
order into blocks first: blocks are handled in parallel, only one small row per
block is combined across blocks.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.exprs import idiv

BLOCK = 4096


def dense_index(
    df: DataFrame, keys: list[str], order: list, block: Column, out: str = "frame_idx", start: int = 0
) -> DataFrame:
    """Dense position of every row inside its group.

    ``block`` must grow with ``order``. Rows are numbered inside (group, block);
    the offset of a block is the running total of the block counts, which come
    from a map-side-combined count, so no task ever sorts a whole group.
    """
    marked = df.withColumn("_block", block)
    counts = marked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    return (
        marked.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1 + start)
        .drop("_block", "_rank", "_offset", "_n")
    )


def frame_block(col: str = "frame_no", size: int = BLOCK) -> Column:
    """Block of a frame number."""
    return idiv(F.col(col), size)


def with_frame_idx(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """``frame_idx`` by frame number inside the clip; the number is kept."""
    indexed = dense_index(frames, ["clip_id"], ["frame_no"], frame_block(size=block))
    return indexed.withColumn("frame_idx", F.col("frame_idx").cast("int"))


def with_halo(df: DataFrame, keys: list[str], idx: str, behind: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Replicate the few rows near block borders so that a sliding frame of
    ``behind`` rows back and ``ahead`` rows forward can run inside (group, ``_block``).
    ``_own`` marks the rows that belong to the block; keep only those afterwards."""
    first = F.greatest(F.lit(0), idiv(F.col(idx) - ahead, block)).cast("bigint")
    last = idiv(F.col(idx) + behind, block).cast("bigint")
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_block") == idiv(F.col(idx), block)
    )


def last_marked(df: DataFrame, keys: list[str], idx: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Latest non-null ``value`` at or before each row (a running fill), in two levels:
    the last value per block is carried across blocks, rows fill inside their block."""
    marked = df.withColumn("_v", value).withColumn("_block", idiv(F.col(idx), block))
    tails = marked.groupBy(*keys, "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(idx))).alias("_tail"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "_block", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_block").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    return (
        marked.withColumn("_fill", F.last("_v", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.coalesce("_fill", "_carry"))
        .drop("_v", "_block", "_fill", "_carry")
    )


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are small now but stand for much work (they are about to be exploded
    or scored) spread by key. The partition count is explicit: sized by bytes, Spark
    would merge such partitions into a few and serialise the work behind them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def by_frame(df: DataFrame) -> DataFrame:
    """Frames spread by (clip, frame) while each is still one compact row. Exploding
    afterwards keeps that partitioning, so per-pixel and per-cell grouping inside a
    frame needs no further shuffle."""
    return spread_out(df, "clip_id", "frame_no")


#: Rows that one task groups at once.
TASK_ROWS = 2_000_000


def frames_apart(df: DataFrame, copies: int = 1, rows: int | None = None, keys: tuple = ("clip_id", "frame_no")) -> DataFrame:
    """Rows spread by (clip, frame) over as many partitions as they fill, each row about to become ``copies``: a task then
    groups a bounded number of rows, whatever the size of the input, and grouping inside a frame needs no further shuffle.
    Where the caller has no bound for ``rows``, counting them reads the input once more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df.count() if rows is None else rows) * copies // TASK_ROWS)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is configured, a local master (tests) uses a temporary folder and a
    cluster gets an error: its executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="glyphloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
