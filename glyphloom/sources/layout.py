"""Frames stored by key, so that work on stored frames needs no exchange.

Tables are bucketed and sorted by (clip, frame). Pairing text with colours, repeating results for
duplicates and comparing runs are joins on just these keys: tasks read matching buckets of both
sides, already sorted, whatever the size of a clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphloom.schemas import FRAME_KEYS


def buckets(spark: SparkSession) -> int:
    """Tables that are to meet need one number of buckets: that of the shuffle partitions unless told."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_frames(frames: DataFrame, name: str, keys: list[str] | None = None, n: int | None = None, path: str | None = None) -> DataFrame:
    """Store frames as the table ``name``, bucketed and sorted by ``keys`` (clip and frame number by default), and return it.

    The one exchange of writing makes each bucket a single file, so that its order holds when it is read.
    ``path`` names a folder for an external table; otherwise it lies in the warehouse.
    """
    keys, spark = keys or FRAME_KEYS, frames.sparkSession
    n = n or buckets(spark)
    writer = frames.repartition(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def store_plan(plan: DataFrame, name: str, n: int | None = None, path: str | None = None) -> DataFrame:
    """Store a duplicate plan by its representatives: the key that results are repeated by."""
    return store_frames(plan, name, ["clip_id", "rep_frame_no"], n, path)
