"""Archives of clips of any size, addressed by byte offset.

An archive is a header and the frames of a clip in order, each behind its length. Where a frame
stands follows from the sizes of those before it, so offsets need no payload. The payload goes
through one exchange by ranges of (clip, frame): every task writes the stretch of bytes that it
holds as segments, and a manifest says where in the archive each segment begins. No clip has to
fit in one row, one task or one executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.exprs import idiv
from glyphloom.operators.ordering import BLOCK
from glyphloom.schemas import PACK_MAGIC, PACK_VERSION

#: Bytes before the first frame of an archive: magic, version, number of frames.
HEADER_BYTES = 12
#: Bytes of a segment; a larger frame is a segment of its own.
SEGMENT_BYTES = 64 << 20
#: Small tables beside payloads are broadcast up to this many rows (of some 40 bytes); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000

SEGMENTS_DDL = "clip_id bigint, first_frame_no bigint, n_frames bigint, bytes bigint, body binary"


def archive_header(n: int) -> bytes:
    return PACK_MAGIC + np.array([PACK_VERSION, n], "<u4").tobytes()


def hinted(small: DataFrame) -> DataFrame:
    """A table of keys and numbers, to be broadcast if its counted rows allow it."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- offsets
def entry_size(raw: Column) -> Column:
    """Bytes of a frame in an archive: its length, as 32 bits, and itself."""
    return (F.octet_length(raw) + 4).cast("bigint")


def running_sizes(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """Bytes of the entries before each frame of its clip: clip_id, frame_no, size, before.

    Sizes alone are added up, inside blocks of frame numbers and then across them. Frames without
    payload take no room and are left out.
    """
    sizes = frames.where("raw IS NOT NULL").select("clip_id", "frame_no", entry_size(F.col("raw")).alias("size"))
    sizes = sizes.withColumn("_block", idiv(F.col("frame_no"), block))
    totals = sizes.groupBy("clip_id", "_block").agg(F.sum("size").alias("s"))
    earlier = W.partitionBy("clip_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("clip_id", "_block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("clip_id", "_block").orderBy("frame_no").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["clip_id", "_block"])
    return placed.select("clip_id", "frame_no", "size", (F.col("_start") + F.col("_run")).alias("before"))


def frame_offsets(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where each frame's entry begins in the archive of its clip: clip_id, frame_no, byte_offset, size (of the frame alone)."""
    return running_sizes(frames, block).select("clip_id", "frame_no", (F.col("before") + HEADER_BYTES).alias("byte_offset"), (F.col("size") - 4).alias("size"))


def part_cuts(frames: DataFrame, part_bytes: int, block: int = BLOCK) -> DataFrame:
    """Per block of frame numbers the frames at which it passes into another part: clip_id, _block, cuts."""
    parts = running_sizes(frames, block).select("clip_id", idiv(F.col("frame_no"), block).alias("_block"), "frame_no", idiv(F.col("before"), part_bytes).cast("int").alias("part"))
    firsts = parts.groupBy("clip_id", "_block", "part").agg(F.min("frame_no").alias("first"))
    return firsts.groupBy("clip_id", "_block").agg(F.collect_list(F.struct("first", "part")).alias("cuts"))


# ---------------------------------------------------------------- segments
def _cut(limit: int):
    """Task-side helper: frames in order -> segments of one clip each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(clip, first, held, size):
            cells = [(clip, pa.int64()), (first, pa.int64()), (len(held) // 2, pa.int64()), (size, pa.int64()), (b"".join(held), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cells], [c.split()[0] for c in SEGMENTS_DDL.split(", ")])

        clip, first, held, size = None, None, [], 0
        for batch in batches:
            for c, no, raw in zip(batch["clip_id"].to_pylist(), batch["frame_no"].to_pylist(), batch["raw"]):
                raw = raw.as_py()
                if held and (c != clip or size + len(raw) + 4 > limit):
                    yield row(clip, first, held, size)
                    held, size = [], 0
                if not held:
                    clip, first = c, no
                held += [len(raw).to_bytes(4, "little"), raw]
                size += len(raw) + 4
        if held:
            yield row(clip, first, held, size)

    return run


def pack_segments(frames: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The bodies of all archives in stretches: clip_id, first_frame_no, n_frames, bytes, body.

    The bodies of a clip, by first_frame_no, behind ``archive_header`` are its archive. Frames with a
    null payload are left out. The payload is exchanged once, by ranges, so that a clip is spread
    over as many tasks as its frames fill.
    """
    rows = frames.where("raw IS NOT NULL").select("clip_id", "frame_no", "raw")
    order = ["clip_id", "frame_no"]
    return rows.repartitionByRange(_partitions(frames.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_cut(segment_bytes), SEGMENTS_DDL)


def segment_manifest(segments: DataFrame) -> DataFrame:
    """Where each segment stands: clip_id, first_frame_no, segment (from 0), first_place (of its first frame, from 1), n_frames, byte_offset, bytes."""
    line = W.partitionBy("clip_id").orderBy("first_frame_no")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("n_frames", "bytes")}
    return segments.select(
        "clip_id", "first_frame_no", (F.row_number().over(line) - 1).cast("bigint").alias("segment"), (sums["n_frames"] + 1).alias("first_place"),
        "n_frames", (sums["bytes"] + HEADER_BYTES).alias("byte_offset"), "bytes")


def write_segments(frames: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``path``/segments and ``path``/manifest; returns the manifest. It is made from what was written, without the bodies."""
    spark = frames.sparkSession
    pack_segments(frames, segment_bytes).write.parquet(f"{path}/segments")
    segment_manifest(spark.read.parquet(f"{path}/segments").drop("body")).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


SEGMENT_FRAMES_DDL = "clip_id bigint, frame_no bigint, raw binary, reject_reason string"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task-side helper: a segment with its place -> its frames, numbered as in the archive."""
    schema = pa.schema([("clip_id", pa.int64()), ("frame_no", pa.int64()), ("raw", pa.binary()), ("reject_reason", pa.string())])
    for batch in batches:
        for clip, place, n, body in zip(*(batch[c].to_pylist() for c in ("clip_id", "first_place", "n_frames")), batch["body"]):
            view, at, out, size = memoryview(body.as_buffer()), 0, [], 0
            reason = None
            for k in range(n):
                end = at + 4 + (int.from_bytes(view[at:at + 4], "little") if at + 4 <= len(view) else 0)
                if at + 4 > len(view) or end > len(view):
                    reason = "truncated_length" if at + 4 > len(view) else "truncated_payload"
                    break
                out.append((clip, place + k, bytes(view[at + 4:end]), None))
                size += end - at
                at = end
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            reason = reason or (None if at == len(view) else "trailing_bytes")
            if reason:
                out.append((clip, None, None, reason))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def unpack_segments(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Frames of archives kept as segments: clip_id, frame_no (counted from 1 in the archive), raw, reject_reason.

    Every segment is read where it lies; only the manifest is sent. A broken segment gives its frames up to
    the break and one row with the reason.
    """
    placed = segments.select("clip_id", "first_frame_no", "n_frames", "body").join(
        hinted(manifest.select("clip_id", "first_frame_no", "first_place")), ["clip_id", "first_frame_no"])
    return placed.mapInArrow(_spread, SEGMENT_FRAMES_DDL)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The frames of all archives that ``write_segments`` put under ``path``."""
    return unpack_segments(spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/manifest"))
